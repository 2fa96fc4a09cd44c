"""Boxes, text extents and picture sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_PER_INCH = 914400


def intersection_ratio(a: str, b: str) -> Column:
    """Shared area over the smaller area of two boxes with columns x, y, cx, cy under the prefixes a and b."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.least(c(a, "x") + c(a, "cx"), c(b, "x") + c(b, "cx")) - F.greatest(c(a, "x"), c(b, "x"))
    h = F.least(c(a, "y") + c(a, "cy"), c(b, "y") + c(b, "cy")) - F.greatest(c(a, "y"), c(b, "y"))
    small = F.least(c(a, "cx") * c(a, "cy"), c(b, "cx") * c(b, "cy"))
    return F.when((w > 0) & (h > 0) & (small > 0), w * h / small).otherwise(F.lit(0.0))


def weighted_length(text: Column) -> Column:
    """Width of a text in ems: 1 for a CJK character, 0.55 for any other."""
    cjk = F.length(F.regexp_replace(text, "[^\\u4e00-\\u9fff]", ""))
    return cjk * F.lit(1.0) + (F.length(text) - cjk) * F.lit(0.55)


def looks_overfull(text: Column, width_in: Column, height_in: Column, font_pt: Column, auto_fit: Column | None = None) -> Column:
    """Whether the lines a text needs are higher than its box with a slack of 15 percent; never for boxes that fit themselves."""
    per_line = F.greatest(F.lit(1.0), width_in * 72 / font_pt)
    needs = F.ceil(weighted_length(text) / per_line) * font_pt * 1.28 / 72
    full = needs > height_in * 1.15
    usable = (font_pt > 0) & (width_in > 0) & (height_in > 0)
    return F.coalesce(full & usable & (F.lit(True) if auto_fit is None else ~auto_fit), F.lit(False))


def contain_fit(x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Struct (x, y, w, h): the picture at its aspect ratio, as large as the box allows, centred."""
    scale = F.least(w / image_w, h / image_h)
    return F.struct((x + (w - image_w * scale) / 2).alias("x"), (y + (h - image_h * scale) / 2).alias("y"), (image_w * scale).alias("w"), (image_h * scale).alias("h"))


def png_size(content: Column) -> Column:
    """Struct (w, h) from the header of PNG bytes, or null."""
    part = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(part(17).alias("w"), part(21).alias("h")))
