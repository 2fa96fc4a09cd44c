"""All elements of a slide with their places, for any writer: its frame, body, and source pictures, tables, formulas and diagrams; and its notes.

  slides(paper_id, slide_id, number, section, technical_title, title, main_claim, body ARRAY<STRING>, takeaway, citations ARRAY<STRING>, layout)
  visuals(paper_id, slide_id, pos, kind, source_ref, caption, treatment, annotations ARRAY<STRING>, column_labels ARRAY<STRING>, image_w, image_h,
          cells ARRAY<ARRAY<STRING>>, formula, formula_number)

pos counts a slide's visuals from 0. Elements are (paper_id, slide_id, z, kind, text, cells, x, y, w, h, font); lengths in inches, fonts in points, null for shapes.
Only visuals are joined with their slides, by slide. Null texts are empty; an unknown layout is laid out as minimal_text; a slide without body has no lines; a picture without a size has no place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import contain_fit
from .layout import LAYOUTS, SHARED

# Fixed values that results depend on: sizes of the fonts, places of the frame's parts, gaps and margins.
FONTS = {"title": 29.0, "technical_title": 11.0, "body": 19.0, "takeaway": 17.0, "citation": 10.0}
SECTION_FONT, FOLIO_FONT, CAPTION_FONT, FORMULA_FONT, LEAST_DIAGRAM_FONT = 10.0, 9.0, 9.5, 27.0, 13.0
SECTION_BOX = (0.2, 3.7, 0.25)
TECHNICAL_BOX = (8.6, 0.2, 3.85, 0.25)
FOLIO_BOX = (12.35, 7.04, 0.28, 0.2)
RULE_Y, BAR_WIDTH = 1.38, 0.08
VISUAL_GAP, DIAGRAM_GAP, DIAGRAM_LABELS = 0.18, 0.24, 4
LONG_TABLE, TABLE_HEAD, TABLE_TAIL = 8, 2, 4
KEYS = ("paper_id", "slide_id")


def _element(z, kind: str, x, y, w, h, text=None, font=None, cells=None) -> Column:
    place = [(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in (("x", x), ("y", y), ("w", w), ("h", h), ("font", font))]
    words = F.lit(None).cast("string") if text is None else F.coalesce(text, F.lit(""))
    grid = F.lit(None).cast("array<array<string>>") if cells is None else cells
    return F.struct((z if isinstance(z, Column) else F.lit(z)).cast("int").alias("z"), F.lit(kind).alias("kind"), words.alias("text"), grid.alias("cells"), *place)


def _rows(df: DataFrame, elements: Column) -> DataFrame:
    return df.select(*KEYS, F.explode(elements).alias("e")).select(*KEYS, "e.*")


def _part(name: str) -> dict[str, Column]:
    """x, y, w, h of a part as columns that depend on the layout."""
    table = F.create_map(*[v for layout, own in LAYOUTS.items() for v in (F.lit(layout), F.array(*map(F.lit, own[name])))])
    box = table[_layout()]
    return {n: F.get(box, k) for k, n in enumerate("xywh")}


def _layout() -> Column:
    return F.when(F.col("layout").isin(*LAYOUTS), F.col("layout")).otherwise("minimal_text")


def frame(slides: DataFrame, fonts: dict[str, float] = FONTS) -> DataFrame:
    """Section, technical title (if any), title, rule, takeaway on its panel, citations, and the slide's number of two digits at least."""
    (tx, ty, tw, th), (kx, ky, kw, kh), citation = SHARED["title"], SHARED["takeaway"], SHARED["citation"]
    sy, sw, sh = SECTION_BOX
    technical = F.when(F.length("technical_title") > 0, _element(1, "technical_title", *TECHNICAL_BOX, F.col("technical_title"), fonts["technical_title"]))
    parts = (
        _element(0, "section", tx, sy, sw, sh, F.upper("section"), SECTION_FONT),
        technical,
        _element(2, "title", tx, ty, tw, th, F.col("title"), fonts["title"]),
        _element(3, "rule", tx, RULE_Y, tw, 0.0),
        _element(4, "takeaway_panel", kx, ky, kw, kh),
        _element(5, "takeaway_bar", kx, ky, BAR_WIDTH, kh),
        _element(6, "takeaway", kx + 0.2, ky + 0.06, kw - 0.4, kh - 0.12, F.col("takeaway"), fonts["takeaway"]),
        _element(7, "citation", *citation, F.array_join(F.coalesce("citations", F.array().cast("array<string>")), " · "), fonts["citation"]),
        _element(8, "folio", *FOLIO_BOX, F.format_string("%02d", F.col("number").cast("long")), FOLIO_FONT),
    )
    return _rows(slides, F.array_compact(F.array(*parts)))


def body(slides: DataFrame, fonts: dict[str, float] = FONTS) -> DataFrame:
    """Lines of the body, each with its mark; minimal_text shows the main claim above them, table_focus shows none."""
    b, n = _part("text"), F.greatest(F.size("body"), F.lit(1))
    alone = _layout() == "minimal_text"
    start = b["y"] + F.when(alone, F.least(F.lit(1.7), b["h"] * 0.42)).otherwise(0.0)
    room = b["h"] - (start - b["y"])
    gap = F.least(F.lit(0.2), room * 0.06)
    high = F.least(F.lit(0.82), (room - gap * (n - 1)) / n)
    s = slides.where("layout IS DISTINCT FROM 'table_focus'").select(*KEYS, "main_claim", "body", "layout").withColumn("at", F.struct(*[b[c].alias(c) for c in "xywh"], start.alias("start"), (high + gap).alias("step"), high.alias("high")))
    claim = _rows(s.where(alone), F.array(_element(20, "claim", F.col("at.x"), F.col("at.y"), F.col("at.w"), F.least(F.lit(1.5), F.col("at.h") * 0.38), F.col("main_claim"), fonts["body"] + 6)))
    lines = s.select(*KEYS, "at", F.posexplode("body").alias("i", "line"))
    y = F.col("at.start") + F.col("i") * F.col("at.step")
    mark = _element(21 + 2 * F.col("i"), "mark", F.col("at.x"), y + 0.12, 0.18, 0.0)
    text = _element(22 + 2 * F.col("i"), "line", F.col("at.x") + 0.32, y, F.col("at.w") - 0.32, F.col("at.high"), F.col("line"), fonts["body"])
    return claim.unionByName(_rows(lines, F.array(mark, text)))


def _diagram(df: DataFrame, z: Column, fonts: dict[str, float]) -> DataFrame:
    """df(keys, bx, by, bw, bh, body): steps side by side from the first lines of the body."""
    n = F.greatest(F.least(F.size("body"), F.lit(DIAGRAM_LABELS)), F.lit(1))
    wide = (F.col("bw") - DIAGRAM_GAP * (n - 1)) / n
    d = df.withColumn("z0", z).withColumn("wide", wide).withColumn("n", n).select(*KEYS, "z0", "bx", "by", "bh", "wide", "n", F.posexplode(F.slice("body", 1, DIAGRAM_LABELS)).alias("i", "label"))
    x, y, half = F.col("bx") + F.col("i") * (F.col("wide") + DIAGRAM_GAP), F.col("by") + F.col("bh") * 0.25, F.col("bh") * 0.5
    at = F.col("z0") + 2 * F.col("i")
    shape = F.when(F.col("i") == F.col("n") - 1, _element(at, "step_box", x, y, F.col("wide"), half)).otherwise(_element(at, "step_arrow", x, y, F.col("wide"), half))
    text = _element(at + 1, "step", x + 0.12, y + 0.12, F.col("wide") - 0.24, half - 0.24, F.col("label"), max(LEAST_DIAGRAM_FONT, fonts["body"] - 2))
    return _rows(d, F.array(shape, text))


def shown_cells(cells: Column, treatment: Column, labels: Column) -> Column:
    """Rows of a table as shown: of a long highlighted one the first two, a row of dots and the last four; column labels replace the first row."""
    width = F.array_max(F.transform(cells, lambda r: F.size(r)))
    dots = F.concat(F.array(F.lit("…")), F.array_repeat(F.lit(""), F.greatest(width - 1, F.lit(0))))
    short = F.concat(F.slice(cells, 1, TABLE_HEAD), F.array(dots), F.slice(cells, -TABLE_TAIL, TABLE_TAIL))
    rows = F.when((treatment == "highlight") & (F.size(cells) > LONG_TABLE), short).otherwise(cells)
    return F.when(labels.isNotNull() & (F.size(labels) == F.size(F.get(rows, 0))), F.concat(F.array(labels), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))).otherwise(rows)


def _panels(slides: DataFrame, visuals: DataFrame) -> DataFrame:
    """Visuals with their box (bx, by, bw, bh), stacked in their slide's. Slides of minimal text show none."""
    b = _part("visual")
    s = slides.where(_layout() != "minimal_text").select(*KEYS, "body", *[b[c].alias(f"s{c}") for c in "xywh"])
    v = visuals.join(visuals.groupBy(*KEYS).agg(F.count("*").alias("n_visuals")), list(KEYS)).join(s, list(KEYS))
    high = (F.col("sh") - VISUAL_GAP * (F.col("n_visuals") - 1)) / F.col("n_visuals")
    return v.withColumn("bx", F.col("sx")).withColumn("bw", F.col("sw")).withColumn("bh", high).withColumn("by", F.col("sy") + F.col("pos") * (high + VISUAL_GAP)).withColumn("z0", 100 + 20 * F.col("pos"))


def pictures(slides: DataFrame, visuals: DataFrame, fonts: dict[str, float] = FONTS) -> DataFrame:
    """A panel for each visual and on it the source picture at its own aspect ratio, the native table, the formula or the diagram, with caption and first annotation."""
    v, (x, y, w, h, z) = _panels(slides, visuals), (F.col(c) for c in ("bx", "by", "bw", "bh", "z0"))
    captioned = F.length("caption") > 0
    note = F.get("annotations", 0)
    panel = _element(z, "panel", x, y, w, h)
    noted = F.when((F.length(note) > 0) & (F.col("kind") != "source_table"), F.array(_element(z + 18, "annotation_mark", x + 0.18, y + 0.18, 0.35, 0.0), _element(z + 19, "annotation", x + 0.62, y + 0.05, w - 0.82, 0.28, note, CAPTION_FONT)))
    fit = contain_fit(x + 0.12, y + 0.12, w - 0.24, h - F.when(captioned, 0.52).otherwise(0.24), F.nullif(F.col("image_w").cast("double"), F.lit(0.0)), F.nullif(F.col("image_h").cast("double"), F.lit(0.0)))
    picture = F.array(_element(z + 1, "picture", F.col("fit.x"), F.col("fit.y"), F.col("fit.w"), F.col("fit.h"), F.col("source_ref")))
    caption = F.when(captioned, F.array(_element(z + 2, "caption", x + 0.18, y + h - 0.32, w - 0.36, 0.22, F.col("caption"), CAPTION_FONT)))
    n_rows, n_cols = F.size("shown"), F.array_max(F.transform("shown", lambda r: F.size(r)))
    font = F.greatest(F.lit(8.0), F.least(F.lit(13.0), 13 - F.greatest(F.lit(0), n_rows - 5) * 0.35 - F.greatest(F.lit(0), n_cols - 4) * 0.4))
    table = F.array(_element(z + 1, "table", x + 0.25, y + 0.3, w - 0.5, h - 1.0, F.col("source_ref"), font, F.col("shown")))
    below = F.when(captioned, F.array(_element(z + 2, "caption", x + 0.25, y + h - 0.28, w - 0.5, 0.2, F.col("caption"), CAPTION_FONT)))
    formula = F.array(_element(z + 1, "formula", x + 0.35, y + 0.35, w - 0.7, h - 0.72, F.col("formula"), FORMULA_FONT))
    numbered = F.trim(F.concat(F.lit("Equation "), F.coalesce(F.col("formula_number").cast("string"), F.lit(""))))
    named = F.array(_element(z + 2, "caption", x + 0.35, y + h - 0.3, w - 0.7, 0.2, F.coalesce("caption", numbered), CAPTION_FONT))
    none = F.array().cast("array<struct<z:int,kind:string,text:string,cells:array<array<string>>,x:double,y:double,w:double,h:double,font:double>>")
    v = v.withColumn("shown", shown_cells(F.col("cells"), F.col("treatment"), F.col("column_labels"))).withColumn("fit", F.when(F.col("kind") == "source_asset", fit))
    own = F.when(F.col("kind") == "source_asset", F.concat(picture, F.coalesce(caption, none))).when(F.col("kind") == "source_table", F.concat(table, F.coalesce(below, none))).when(F.col("kind") == "source_equation", F.concat(formula, named)).otherwise(none)
    flat = _rows(v, F.concat(F.array(panel), own, F.coalesce(noted, none)))
    drawn = v.where("kind NOT IN ('source_asset', 'source_table', 'source_equation')")
    return flat.unionByName(_diagram(drawn, F.col("z0") + 1, fonts))


def slide_elements(slides: DataFrame, visuals: DataFrame, fonts: dict[str, float] = FONTS) -> DataFrame:
    """Every element of every slide; a process slide without visuals shows its body as a diagram too."""
    b = _part("visual")
    bare = slides.where("layout = 'process'").join(visuals.select(*KEYS).distinct(), list(KEYS), "left_anti").select(*KEYS, "body", *[b[c].alias(f"b{c}") for c in "xywh"])
    return frame(slides, fonts).unionByName(body(slides, fonts)).unionByName(pictures(slides, visuals, fonts)).unionByName(_diagram(bare, F.lit(101), fonts))


def note_texts(slides: DataFrame) -> DataFrame:
    """(paper_id, slide_id, notes): the seven labelled blocks of a slide's notes."""
    # Labels of the blocks.
    blocks = (("Purpose", "notes_purpose"), ("Main Message", "notes_message"), ("Speaking Script", "notes_script"), ("Visual Guidance", "notes_guidance"), ("Transition", "notes_transition"))
    shown = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in blocks]
    time = F.concat(F.lit("Estimated Time: "), F.coalesce(F.col("notes_seconds").cast("string"), F.lit("")), F.lit(" seconds"))
    sources = F.concat(F.lit("Sources: "), F.array_join(F.coalesce("citations", F.array().cast("array<string>")), "; "))
    return slides.select(*KEYS, F.concat_ws("\n\n", *shown, time, sources).alias("notes"))
