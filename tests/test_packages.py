"""Slide packages: broken ones, slide size, native tables."""

import io
import zipfile

from pyspark.sql import functions as F

from folio.operators import qa
from folio.sources import files

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def package(size, *slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f"<p:presentation {NS}>{size}</p:presentation>")
        for k, body in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{k}.xml", f"<p:sld {NS}>{body}</p:sld>")
    return out.getvalue()


def test_package_findings(spark):
    wide = '<p:sldSz cx="12192000" cy="6858000"/>'
    given = {"good": package(wide, "<a:tbl/>", "", ""), "square": package('<p:sldSz cx="9" cy="9"/>', ""), "none": package(""), "torn": b"PK broken", "bad": package(wide, "<a:")}
    d = spark.createDataFrame(list(given.items()), "path string, content binary")
    got = {(r["paper_id"], r["code"]) for r in qa.package_findings(files.slide_packages(d).withColumnRenamed("path", "paper_id")).collect()}
    assert got == {("square", "INVALID_SLIDE_ASPECT"), ("none", "INVALID_SLIDE_ASPECT"), ("torn", "INVALID_PPTX_PACKAGE"), ("bad", "INVALID_PPTX_PACKAGE")}
    boxes = files.slide_boxes(d).select(F.col("path").alias("paper_id"), F.concat(F.lit("s"), "slide").alias("slide_id"), "has_table")
    visuals = spark.createDataFrame([("good", f"s{k}", kind) for k, kind in ((1, "source_table"), (2, "source_table"), (3, "source_asset"), (9, "source_table"))], "paper_id string, slide_id string, kind string")
    assert [(r["code"], r["slide_ids"]) for r in qa.missing_tables(boxes, visuals).collect()] == [("NATIVE_TABLE_MISSING", ["s2"])]
