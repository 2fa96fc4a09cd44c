"""Where the parts of a slide go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that results depend on: x, y, w, h in inches on a 13.333 x 7.5 canvas.
SHARED = {"title": (0.72, 0.56, 11.9, 0.75), "content": (0.72, 1.55, 11.9, 4.55), "takeaway": (0.72, 6.43, 11.9, 0.55), "citation": (0.72, 7.08, 11.9, 0.2)}
LAYOUTS = {
    "visual_left_text_right": {"visual": (0.72, 1.6, 7.15, 4.45), "text": (8.25, 1.72, 4.2, 4.05)},
    "text_left_visual_right": {"text": (0.72, 1.72, 4.2, 4.05), "visual": (5.3, 1.6, 7.32, 4.45)},
    "full_visual": {"text": (8.9, 5.1, 3.25, 0.7), "visual": (0.72, 1.48, 11.9, 4.68)},
    "equation_focus": {"visual": (1.25, 1.75, 10.83, 1.85), "text": (1.25, 3.95, 10.83, 1.85)},
    "table_focus": {"visual": (1.05, 1.7, 11.23, 3.15), "text": (1.05, 5.05, 11.23, 0.9)},
    "comparison": {"visual": (6.82, 1.65, 5.8, 4.35), "text": (0.72, 1.65, 5.65, 4.35)},
    "process": {"visual": (0.9, 2.0, 11.53, 2.8), "text": (1.25, 4.95, 10.83, 1.05)},
    "minimal_text": {"visual": (0.72, 1.65, 11.9, 2.0), "text": (1.3, 2.0, 10.75, 3.55)},
}


def layout_boxes(spark: SparkSession) -> DataFrame:
    """(layout, part, x, y, w, h)."""
    rows = [F.struct(F.lit(k).alias("layout"), F.lit(p).alias("part"), *[F.lit(v).alias(n) for n, v in zip("xywh", b, strict=True)]) for k, own in LAYOUTS.items() for p, b in {**SHARED, **own}.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("b")).select("b.*")
