"""Gates that a slide specification must pass before it is drawn: one row for each violation.

  units(paper_id, unit_id, order, question, main_claim, evidence_ids ARRAY<STRING>, seconds)
  slides(paper_id, slide_id, unit_id, order, title, question, main_claim, body ARRAY<STRING>, takeaway, purpose, evidence_ids ARRAY<STRING>, layout,
         notes_message, notes_purpose, notes_script, notes_guidance, notes_transition, notes_seconds)
  visuals(paper_id, slide_id, kind, source_ref, treatment, role, column_labels ARRAY<STRING>)
  known(paper_id, kind, source_ref, columns): what visuals may refer to; columns of a table, null where it has no editable data
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fields that must hold Chinese words where the language profile is Chinese first.
CHINESE_FIELDS = ("purpose", "question", "title", "main_claim", "takeaway", "notes_purpose", "notes_message", "notes_script", "notes_guidance", "notes_transition")


def _rows(df: DataFrame, rule, detail: Column) -> DataFrame:
    return df.select("paper_id", (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), "slide_id", detail.cast("string").alias("detail"))


def locked_fields(units: DataFrame, slides: DataFrame) -> DataFrame:
    """Slides that are not the plan's units in order, and fields that differ from their unit's: question, claim, evidence (as a set), notes' message and time."""
    u = units.select("paper_id", "order", *[F.col(c).alias(f"u_{c}") for c in ("unit_id", "question", "main_claim", "evidence_ids", "seconds")])
    s = slides.join(u, ["paper_id", "order"], "full")
    same = s.where(F.col("unit_id") == F.col("u_unit_id"))
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    differ = lambda a, b: ~a.eqNullSafe(b)  # noqa: E731  a null against a value differs too
    rules = (("question", differ(F.col("question"), F.col("u_question"))), ("main_claim", differ(F.col("main_claim"), F.col("u_main_claim"))), ("evidence_ids", differ(as_set("evidence_ids"), as_set("u_evidence_ids"))), ("notes_message", differ(F.col("notes_message"), F.col("main_claim"))), ("notes_seconds", differ(F.col("notes_seconds"), F.col("u_seconds"))))
    broken = same.withColumn("broken", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))))
    moved = s.where("NOT (unit_id <=> u_unit_id)")
    return _rows(broken, F.col("broken"), F.col("unit_id")).unionByName(_rows(moved, "unit_order", F.coalesce("u_unit_id", F.lit("none"))))


def language_violations(slides: DataFrame) -> DataFrame:
    """Fields without a Chinese word, each line of the body too. For decks of the Chinese-first profile."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in CHINESE_FIELDS]
    body = F.transform("body", lambda x, i: F.struct(F.concat(F.lit("body["), i.cast("string"), F.lit("]")).alias("field"), x.alias("value")))
    each = slides.select("paper_id", "slide_id", F.explode(F.concat(F.array(*fields), body)).alias("f"))
    return _rows(each.where(~T.contains_cjk(F.col("f.value"))), "not_chinese", F.col("f.field"))


def visual_sources(slides: DataFrame, visuals: DataFrame, known: DataFrame) -> DataFrame:
    """Visuals of unknown sources, labels that do not match a table's columns or a table without editable data, and full-visual layouts without a visual."""
    v = visuals.join(known.withColumn("is_known", F.lit(True)), ["paper_id", "kind", "source_ref"], "left")
    labelled = v.where("is_known AND kind = 'source_table' AND column_labels IS NOT NULL")
    bare = slides.where("layout = 'full_visual'").join(visuals.select("paper_id", "slide_id").distinct(), ["paper_id", "slide_id"], "left_anti")
    parts = (
        _rows(v.where("is_known IS NULL"), "unknown_visual", F.concat_ws("/", "kind", "source_ref")),
        _rows(labelled.where("columns IS NULL"), "labels_without_table", F.col("source_ref")),
        _rows(labelled.where("size(column_labels) <> columns"), "column_labels", F.concat_ws("/", F.size("column_labels"), "columns")),
        _rows(bare, "full_visual", F.lit("no visual")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spec_violations(units: DataFrame, slides: DataFrame, visuals: DataFrame, known: DataFrame, chinese_first: bool = True) -> DataFrame:
    """All gates: (paper_id, rule, slide_id, detail)."""
    from .qa import authoring_violations

    out = locked_fields(units, slides).unionByName(visual_sources(slides, visuals, known)).unionByName(authoring_violations(slides, visuals))
    return out.unionByName(language_violations(slides)) if chinese_first else out
