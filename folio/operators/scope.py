"""Whether a semantic draft stays within its deck: order and evidence of its evaluations, the slides it names, and what slides depend on, directly and through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Steps a chain of prerequisites may have; a deck has fewer slides.
MAX_DEPTH = 500


def _row(df: DataFrame, rule: str, slide, detail) -> DataFrame:
    return df.select("paper_id", F.lit(rule).alias("rule"), slide.alias("slide_id"), detail.alias("detail"))


def scope_problems(slides: DataFrame, evaluations: DataFrame, dependencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper_id, rule, slide_id, detail) of what makes a draft unusable.

    slides(paper_id, slide_id, order, evidence_ids), evaluations(paper_id, pos, slide_id, evidence_ids), dependencies(paper_id, slide_id, prerequisite_slide_ids), nodes(paper_id, id).

    evaluation_order: the evaluations are not the slides in their order; a row for each place where they differ, detail 'expected/actual' with nothing for what is not there.
    foreign_evidence: an evaluation names evidence that its slide does not cite, or that no node has; detail lists it sorted. unknown_prerequisite: a slide that the deck does not have.
    Papers with slides and no evaluations, or the reverse, differ at every place. Null ids and null lists name nothing.
    """
    place = lambda df, by, name: df.select("paper_id", F.col("slide_id").alias(name), F.row_number().over(Window.partitionBy("paper_id").orderBy(by, "slide_id")).alias("at"))
    both = place(slides, "order", "expected").join(place(evaluations, "pos", "actual"), ["paper_id", "at"], "full").where("NOT (expected <=> actual)")
    order = _row(both, "evaluation_order", F.coalesce("actual", "expected"), F.concat_ws("/", F.coalesce("expected", F.lit("")), F.coalesce("actual", F.lit(""))))
    named = evaluations.select("paper_id", "slide_id", F.explode(F.array_distinct("evidence_ids")).alias("id")).where("id IS NOT NULL")
    cited = slides.select("paper_id", "slide_id", F.explode("evidence_ids").alias("id")).distinct().withColumn("cited", F.lit(True))
    known = nodes.select("paper_id", "id").distinct().withColumn("known", F.lit(True))
    foreign = named.join(cited, ["paper_id", "slide_id", "id"], "left").join(known, ["paper_id", "id"], "left").where("cited IS NULL OR known IS NULL")
    foreign = foreign.groupBy("paper_id", "slide_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids"))
    strange = needs(dependencies).join(slides.select("paper_id", F.col("slide_id").alias("needs")), ["paper_id", "needs"], "left_anti").groupBy("paper_id", "slide_id").agg(F.array_join(F.array_sort(F.collect_set("needs")), ", ").alias("ids"))
    return order.unionByName(_row(foreign, "foreign_evidence", F.col("slide_id"), F.col("ids"))).unionByName(_row(strange, "unknown_prerequisite", F.col("slide_id"), F.col("ids")))


def needs(dependencies: DataFrame) -> DataFrame:
    """(paper_id, slide_id, needs): the edges of the dependency graph, each once."""
    return dependencies.select("paper_id", "slide_id", F.explode("prerequisite_slide_ids").alias("needs")).where("slide_id IS NOT NULL AND needs IS NOT NULL").distinct()


def closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(paper_id, slide_id, needs, depth): all that a slide depends on, directly (depth 1) or through others, with the length of the shortest chain.

    Each round joins what was new in the last with the edges and keeps what is not there yet; it ends when nothing is new, which the length of the longest shortest chain bounds.
    Rounds are stored, so neither lineage nor a retry grows. A chain of more than max_depth steps is an error.
    """
    edges = stored(edges.select("paper_id", "slide_id", "needs").distinct(), "needs")
    all_of = new = stored(edges.withColumn("depth", F.lit(1)), "needs-1")
    step = edges.select("paper_id", F.col("slide_id").alias("needs"), F.col("needs").alias("further"))
    for depth in range(2, max_depth + 1):
        onward = new.join(step, ["paper_id", "needs"]).select("paper_id", "slide_id", F.col("further").alias("needs")).distinct()
        new = stored(onward.join(all_of, ["paper_id", "slide_id", "needs"], "left_anti").withColumn("depth", F.lit(depth)), f"needs-{depth}")
        if new.isEmpty():
            return all_of
        all_of = all_of.unionByName(new)
    raise ValueError(f"closure: chains of more than {max_depth} steps")


def cycles(closed: DataFrame) -> DataFrame:
    """(paper_id, slide_id, members): slides that depend on themselves, with all slides of their circle, sorted. closed: as closure() gives it."""
    back = closed.select("paper_id", F.col("slide_id").alias("needs"), F.col("needs").alias("slide_id"))
    mutual = closed.join(back, ["paper_id", "slide_id", "needs"])  # each needs the other: one circle
    return mutual.groupBy("paper_id", "slide_id").agg(F.array_sort(F.collect_set("needs")).alias("members"))


def late_prerequisites(closed: DataFrame, slides: DataFrame) -> DataFrame:
    """(paper_id, slide_id, needs, depth): what a slide depends on and comes with it or after it. slides(paper_id, slide_id, order)."""
    at = slides.select("paper_id", "slide_id", F.col("order").alias("at"))
    met = closed.join(at, ["paper_id", "slide_id"]).join(at.select("paper_id", F.col("slide_id").alias("needs"), F.col("at").alias("needs_at")), ["paper_id", "needs"])
    return met.where("needs_at >= at").select("paper_id", "slide_id", "needs", "depth")
