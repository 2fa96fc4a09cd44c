"""Whether the semantic rules find faults: cases edit copies of drafts, the rules run on every copy, and what they find is held against what each case expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import documents as D
from . import qa, reports

#: Verdicts that an edit may set, and that of the order of dependencies, whose value is a JSON list of slides.
SETS = ("claim_evidence", "claim_strength")
REORDERS = "dependency_order"
#: What a configuration of a benchmark must be.
CONFIG = D.Object(
    {
        "schema_version": D.Text(("1.0",)),
        "papers": D.Items(D.Object({"paper_id": D.Text()}, open=True), 1, unique=("paper_id",)),
        "mutations": D.Items(D.Object({"case_id": D.Text(), "paper_id": D.Text(), "slide_id": D.Text(), "operation": D.Text(), "value": D.Anything(), "expected_code": D.Text()}), unique=("case_id",), maybe=True),
    }
)


def case_problems(cases: DataFrame, slides: DataFrame, evaluations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(case_id, problem) of cases that cannot be run: a paper or slide there is not, no dependency to reorder, or an operation that does not exist. The first of these counts."""
    slide = ["paper_id", "slide_id"]
    has = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    c = cases.join(has(slides, ["paper_id"], "paper"), "paper_id", "left").join(has(evaluations, slide, "judged"), slide, "left").join(has(dependencies, slide, "depends"), slide, "left")
    known = F.coalesce(F.col("operation").isin(*SETS, REORDERS), F.lit(False))
    problem = F.when(F.col("paper").isNull(), "unknown paper").when(F.col("judged").isNull(), "unknown slide").when(~known, "unsupported operation").when((F.col("operation") == REORDERS) & F.col("depends").isNull(), "no dependency")
    return c.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")


def mutants(cases: DataFrame, slides: DataFrame, evaluations: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(slides, evaluations, dependencies) of a copy of the paper for each case, its case_id in the place of the paper_id, with the case's edit made in it.

    cases(case_id, paper_id, slide_id, operation, value); dependencies with pos, which counts those of a slide: an edit changes the first. A paper is copied once for each of its cases, so the copies grow with cases times the size of a deck.
    """
    edit = cases.select("case_id", "paper_id", F.col("slide_id").alias("edited"), "operation", "value")

    def copied(df: DataFrame, **changed) -> DataFrame:
        both = edit.join(df, "paper_id")
        return both.select(F.col("case_id").alias("paper_id"), *[changed.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns if c != "paper_id"])

    here = F.col("slide_id") == F.col("edited")
    verdicts = {c: F.when(here & (F.col("operation") == c), F.col("value")).otherwise(F.col(c)) for c in SETS}
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("paper_id", "slide_id"))
    order = F.when(here & (F.col("operation") == REORDERS) & F.col("first"), F.from_json("value", "array<string>")).otherwise(F.col("prerequisite_slide_ids"))
    marked = dependencies.withColumn("first", first)
    return copied(slides), copied(evaluations, **verdicts), copied(marked, prerequisite_slide_ids=order).drop("first")


def run(cases: DataFrame, slides: DataFrame, evaluations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(case_id, expected, detected, unexpected, problem) for every case: whether the expected code was found, and how many others. Cases that cannot be run have a problem and nulls.

    cases(case_id, paper_id, slide_id, operation, value, expected); the tables as in qa.semantic, dependencies with pos.
    """
    bad = case_problems(cases, slides, evaluations, dependencies)
    good = cases.join(bad.select("case_id"), "case_id", "left_anti")
    found = qa.semantic(*mutants(good, slides, evaluations, dependencies)).select(F.col("paper_id").alias("case_id"), "code")
    done = reports.recall(good.select("case_id", "expected"), found).withColumn("problem", F.lit(None).cast("string"))
    left = cases.select("case_id", "expected").join(bad, "case_id").select("case_id", "expected", F.lit(None).cast("boolean").alias("detected"), F.lit(None).cast("int").alias("unexpected"), "problem")
    return done.unionByName(left)


def summary(outcomes: DataFrame, slides: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: papers, slides, findings without any edit, cases, cases detected, recall, and unexpected codes. outcomes: as run() gives them; baseline: qa.semantic of the drafts as they are."""
    one = slides.agg(F.countDistinct("paper_id").alias("paper_count"), F.count("*").alias("slide_count"))
    cases = outcomes.where("problem IS NULL").agg(F.count("*").alias("mutation_cases"), F.count_if("detected").alias("detected_cases"), F.coalesce(F.sum("unexpected"), F.lit(0)).alias("unexpected_finding_count"))
    rate = F.when(F.col("mutation_cases") > 0, F.col("detected_cases") / F.col("mutation_cases")).otherwise(0.0)
    return one.join(baseline.agg(F.count("*").alias("baseline_finding_count"))).join(cases).withColumn("detection_recall", rate)


def report(totals: DataFrame) -> DataFrame:
    """(name, content): the summary as JSON and as Markdown, for sinks.staged.write_files."""
    rows = (("Papers", "paper_count"), ("Human-reviewed slides", "slide_count"), ("Baseline semantic findings", "baseline_finding_count"))
    text = F.concat_ws("\n", F.lit("# Semantic QA Benchmark Report"), F.lit(""), *[F.concat(F.lit(f"- {k}: "), F.col(c).cast("string")) for k, c in rows], F.format_string("- Injected cases detected: %d/%d", "detected_cases", "mutation_cases"), F.format_string("- Detection recall: %.1f%%", F.col("detection_recall") * 100), F.format_string("- Unexpected findings: %d", "unexpected_finding_count"))
    both = F.array(F.struct(F.lit("semantic_benchmark.json").alias("name"), F.to_json(F.struct(*[F.col(c) for c in totals.columns])).alias("text")), F.struct(F.lit("semantic_benchmark.md").alias("name"), text.alias("text")))
    return totals.select(F.inline(both)).select("name", F.encode("text", "utf-8").alias("content"))
