"""Re-use of finished work: fingerprints of inputs, build steps, and what a step must leave behind.

Tables of runs are joined by sorting: files of ids are small beside the rows that they hold, and going by that size Spark would gather all runs in the driver to broadcast them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that results depend on: steps in order, and the files that each leaves.
STEPS = ("parse", "understand", "plan", "spec", "render", "qa", "package")
EXPECTED = {
    "parse": ("source_manifest.json", "paper_structure.json", "visual_manifest.json"),
    "understand": ("scientific_understanding.json", "evidence_graph.json"),
    "plan": ("presentation_plan.full.json", "presentation_plan.json"),
    "spec": ("slide_spec.json",),
    "render": ("presentation.pptx",),
    "qa": ("quality_report.json",),
    "package": (),
}

#: Files that a step leaves only under an option of its run: (step, file, option).
CONDITIONAL = tuple((step, name, option) for step in ("qa", "package") for name, option in (("presentation.pdf", "render_qa"), ("semantic_qa.json", "semantic_qa")))


def steps_frame(spark) -> DataFrame:
    """(pos, step, artifact, option): what steps leave; option is null for what they always leave."""
    every = [(s, a, None) for s in STEPS for a in EXPECTED[s]] + list(CONDITIONAL)
    rows = [F.struct(F.lit(STEPS.index(s)).alias("pos"), F.lit(s).alias("step"), F.lit(a).alias("artifact"), F.lit(o).cast("string").alias("option")) for s, a, o in every]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def missing_artifacts(runs: DataFrame, files: DataFrame) -> DataFrame:
    """runs(run_id) against files(run_id, artifact): (run_id, step, artifact) that a step should have left and did not. Runs may have columns render_qa and semantic_qa; where one is true, the files of that option count too."""
    on = F.array_compact(F.array(*[F.when(F.col(o), F.lit(o)) for o in ("render_qa", "semantic_qa") if o in runs.columns])) if {"render_qa", "semantic_qa"} & set(runs.columns) else F.array().cast("array<string>")
    asked = runs.select("run_id", on.alias("options")).groupBy("run_id").agg(F.array_distinct(F.flatten(F.collect_list("options"))).alias("options"))
    want = asked.join(F.broadcast(steps_frame(runs.sparkSession)), F.col("option").isNull() | F.array_contains("options", F.col("option")))
    return want.join(files.select("run_id", "artifact").hint("merge"), ["run_id", "artifact"], "left_anti").select("run_id", "step", "artifact")


def to_do(steps: DataFrame, missing: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a build still has to do: (run_id, step, pos, action).

    steps(run_id, step, status, fingerprint) as left by the last build, wanted(run_id, fingerprint) as it should be now. A step is skipped if it was
    completed under the same fingerprint and its files are there, and so is every step before it.
    """
    spark = steps.sparkSession
    every = wanted.join(F.broadcast(spark.range(1).select(F.posexplode(F.array(*map(F.lit, STEPS))).alias("pos", "step"))), F.lit(True))
    s = every.join(steps.withColumnRenamed("fingerprint", "old").hint("merge"), ["run_id", "step"], "left").join(missing.select("run_id", "step").distinct().withColumn("lost", F.lit(True)).hint("merge"), ["run_id", "step"], "left")
    ok = F.coalesce((F.col("status") == "completed") & (F.col("old") == F.col("fingerprint")) & F.col("lost").isNull(), F.lit(False))
    so_far = F.min(ok.cast("int")).over(Window.partitionBy("run_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return s.select("run_id", "step", "pos", F.when(so_far == 1, "skip").otherwise("run").alias("action"))


def resumed(steps: DataFrame, missing: DataFrame, resume_from: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, problems) of builds that resume_from(run_id, resume_from) lets start anew at a step: the ones before count as completed, that step and those
    behind it as pending. A step before that lacks files, as missing_artifacts finds them, is a problem (run_id, step, artifact) and the build must not start."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("step"))
    start = resume_from.select("run_id", F.array_position(F.array(*map(F.lit, STEPS)), F.col("resume_from")).alias("start")).where("start > 0")
    lost = missing.join(start.hint("merge"), "run_id").where(place < F.col("start")).select("run_id", "step", "artifact")
    status = F.when(F.col("start").isNull(), F.col("status")).when(place < F.col("start"), "completed").otherwise("pending")
    return steps.join(start.hint("merge"), "run_id", "left").withColumn("status", status).select(*steps.columns), lost


def directory_fingerprint(files: DataFrame, by: str = "run_id") -> DataFrame:
    """files(run_id, path, content) -> one digest of names and contents, independent of the order in which files are listed."""
    f = files.select(by, F.concat("path", F.lit("\0"), F.sha2("content", 256), F.lit("\0")).alias("x"), "path")
    return f.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "x"))), lambda y: y["x"]), ""), 256).alias("fingerprint"))
