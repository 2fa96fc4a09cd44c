"""Re-use along the chain of a build's steps: a step's digest folds in those of the steps it builds on, so a change of any input reaches exactly what hangs on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What each step builds on. The order is one in which every step comes behind those.
DEPENDS = {
    "parse": (),
    "understand": ("parse",),
    "plan": ("understand",),
    "spec": ("plan", "understand"),
    "render": ("spec", "parse"),
    "semantic": ("spec", "plan", "understand"),
    "qa": ("render", "semantic"),
}


def chain_digests(parts: DataFrame, depends: dict[str, tuple[str, ...]] = DEPENDS) -> DataFrame:
    """(run_id, step, digest) for every step of every run.

    parts(run_id, step, part, digest): a step's own inputs by name: files, options such as mode, budget or theme, what names a provider. A step's digest is that of its name, of its own parts in the order
    of their names, and of the digests of the steps it builds on; a step without own parts has those. A part named twice counts with the smaller digest and the larger one.
    Null digests count as such, and differ from empty ones; parts of steps that the chain does not have are left out. Parts are grouped once, by run, so those that lie by run already are not shuffled.
    """
    known = parts.where(F.col("step").isin(*depends) & F.col("run_id").isNotNull())
    part = F.struct("step", F.to_json(F.struct("part", "digest"), {"ignoreNullFields": "false"}).alias("said"))
    runs = known.groupBy("run_id").agg(F.collect_list(part).alias("parts"))
    of = lambda step: F.array_sort(F.transform(F.filter("parts", lambda x: x["step"] == step), lambda x: x["said"]))
    runs = runs.select("run_id", *[of(step).alias(f"own_{step}") for step in depends])
    folded = runs
    for step, before in depends.items():  # a column a step, each from those before
        own = F.when(F.size(f"own_{step}") > 0, F.sha2(F.array_join(f"own_{step}", "\n"), 256)).otherwise("")
        said = F.concat_ws("\0", F.lit(step), own, *[F.col(f"_{b}") for b in before])
        folded = folded.withColumn(f"_{step}", F.sha2(said, 256))
    each = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"_{s}").alias("digest")) for s in depends])
    return folded.select("run_id", F.inline(each))


def reuse_plan(now: DataFrame, last: DataFrame) -> DataFrame:
    """(run_id, step, digest, action): 'reuse' where the last build has the step under the same digest, 'compute' elsewhere. Of a step that the last builds have under several digests any will do.

    Both are met by run alone: digests as chain_digests leaves them lie by run, so they are not shuffled again."""
    had = last.where("run_id IS NOT NULL AND step IS NOT NULL AND digest IS NOT NULL").groupBy("run_id").agg(F.collect_set(F.struct("step", "digest")).alias("had"))
    again = F.coalesce(F.array_contains("had", F.struct("step", "digest")), F.lit(False))
    return now.join(had, "run_id", "left").select("run_id", "step", "digest", F.when(again, "reuse").otherwise("compute").alias("action"))


def refreshed(plan: DataFrame, step: str, last_rows: DataFrame, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a step for all runs of a plan: those of the last build where they can be re-used, computed from inputs for the others alone.

    last_rows and what compute returns have a run_id and the same columns; inputs has a run_id. Nothing of a run that is re-used enters compute, so its cost follows what changed.
    """
    mine = plan.where(F.col("step") == step)
    kept = last_rows.join(mine.where("action = 'reuse'").select("run_id"), "run_id", "left_semi")
    made = compute(inputs.join(mine.where("action = 'compute'").select("run_id"), "run_id", "left_semi"))
    return kept.unionByName(made)


def manifests(plan: DataFrame, version: str) -> DataFrame:
    """(name, content) of a manifest a run and step, for sinks.staged.write_files: which digest its result stands for."""
    body = F.to_json(F.struct(F.lit(version).alias("version"), F.col("run_id").cast("string").alias("run_id"), "step", F.col("digest").alias("input_fingerprint")))
    return plan.select(F.concat_ws(".", F.col("run_id").cast("string"), "step", F.lit("manifest.json")).alias("name"), F.encode(body, "utf-8").alias("content"))
