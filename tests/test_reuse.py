"""Digests along the chain of steps, and recomputing exactly what hangs on a change."""

from pyspark.sql import functions as F

from folio.operators import reuse
from folio.sinks.staged import write_files

PARTS = [("r", "parse", "a.tex", "1"), ("r", "parse", "b.pdf", "2"), ("r", "understand", "provider", "p"), ("r", "plan", "budget", "600"), ("r", "spec", "theme", "t"), ("r", "render", "theme", "t"), ("r", "semantic", "provider", "s"), ("r", "qa", "version", "1")]
SCHEMA = "run_id string, step string, part string, digest string"


def changed(spark, *changes):
    """The steps whose digests differ once parts have other digests."""
    now = [(r, s, p, dict(changes).get((s, p), d)) for r, s, p, d in PARTS]
    old, new = ({x["step"]: x["digest"] for x in reuse.chain_digests(spark.createDataFrame(rows, SCHEMA)).collect()} for rows in (PARTS, now))
    return {s for s in old if old[s] != new[s]}


def test_a_change_reaches_what_hangs_on_it(spark):
    assert changed(spark) == set()
    assert changed(spark, (("parse", "a.tex"), "9")) == set(reuse.DEPENDS)
    assert changed(spark, (("plan", "budget"), "300")) == {"plan", "spec", "render", "semantic", "qa"}
    assert changed(spark, (("render", "theme"), "u")) == {"render", "qa"}
    assert changed(spark, (("semantic", "provider"), None)) == {"semantic", "qa"}
    assert changed(spark, (("qa", "version"), "")) == {"qa"}


def test_digests_do_not_hang_on_order_or_place(spark):
    rows = lambda xs: sorted(map(tuple, reuse.chain_digests(spark.createDataFrame(xs, SCHEMA).repartition(3)).collect()))
    assert rows(PARTS) == rows(PARTS[::-1]) and len({d for _, _, d in rows(PARTS)}) == len(reuse.DEPENDS)
    other = rows([("q", *p[1:]) for p in PARTS] + [("q", "unheard", "of", "1"), (None, "parse", "x", "1")])
    assert [d for _, _, d in other] == [d for _, _, d in rows(PARTS)]
    assert rows([("r", "parse", "ab", "c")]) != rows([("r", "parse", "a", "bc")])
    assert reuse.chain_digests(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_only_misses_are_computed(spark, tmp_path):
    last = reuse.chain_digests(spark.createDataFrame([(r, *p[1:]) for r in ("a", "b") for p in PARTS], SCHEMA))
    now = reuse.chain_digests(spark.createDataFrame([(r, s, p, "9" if (r, s) == ("b", "plan") else d) for r in ("a", "b", "c") for _, s, p, d in PARTS], SCHEMA))
    plan = reuse.reuse_plan(now, last)
    compute = plan.where("action = 'compute'").groupBy("run_id").count().collect()
    assert dict(compute) == {"b": 5, "c": 7}
    seen = spark.sparkContext.accumulator(0)

    def work(df):
        def count(frames):
            for f in frames:
                seen.add(len(f))
                yield f.assign(value="new")

        return df.mapInPandas(count, "run_id string, value string")

    inputs = spark.createDataFrame([(x,) for x in "abc"], "run_id string")
    old = spark.createDataFrame([("a", "old"), ("b", "old")], "run_id string, value string")
    assert sorted(map(tuple, reuse.refreshed(plan, "plan", old, inputs, work).collect())) == [("a", "old"), ("b", "new"), ("c", "new")] and seen.value == 2
    assert sorted(map(tuple, reuse.refreshed(plan, "parse", old, inputs, work).collect())) == [("a", "old"), ("b", "old"), ("c", "new")]
    write_files(reuse.manifests(plan.where("step = 'qa'"), "1"), str(tmp_path))
    written = spark.read.text(str(tmp_path), recursiveFileLookup=True).select(F.get_json_object("value", "$.run_id")).collect()
    assert sorted(r[0] for r in written) == ["a", "b", "c"]


def test_parts_that_lie_by_run_are_not_shuffled_again(spark):
    """Each build's parts are shuffled once, by run; neither steps nor the digests of the two builds are."""
    now, last = (spark.createDataFrame([(r, *p[1:3], d) for r in ("a", "b") for p in PARTS], SCHEMA).repartition("run_id") for d in "12")
    plan = reuse.reuse_plan(reuse.chain_digests(now), reuse.chain_digests(last))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert {tuple(r) for r in plan.groupBy("run_id", "action").count().collect()} == {("a", "compute", 7), ("b", "compute", 7)}
    twice = spark.createDataFrame([("b", "qa", "1"), ("b", "qa", "1"), ("b", "qa", None)], "run_id string, step string, digest string")
    had = spark.createDataFrame([("b", "qa", "0"), ("b", "qa", "1"), ("b", "qa", "1"), ("b", None, "1"), (None, "qa", "1")], twice.schema)
    assert sorted(r["action"] for r in reuse.reuse_plan(twice, had).collect()) == ["compute", "reuse", "reuse"]
