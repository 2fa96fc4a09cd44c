"""States of builds: the expression against the plain rules, the stream against the table."""

import random
from datetime import datetime, timedelta

import pytest

from folio.streaming import builds as B

SCHEMA = "run_id long, at timestamp, seq long, event string, step int, fingerprint string"
T = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def events(seed=3, n=1500, runs=25):
    rng = random.Random(seed)
    at, out = T, []
    for k in range(n):
        at += timedelta(seconds=rng.randrange(0, 400))
        out.append((rng.randrange(runs), at, k, rng.choices([*B.EVENTS, "unheard of"], [10, 40, 40, 6, 4, 2])[0], rng.choice([None] * 9 + [0, 1, 2, 7, -1]), rng.choice(["f"] * 12 + ["g", None])))
    return out


def folded(rows, patience, horizon=None):
    horizon = horizon or max(r[1] for r in rows)
    state = {}
    for run, at, _, event, step, fp in sorted(rows, key=lambda r: (r[1], r[2])):
        state[run] = B.advance(state.get(run, B.start()), {"at": at, "event": event, "step": step, "fingerprint": fp}, patience)
    return {run: tuple(B.waited(s, horizon, patience).values()) for run, s in state.items()}


def table(df):
    return {r["run_id"]: (r["fingerprint"], r["done"], r["phase"], r["rejected"], r["abandoned"], r["at"]) for r in df.collect()}


@pytest.mark.parametrize("hours", [1, 5, 1000])
def test_expression_follows_the_rules(spark, hours):
    rows = events()
    got = table(B.build_states(spark.createDataFrame(rows, SCHEMA).repartition(3), timedelta(hours=hours)))
    want = folded(rows, timedelta(hours=hours))
    assert got == want and max(s[1] for s in want.values()) >= 3 and (hours == 1000) == (max(s[4] for s in want.values()) == 0)


def test_a_build_from_start_to_end(spark):
    rows = [(1, T, 0, "submitted", None, "f")]
    for k in range(B.N):
        rows += [(1, T + (k + 1) * HOUR, 2 * k + 1, "started", k, None), (1, T + (k + 1) * HOUR, 2 * k + 2, "completed", k, None)]
    df = lambda more: B.build_states(spark.createDataFrame(rows + more, SCHEMA), HOUR).select("done", "step", "status", "rejected").first()
    late = T + 20 * HOUR
    assert tuple(df([])) == (7, None, "completed", 0)
    assert tuple(df([(1, late, 50, "started", None, None)])) == (7, None, "completed", 1)
    assert tuple(df([(1, late, 50, "files_lost", 4, None)])) == (4, "render", "pending", 0)
    assert tuple(df([(1, late, 50, "submitted", None, "g")])) == (0, "parse", "pending", 0)
    assert tuple(df([(1, late, 50, "started", 2, None), (1, late, 51, "failed", 2, None)])) == (2, "plan", "failed", 0)
    assert tuple(df([(1, late, 50, "started", 2, None), (2, late + 2 * HOUR, 51, "failed", 2, None)]).asDict().values()) in {(2, "plan", "failed", 0), (0, "parse", "unknown", 1)}


def test_nothing_and_nulls(spark):
    assert B.build_states(spark.createDataFrame([], SCHEMA), HOUR).isEmpty()
    assert B.build_states(spark.createDataFrame([(None, T, 0, "started", 0, "f"), (1, None, 0, "started", 0, "f"), (1, T, 0, None, 0, "f")], SCHEMA), HOUR).isEmpty()


def test_stream_agrees_with_table(spark, tmp_path):
    rows, patience = events(n=600, runs=8), timedelta(hours=2)
    rows.append((99, rows[-1][1] + timedelta(hours=9), 10**6, "submitted", None, "f"))  # moves the watermark past all timers
    for k in range(3):
        spark.createDataFrame(rows[k * 201 : (k + 1) * 201], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {}

    def keep(df, _):
        for r in df.collect():
            got[r["run_id"]] = tuple(r[c] for c in ("fingerprint", "done", "phase", "rejected", "abandoned", "at"))

    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = B.build_states_stream(stream, patience).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
    finally:
        spark.conf.unset(key)
    assert got == table(B.build_states(spark.createDataFrame(rows, SCHEMA), patience))
