"""Every registered query against its SQL on the smallest tables, and the entry points without the corpus subpackage."""

import importlib
import sys
from collections import Counter

import duckdb
import pytest

from folio.plans.registry import ORACLES, QUERIES
from folio.streaming.ingest import new_or_changed, windowed_counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    want = Counter(tuple(map(plain, r)) for r in db.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_corpus_subpackage(monkeypatch):
    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.split(".")[:2] == ["folio", "llm"] or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    for m in [m for m in sys.modules if m.startswith("folio.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(QUERIES) == set(e.oracle_sql())
    sys.modules.pop("__spark_entry__")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        assert Counter(map(tuple, spark.table("counts").collect())) == Counter(map(tuple, windowed_counts(events).collect()))
    finally:
        q.stop()
    q = new_or_changed(stream, "user_id", "event_type", late="365 days").writeStream.outputMode("append").format("memory").queryName("fresh").start()
    try:
        q.processAllAvailable()
        assert spark.table("fresh").count() == events.select("user_id", "event_type").distinct().count()
    finally:
        q.stop()
