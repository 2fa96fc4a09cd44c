"""Telling rows apart by their ids without moving their texts, however many ids there are."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import common, near_dedup
from tests.llm.test_near import sets_of, union_find


def docs(spark, n=4000):
    rows = [(i, f"text {i}") for i in range(n)] + [(None, "no id"), (None, "none"), (5, "again"), (6, "again")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("id_bits", [64, 2])
def test_without_is_exact_at_any_density(spark, monkeypatch, id_bits):
    monkeypatch.setattr(common, "ID_BITS", id_bits)
    monkeypatch.setattr(common, "MOST_BITS", 15 if id_bits == 64 else 12)
    d, gone = docs(spark), set(random.Random(1).sample(range(4000), 2500)) | {10**9}
    ids = spark.createDataFrame([(i,) for i in gone], "doc_id long")
    want = sorted(r["text"] for r in d.collect() if r["doc_id"] is None or r["doc_id"] not in gone)
    for most in (0, 40, 10**6):
        assert sorted(r["text"] for r in common.without(d, ids, most).collect()) == want
    assert common.without(d, ids.limit(0), 0).count() == d.count() and common.without(d.limit(0), ids, 0).isEmpty()


def test_maybe_among_loses_none(spark):
    d, ids = docs(spark), spark.createDataFrame([(i,) for i in range(0, 4000, 7)], "doc_id long")
    got = {r["doc_id"] for r in common.maybe_among(d, ids, 572).collect()}
    assert set(range(0, 4000, 7)) <= got and len(got) < 800 and None not in got


def test_texts_stay_where_they_are(spark):
    d = docs(spark)
    ids = common.stored(d.where("doc_id % 3 = 0").select("doc_id").distinct(), "t")
    plan = common.without(d.where(F.length("text") > 0), ids, 0)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line and "RoundRobin" not in line]
    assert moved == [] and "BroadcastExchange" in plan


def classes(texts, k):
    sets = {i: sets_of(t, k) for i, t in texts.items()}
    return union_find(sets, [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])


def test_near_duplicates_with_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_BROADCAST", 0)
    monkeypatch.setattr(corpus_pipeline, "MOST_BROADCAST", 0)
    rng, texts = random.Random(9), {}
    for size in (20, 60, 200):
        for _ in range(6):
            base = [f"w{rng.randrange(400)}" for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, size // 20))):
                    copy[rng.randrange(size)] = f"w{rng.randrange(400)}"
                texts[len(texts)] = " ".join(copy)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(d, k=5, percent=80).collect()}
    want = classes(texts, 5)
    assert got == want and len(set(want.values())) < len(want)
    full = d.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").alias("n_chars"))
    twice = full.unionByName(full.where("doc_id % 5 = 0").withColumn("lang", F.lit("de")))
    kept = corpus_pipeline.near_dedup(spark, twice, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values())) and all(r["lang"] == ("de" if r["doc_id"] % 5 == 0 else "en") for r in kept)
