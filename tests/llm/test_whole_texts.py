"""Operators 5 and 9: labelled texts are learned whole, however long; operator 9 learns from all of them, however many."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from folio.llm import quality_classifier, toxicity
from folio.llm.common import sample_hash, whole_examples


def far_behind(spark, n=160):
    """Documents of over 20,000 code points of harmless words; what makes half of them toxic or bad comes last."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(4200)]
        marked = i % 2
        w += (["blockhead"] if marked else ["iota"]) + ["kappa"] * 3
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(not marked), marked))
    assert all(r[1].index("kappa") > 20_000 for r in rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_far_behind_are_learned(spark):
    docs, labels = far_behind(spark)
    learn = F.col("doc_id") < 120
    model = toxicity.learn_toxicity(docs.where(learn), labels.where(learn))
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id").where(~learn).toPandas()
    assert ((out["score"] >= 0.5) == (out["toxic"] == 1)).all()


def test_bad_words_far_behind_are_learned(spark):
    docs, labels = far_behind(spark)
    learn = F.col("doc_id") < 120
    out = quality_classifier.score_quality(docs, quality_classifier.learn_quality(docs.where(learn), labels.where(learn))).join(labels, "doc_id").where(~learn).toPandas()
    good = out["quality"] == 1
    assert out[good]["score"].min() > out[~good]["score"].max()


def test_size_bound_takes_whole_documents(spark):
    sample = spark.createDataFrame([(i, i % 2, 10 + i, b"x" * (10 + i)) for i in range(40)], "doc_id long, y int, n long, ids binary")
    for most, least in ((1, 1), (100, 2), (10_000, 20)):
        got = whole_examples(sample, "y", "n", most, "s")
        for y in (0, 1):
            of = [r for r in got if r["y"] == y]
            assert len(of) >= least and all(len(r["ids"]) == r["n"] for r in of) and (len(of) == 1 or sum(r["n"] for r in of) <= most)


def test_toxic_words_of_every_document_are_learned(spark):
    """6,000 toxic documents, more than one sample of 5,000; those whose ids have the largest tenth of hashes hold an insult that no other has."""
    rng = random.Random(8)
    tail = spark.range(7500).withColumnRenamed("id", "doc_id").select("doc_id", (sample_hash("toxic").cast("double") >= 0.9 * 2.0**63).alias("tail"))
    rows, labels = [], []
    for r in tail.collect():
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(8)]
        toxic = int(r["doc_id"] % 5 > 0)
        w[rng.randrange(8)] = ("nitwit" if r["tail"] else "blockhead") if toxic else "iota"
        rows.append((r["doc_id"], " ".join(w), "en"))
        labels.append((r["doc_id"], toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.learn_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    probes = spark.createDataFrame([(1, "alpha nitwit beta"), (2, "gamma blockhead delta"), (3, "alpha beta iota"), (4, "eta")], "doc_id long, text string")
    out = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(probes, model).collect()}
    assert min(out[1], out[2]) >= 0.5 > max(out[3], out[4])


def test_word_counts_and_thresholds_match_loops(spark, monkeypatch):
    """Counts over several shards, with repeated ids, unknown languages and ids without labels or texts, equal those of one loop."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 16)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("Alpha, beta beta gammas gammat deltas".split()) for _ in range(rng.randrange(9))), rng.choice(["de", "en", "fr", None])) for i in range(120)]
    docs = spark.createDataFrame([*rows, *rows[20:25], (200, None, "de")], "doc_id long, text string, lang string")
    labels = [(i, i % 3 % 2) for i in range(10, 130)] + [(200, 1)]
    cal = {r[0] for r in spark.range(300).where(F.crc32(F.concat(F.lit("cal"), F.col("id").cast("string"))) % 5 == 0).collect()}
    examples = toxicity.shards(docs, spark.createDataFrame(labels, "doc_id long, y int"))
    assert examples.count() > 3 and sum(len(r["y"]) for r in examples.collect()) == 110
    words, with_it = Counter(), Counter()
    y, buckets = dict(labels), toxicity.Buckets()
    for i, text, lang in rows[10:]:
        if i not in cal:
            k, (ids,) = {"de": 0, "en": 1, "fr": 2, None: -1}[lang], buckets.of([text])
            words.update((int(b), k) for b in ids[:, 0])
            with_it.update((int(b), k, y[i]) for b in set(ids.reshape(-1).tolist()))
    got = toxicity.word_counts(examples, ["de", "en"]).collect()
    assert {(r["bucket"], r["lang"]): r["words"] for r in got if r["words"]} == words
    assert {(r["bucket"], r["lang"], k): r[c] for r in got for k, c in enumerate(("clean", "toxic")) if r[c]} == with_it
    step, toxic, clean = np.array([5, -3, 9, 0]), np.array([4, 1, 3, 1]), np.array([1, 6, 0, 7])
    f1 = {t: 2 * toxic[step >= t].sum() / (toxic[step >= t].sum() + clean[step >= t].sum() + toxic.sum()) for t in step}
    assert max(f1, key=f1.get) == 5 and 1 <= toxicity.ToxicModel.best(step, toxic, clean) * toxicity.GRID <= 5


def test_shards_change_the_network_by_their_mean(spark, monkeypatch):
    """What a round adds to a parameter is the mean over the shards that change it, and does not depend on how shards meet in tasks."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 16)
    rng = random.Random(10)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("alpha beta gamma delta nitwit".split()) for _ in range(6)), None) for i in range(60)], "doc_id long, text string, lang string")
    examples = toxicity.shards(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int"))
    new = lambda: toxicity.ToxicCnn(np.zeros(toxicity.BUCKETS, np.float32), np.arange(toxicity.BUCKETS) > 0)
    before, changes = new().state().astype(float), []
    for ids, y, _, cal in toxicity.unpacked(examples.toArrow().to_batches()):
        net, fit = new(), np.flatnonzero(~cal)
        net.train([ids[i] for i in fit], y[fit], 2, 1, (24, 24))
        changes.append(net.state() - before)
    changed = np.array([(np.abs(c) * toxicity.UNITS >= 0.5).any(axis=1) for c in changes]).sum(axis=0)
    want = before + sum(changes) / np.maximum(1, changed)[:, None]
    states = []
    for parts in (1, 3):
        net = new()
        toxicity.train_round(examples.repartition(parts), net, 2, 1, (24, 24))
        states.append(net.state())
    assert len(changes) > 1 and np.allclose(states[0], want, atol=1e-5) and (states[0] == states[1]).all()
    assert toxicity.learn_toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")) is not None
