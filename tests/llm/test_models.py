"""Operators 5, 8 and 9: held-out accuracy, brute-force parsing, and odd inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_data import SF

from folio.llm import language_id, quality_classifier, queries, toxicity
from folio.llm.common import remainder


def brute_phrases(codes, sample):
    s, t, i, n = bytes(codes), bytes(sample), 0, 0
    while i < len(s):
        k = 1
        while i + k <= len(s) and s[i : i + k] in t:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


def test_cross_parsing_matches_brute_force():
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randrange(1, 7)))
    texts = {"x": [" ".join(word("abcde") for _ in range(60)) for _ in range(3)], "y": [" ".join(word("cdefg") for _ in range(60)) for _ in range(3)]}
    p = language_id.CrossParser(texts)
    probes = [" ".join(word(a) for _ in range(n)) for a in ("abcde", "cdefg", "abzé") for n in (1, 3, 50, 400)]
    coded = [p.alphabet.encode(t) for t in probes]
    got = p.phrases(coded)
    for k, lang in enumerate(p.langs):
        sample = np.concatenate([np.append(p.alphabet.encode(t), np.uint8(0)) for t in texts[lang]])
        for t, row in zip(coded, got, strict=True):
            assert row[k] == brute_phrases(t, sample)
    assert p.guess(["", None, "12 !?", "ab"])[0][:3] == ["und"] * 3


def test_alphabet_folds_and_collapses():
    a = language_id.Alphabet("abcé")
    assert a.encode("  Ab,, C\n É9z ").tolist() == [3, 4, 0, 5, 0, 6, 0, 1]
    assert a.encode("").tolist() == [] and a.encode("1 2").tolist() == []


def test_languages_of_held_out_documents(spark):
    out = queries.QUERIES["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"]]
    assert len(out) == 200 and len(held) > 40 and (held["lang_pred"] == held["lang"]).mean() > 0.95 and out["score"].between(0, 1).all()


ODD = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "1234 !!", "en"), (5, "日本語", None), (6, "the " * 30000, "en"), (7, "퟿\u0000x", "en"), (7, "again", "de"), (None, "text", "fr")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, "a", "b", 0.5) for r in ODD], "doc_id long, text string, lang string, row string, text2 string, score double")


def test_odd_inputs(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = language_id.identify_language(odd, language_id.learn_languages(odd.limit(0))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and len(none) == len(ODD)
    some = language_id.identify_language(odd, language_id.learn_languages(odd)).collect()
    assert [r["lang_pred"] for r in some][:4] == ["und"] * 4 and all(r["lang_pred"] in ("de", "en", "fr") for r in some[4:])
    q = quality_classifier.score_quality(odd, quality_classifier.learn_quality(odd, labels)).collect()
    t = toxicity.score_toxicity(odd, toxicity.learn_toxicity(odd, labels)).collect()
    assert len(q) == len(t) == len(ODD) and all(0 <= r["score"] <= 1 for r in [*q, *t]) and q[0]["score"] == q[1]["score"] == 0
    kept = language_id.identify_language(odd, language_id.learn_languages(odd), keep=odd.columns)
    assert kept.select("row.*").columns == odd.columns
    for f in (lambda d: quality_classifier.score_quality(d, quality_classifier.learn_quality(d, labels)), lambda d: toxicity.score_toxicity(d, None)):
        assert f(odd.limit(0)).count() == 0


def made_up(spark):
    """Bad documents hold odd words, toxic ones an insult somewhere; three of ten are bad, one of four is toxic."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + rng.choice(["", "s", "n"]) for _ in range(rng.randrange(20, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.25
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["blockhead", "blockheads", "Nitwit,", "nitwits"])
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_learn(spark):
    docs, labels = made_up(spark)
    learn = remainder(F.col("doc_id"), 5) != 0
    q = quality_classifier.score_quality(docs, quality_classifier.learn_quality(docs.where(learn), labels.where(learn))).withColumnRenamed("score", "q")
    t = toxicity.score_toxicity(docs, toxicity.learn_toxicity(docs.where(learn), labels.where(learn))).withColumnRenamed("score", "t")
    out = q.join(t, "doc_id").join(labels, "doc_id").where(~learn).toPandas()
    assert ((out["q"] >= 0.3) == (out["quality"] == 1)).mean() > 0.97
    assert ((out["t"] >= 0.5) == (out["toxic"] == 1)).mean() > 0.93


def test_cnn_gradient_step_lowers_the_loss():
    rng = np.random.default_rng(0)
    texts = [rng.integers(1, 50, (rng.integers(3, 30), 3)) for _ in range(64)]
    y = np.array([int(7 in t[:, 0]) for t in texts])
    net = toxicity.ToxicCnn(np.zeros(toxicity.BUCKETS, np.float32), np.arange(toxicity.BUCKETS) > 0)
    loss = lambda: np.log1p(np.exp(-(2 * y - 1) * net.logits(texts))).mean()
    before = loss()
    net.train(texts, y, epochs=3)
    assert loss() < 0.5 * before
    top, ids, where = net.pooled(texts, spots=True)
    assert np.allclose(top, net.pooled(texts)[0], atol=1e-5)
