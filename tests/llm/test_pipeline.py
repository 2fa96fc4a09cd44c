"""The pipeline's stages, each against brute force on what its predecessor kept."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_near import sets_of, union_find
from tests_data import SF
from tokenizers import Tokenizer

from folio.llm.common import stored
from folio.llm.packing import default_tokenizer


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "12 !!", "en", None, 5), (9003, docs.first()["text"], None, "src0", 5)], docs.schema)
    kept = [stored(docs.unionByName(odd), "test")]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), f"test-{name}"))
    return kept


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_rejects_texts_without_letters(stages):
    gone = {r["doc_id"] for r in stages[0].select("doc_id").subtract(stages[1].select("doc_id")).collect()}
    assert gone == {9001, 9002}
    assert stages[1].where("lang IS NULL").count() == 0


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = {(r["quality"], r["kept"]): r["count"] for r in stages[1].join(labels, "doc_id").join(stages[2].select("doc_id", F.lit(True).alias("kept")), "doc_id", "left").groupBy("quality", "kept").count().collect()}
    assert n[(1, True)] >= 0.98 * (n[(1, True)] + n.get((1, None), 0)) and n.get((0, None), 0) >= 0.5 * (n.get((0, None), 0) + n.get((0, True), 0))


def test_one_of_each_group_stays(stages):
    sets = {r["doc_id"]: sets_of(r["text"], 5) for r in stages[2].collect()}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {i for i, c in union_find(sets, links).items() if i == c}
    assert {r["doc_id"] for r in stages[3].collect()} == want and links


def test_mix_and_packing(stages):
    times = {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()}
    assert set(times) <= {r["doc_id"] for r in stages[3].collect()} and max(times.values()) <= 3
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in stages[4].collect())
    assert stages[5].agg(F.sum("length")).first()[0] == want


def test_run_on_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_further_columns_nulls_and_repeats(spark):
    """Columns whose names clash with those that operators use inside, null ids and repeated rows go through all stages; the order of rows does not matter."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "r", r["doc_id"] % 7, 0.5, [1]) for r in some]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in rows if r[0] in good and r[2] == "en" and r[4] > 400][:2]
    rows += [(*rows[3][:5], "q", 9, 0.1, [2]), rows[4], (None, clean[0][1] + " " + clean[1][1], None, None, None, None, None, None, None), (9005, None, None, None, None, "x", None, None, None)]
    spec = "doc_id long, text string, lang string, source string, n_chars long, row string, key long, score double, copies array<int>"
    out = []
    for given in (rows, rows[::-1]):
        docs = spark.createDataFrame(given, spec)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, SF), f"test-more-{name}")
            assert docs.columns == [c.split()[0] for c in spec.split(", ")]
        packed = corpus_pipeline.packing(spark, docs, SF)
        assert packed.where("doc_id = 9005").isEmpty()
        out.append((sorted(map(str, docs.collect())), packed.agg(F.sum("length")).first()[0]))
    assert out[0] == out[1] and any("doc_id=None" in r for r in out[0][0])
