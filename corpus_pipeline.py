"""A training corpus from `documents`: language, quality, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs. Stages keep null ids and
repeated rows apart as their docstrings say; an empty table stays empty; further columns of docs travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import maybe_among, remainder, stored, table, without
from folio.llm.language_id import identify_language, learn_languages
from folio.llm.mixing import mix
from folio.llm.near_dedup import MOST_BROADCAST, near_duplicates
from folio.llm.packing import default_tokenizer, pack
from folio.llm.quality_classifier import THRESHOLD, learn_quality, score_quality


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text or no letter, null texts too) go; a missing lang is filled with the guess. Rows that repeat are judged each, null ids stay.
    Where no row has a lang nothing can be learned: all go."""
    parser = learn_languages(docs.where(remainder(F.col("doc_id"), 3) != 1))
    judged = identify_language(docs, parser, keep=docs.columns).where("lang_pred <> 'und'")
    return judged.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the classifier's threshold go, null and wordless texts among them; a score at the threshold stays. Rows that repeat are judged each,
    null ids stay. Without labels all stay."""
    learn = remainder(F.col("doc_id"), 5) != 0
    labels = table(spark, sf_dir, "labels").where(learn)
    if labels.where("quality IS NOT NULL").isEmpty():
        return docs
    model = learn_quality(docs.where(learn), labels)
    return score_quality(docs, model, keep=docs.columns).where(F.col("score") >= THRESHOLD).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id; of rows that repeat an id, one: the smallest by text, source, lang and then by a hash
    of all columns. Rows with a null id stay, as do null and empty texts, which are like nothing.

    Texts are not shuffled for the ids that go: those are broadcast while they are few, and beyond that told apart by bits of theirs (see `without`).
    """
    gone = stored(near_duplicates(docs, k=5, percent=80).where("NOT kept").select("doc_id").distinct(), "pipeline-ids")
    left = without(docs, gone, MOST_BROADCAST)
    repeated = stored(left.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "pipeline-repeated")
    n = repeated.count()
    if not n:
        return left
    every = [F.to_json(F.struct(F.col(f"`{c}`"))) for c in sorted(docs.columns)]  # so that rows in whatever order give the same one
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "source", "lang", F.sha2(F.concat_ws("\n", *every), 256)))
    among = left.join(F.broadcast(repeated), "doc_id", "left_semi") if n <= MOST_BROADCAST else maybe_among(left, repeated, n).join(repeated, "doc_id", "left_semi")
    once = among.withColumn("__rank", first).where("__rank = 1").select(*docs.columns)
    return without(left, repeated, MOST_BROADCAST).unionByName(once)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, a null source being one; documents come whole, several times where a source repeats, those without words once.
    Rows that repeat id and text share one fate."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with a checksum for the token ids. Null texts are empty; null ids and rows that repeat are packed each."""
    return pack(docs, default_tokenizer()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Trained models, signatures and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
