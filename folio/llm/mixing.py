"""Operator 3: mix sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most so many times its words.
MAX_EPOCHS = 3
#: Rows of a range of the range sort, about; there are at least as many ranges as shuffle partitions.
RANGE_ROWS = 500_000


def _rows(id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What the mix is made of: source as a key without nulls that sorts as code points, null last; a hash-random key of the document, the same
    in every run, MD5 of the id and then a hash of the text; and its words."""
    skey = F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1"))
    key = F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))
    return [skey.alias("skey"), F.struct(key.alias("id"), F.xxhash64(text_col).alias("text")).alias("key"), n_words(F.col(text_col)).alias("size")]


def running(rows: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """rows with a column for each of `sums`: its sum over the group's rows that come before in the order. Ties stand in any order.

    A range sort by group and order makes bounded ranges, a hot group being many of them; the ranges' totals give each
    its offset (a row for each range and group in it), and sums run within ranges. The ranges are stored, so that a retry finds the same ones.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    placed = stored(rows.repartitionByRange(n, *group, *order).withColumn("range", F.spark_partition_id()), name)
    totals = placed.groupBy(*group, "range").agg(*[F.sum(x).alias(f"of_{c}") for c, x in sums.items()])
    before = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "range", *[F.coalesce(F.sum(f"of_{c}").over(before), F.lit(0)).alias(f"of_{c}") for c in sums])
    within = Window.partitionBy(*group, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(totals, [*group, "range"])
    return out.select(*rows.columns, *[(F.col(f"of_{c}") + F.coalesce(F.sum(x).over(within), F.lit(0))).alias(c) for c, x in sums.items()])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size) -> (skey, source_size, target): shares by weight, capped at max_epochs sizes, excess reshared.

    Sorted by size per weight, the capped sources are a prefix, so running sums find the level at which the rest
    share; that is the fixed point of resharing until no source is above its cap. Sums are distributed; a few totals are all the driver sees.
    """
    s = running(sizes, [], ["skey"], {"rank": F.lit(1)}, "mix-ranks")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.select("skey", "source_size", w.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")).withColumn("fill", F.col("cap") / F.col("weight"))
    s = stored(running(s, [], ["fill", "skey"], {"low": F.col("cap"), "light": F.col("weight")}, "mix-levels"), "mix-fill")
    total, weight = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    capped = F.col("fill") < (total - F.col("low")).cast("double") / (weight - F.col("light"))
    low, light = s.where(capped).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level = float(total - low) / (weight - light) if weight > light else 0.0
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return s.select("skey", "source_size", F.least(target, F.col("cap").cast("double")).alias("target"))


def budgets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, size) -> one row per source: source_size, target, epochs and rest. The mix takes every document `epochs` times and then, in the order of keys,
    documents of `rest` words once more."""
    targets = source_targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    budget = F.floor("target").cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    return stored(targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "mix-budgets")


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes: (id, source, size, source_size, target, taken).

    Ids, sources, sizes and keys are stored, the texts are read once. A source's documents lie in the order of their hash-random keys; distributed prefix sums give the
    words before each, and the source's budget cuts them: the document at the cut counts in part, so a source's words meet its target to the word.

    Nulls: null text has size 0, a null source is a source of its own and sorts last, a null id has the smallest key.
    Rows that repeat an id are ordered by a hash of the text; those that repeat both are alike, and it does not matter which of them comes first.
    An empty table gives no rows. Other columns of docs do not matter, whatever their names. Of a very long text only the number of its words goes on.
    """
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_rows(id_col, text_col, source_col)), "mix-sizes")
    cuts = budgets(sized, weights, max_epochs)
    placed = running(sized, ["skey"], ["key"], {"before": F.col("size")}, "mix-order")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.join(cuts, "skey").select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents themselves, with docs' columns; a document taken k times comes k times.

    The order and the budgets are those of plan_mix; what the documents themselves are joined with is one row a source, the key at its cut, so texts are not shuffled.
    Documents stay whole: the one at a source's cut is taken if at least half of it fits; rows that repeat its id and text share its fate. Documents without words
    come once. Nulls, repeats and empty tables as in plan_mix; clashing column names survive.
    """
    sized = stored(docs.select(*_rows(id_col, text_col, source_col)), "mix-sizes")
    cuts = budgets(sized, weights, max_epochs)
    placed = running(sized, ["skey"], ["key"], {"before": F.col("size")}, "mix-order").join(cuts.select("skey", "rest"), "skey")
    tied = placed.groupBy("skey", "key").agg(F.sum("size").alias("words"), F.min("before").alias("before"), F.first("rest").alias("rest"))
    cut = tied.where("before <= rest AND rest < before + words").select("skey", F.col("key").alias("cut"), (2 * (F.col("rest") - F.col("before")) >= F.col("words")).alias("fits"))
    cuts = stored(cuts.select("skey", "epochs").join(cut, "skey", "left"), "mix-cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_rows(id_col, text_col, source_col))
    extra = F.when(F.col("key") < F.col("cut"), 1).when((F.col("key") == F.col("cut")) & F.col("fits"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("epochs") + extra).otherwise(1).cast("int")
    return rows.join(cuts, "skey").withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS skey, md5(CAST(doc_id AS VARCHAR)) AS k,
                  CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size, source FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
             CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap / weight < level AS capped FROM l),
t AS (SELECT skey, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE),
             CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) / (all_weight - sum(CASE WHEN capped THEN weight ELSE 0 END) OVER ()) * weight) END AS target FROM c),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, b.source_size, b.target, b.epochs, CAST(floor(target) AS BIGINT) - epochs * b.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN b USING (skey))
SELECT doc_id, source, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""
