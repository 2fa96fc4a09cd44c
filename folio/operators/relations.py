"""Generic checks and lookups over keyed tables: the relational core of the artifact rules."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text

#: Pairs of ids that are broadcast to fetch their texts; above that the texts are joined by a shuffle.
MOST_BROADCAST = 500_000


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(child: DataFrame, parent: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows of child whose key is not in parent; a null key dangles."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in pairs]).distinct()
    return child.join(keys, [c for c, _ in pairs], "left_anti")


def order_violations(df: DataFrame, group: str, order: str, start: int = 1) -> DataFrame:
    """Rows whose order is not their position in the group."""
    pos = F.row_number().over(Window.partitionBy(group).orderBy(order)) + (start - 1)
    return df.withColumn("expected", pos).where(F.col(order) != F.col("expected"))


def carry_forward(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value at or before each row of its group: the heading in force."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def section_parents(df: DataFrame, group: str, order: str, level: str, item: str, deepest: int = 6) -> DataFrame:
    """parent: the latest earlier section one level up, unless a shallower one came after it; null for a skipped level."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = [F.last(F.when(F.col(level) < k, F.struct(F.col(level).alias("level"), F.col(item).alias("item"))), ignorenulls=True).over(before) for k in range(1, deepest + 1)]
    above = F.coalesce(*[F.when(F.col(level) == k, a) for k, a in enumerate(at, 1)])
    return df.withColumn("__above", above).withColumn("parent", F.when(F.col("__above.level") == F.col(level) - 1, F.col("__above.item"))).drop("__above")


def previous_duplicate(df: DataFrame, key: Column, order: str, item: str, group: str | None = None) -> DataFrame:
    """(group, item, previous) of rows whose key occurred before, with the item that had it last. What is sorted is a 128-bit hash of the key and ids."""
    by = [] if group is None else [group]
    rows = df.where(key.isNotNull()).select(*by, F.col(order).alias("__order"), F.col(item).alias("__item"), F.md5(key.cast("string")).alias("__key"))
    w = Window.partitionBy(*by, "__key").orderBy("__order")
    return rows.withColumn("previous", F.lag("__item").over(w)).where("previous IS NOT NULL").select(*by, F.col("__item").alias(item), "previous")


def contained(excerpts: DataFrame, texts: DataFrame, words: int = 5) -> DataFrame:
    """(excerpt_id, source_id) where the normalised excerpt occurs in the normalised text. Inputs: (excerpt_id, excerpt), (source_id, text).

    An occurrence holds the excerpt's inner words as whole words: `words` of them, or all if there are fewer, as one hash, are an equi-join key against
    the texts' word windows of that length. An excerpt without inner words has the hash of its first three characters against the texts' runs of three. Ids alone are exploded
    and joined; the few candidate pairs then fetch their texts, by broadcast of the pairs while they are few, so texts are read twice but not shuffled.
    Only excerpts of under three characters, which nearly every text holds, are tried on each text.
    """
    e = excerpts.select("excerpt_id", normalize_text(F.col("excerpt")).alias("needle")).where(F.col("needle").isNotNull()).withColumn("w", F.split("needle", " "))
    e = e.withColumn("kind", F.when(F.size("w") >= 3, F.least(F.lit(words), F.size("w") - 2)).when(F.length("needle") >= 3, 0).otherwise(-1))
    inner = F.when(F.col("kind") > 0, F.array_join(F.slice("w", 2, F.greatest(F.lit(1), F.col("kind"))), " ")).otherwise(F.substring("needle", 1, 3))
    anchored = e.where("kind >= 0").select("excerpt_id", "kind", F.xxhash64("kind", inner).alias("anchor"))
    t = texts.select("source_id", normalize_text(F.col("text")).alias("hay")).where(F.col("hay").isNotNull())
    kinds = [r["kind"] for r in anchored.select("kind").distinct().collect()]  # at most words + 1 numbers

    def hashes(k: int) -> Column:
        """Of all runs of k words, or of 3 characters if k is 0."""
        n = F.size("w") - k if k else F.length("hay") - 3
        run = (lambda i: F.array_join(F.slice("w", i + 1, k), " ")) if k else (lambda i: F.substring("hay", i + 1, 3))
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.lit(k), run(i)))).otherwise(F.array().cast("array<bigint>"))

    keys = [hashes(k) for k in kinds]
    if keys:
        anchors = t.withColumn("w", F.split("hay", " ")).select("source_id", F.explode(F.array_distinct(F.concat(*keys))).alias("anchor"))
        pairs = anchors.join(anchored.select("excerpt_id", "anchor"), "anchor").select("excerpt_id", "source_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
        pairs = F.broadcast(pairs) if pairs.count() <= MOST_BROADCAST else pairs
        found = t.join(pairs, "source_id").join(e.select("excerpt_id", "needle"), "excerpt_id").where(F.col("hay").contains(F.col("needle"))).select("excerpt_id", "source_id")
    else:
        found = None
    tiny = e.where("kind < 0").select("excerpt_id", "needle")
    if found is not None and tiny.isEmpty():
        return found.distinct()
    tried = t.join(tiny, F.col("hay").contains(F.col("needle"))).select("excerpt_id", "source_id")
    return (found.unionByName(tried) if found is not None else tried).distinct()


def grounded(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """refs(source_id, excerpt, ...) against catalog(source_id, text): adds problem, null where the excerpt is in its source."""
    found = refs.join(catalog.select("source_id", normalize_text(F.col("text")).alias("__text")), "source_id", "left")
    return found.withColumn("problem", F.when(F.col("__text").isNull(), "unknown source").when(~F.col("__text").contains(normalize_text(F.col("excerpt"))), "excerpt not in source")).drop("__text")


def catalog(*kinds: tuple[str, DataFrame, Column, Column]) -> DataFrame:
    """(source_id, kind, text) of several tables, each given with its id and text; duplicate ids are for the caller to reject."""
    parts = [df.select(i.cast("string").alias("source_id"), F.lit(kind).alias("kind"), t.alias("text")) for kind, df, i, t in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def disagreeing(*tables: DataFrame, key: str = "paper_id") -> DataFrame:
    """One row (n) if the tables hold more than one value of key."""
    out = tables[0].select(key)
    for t in tables[1:]:
        out = out.unionByName(t.select(key))
    return out.agg(F.countDistinct(key).alias("n")).where("n > 1")


def first_hit(df: DataFrame, group: str, order: str, hit: Column) -> DataFrame:
    """The first row of each group that meets the condition."""
    return df.where(hit).withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("__n = 1").drop("__n")


def choose_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows de-duplicated by key: the last row's values at the first row's position."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, order).alias("__row"), F.min(order).alias("position")).select(key, "__row.*", "position").select(*df.columns, "position")


def merge_by_key(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Full join by key, each column from `preferred` if it is not null there, else from `other`."""
    cols = [c for c in preferred.columns if c != key]
    a, b = preferred.alias("a"), other.alias("b")
    return a.join(b, key, "full").select(key, *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in cols])


def changed(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, reuse): whether a row of new has the fingerprint that it had in old."""
    o = old.select(key, F.col(fingerprint).alias("__old"))
    return new.join(o, key, "left").select(key, F.coalesce(F.col(fingerprint) == F.col("__old"), F.lit(False)).alias("reuse"))
