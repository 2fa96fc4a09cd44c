"""Helpers shared by the corpus operators: sessions, cut lineage, words, bounded samples, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .textbatch import tidy

#: Word pattern of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII white-space characters, as used with translate().
SPACES = "\t\n\x0b\x0c\r "
#: Bytes of an Arrow batch between the JVM and Python.
ARROW_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a new local one only where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.mkdtemp(prefix="folio-"), "shared")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage ends there and column pruning still works.

    The folder is named after the application, so that whoever ends the application can remove it.
    """
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/folio-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return spark.read.schema(df.schema).parquet(to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow over batches of at most ARROW_BYTES, or one row: Arrow's buffers in the JVM and in Python are of that size, not of 10,000 texts.

    The session's bound is lowered if it is higher, and stays so, since the plan runs later."""
    spark = rows.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, "67108864")).lower().removesuffix("b")) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))
    return rows.mapInArrow(tidy(f), schema)


def n_words(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, m: int) -> Column:
    """crc32 of doc_id as text, modulo m; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % m, F.lit(0)).cast("int")


#: Rows of a table of counts, one a group, up to which it is broadcast.
MOST_GROUPS = 100_000


#: A key that holds more than one in so many of all rows counts as hot, so there are never more hot keys than that.
HOT_KEYS = 100_000
#: And it holds so many rows at least.
HOT_ROWS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str) -> DataFrame:
    """rows joined with groups, stored: one row a key, with the number of rows that hold it in column n, which goes.

    Hot keys are joined by broadcast: a key is hot if it holds more than 1 / HOT_KEYS of the rows counted in groups, so HOT_KEYS rows are the most there can be. All other keys hold
    so few rows that a plain join has no large task.
    """
    most = max(HOT_ROWS, (groups.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    hot = groups.where(F.col(n) > most).drop(n)
    cold = groups.where(F.col(n) <= most).drop(n)
    if hot.isEmpty():
        return rows.join(cold, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def sample_hash(salt: str) -> Column:
    """A hash of doc_id from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), 1)


def sample_ids(rows: DataFrame, by: str, k: int, salt: str) -> DataFrame:
    """(by, doc_id): at most k ids of each group, those with the smallest hash; an id counts once, however many rows repeat it.

    Ids are counted first (HyperLogLog, combined on the map side), and only those below a hash that lets about twice k through go on; so what
    meets in one task of a group is some times k rows, whatever the group's size and the number of tasks. Null groups and ids have no part.
    """
    rows = rows.select(by, "doc_id").where(F.col(by).isNotNull() & F.col("doc_id").isNotNull())
    want, span = 2.0 * k + 64, float(1 << 63)
    n = F.approx_count_distinct("doc_id", 0.03)
    limits = stored(rows.groupBy(by).agg(F.when(n > want, want / n * span).otherwise(2 * span).alias("limit")), "sample-limits")
    limits = F.broadcast(limits) if limits.count() <= MOST_GROUPS else limits
    below = rows.withColumn("hash", sample_hash(salt)).join(limits, by).where(F.col("hash").cast("double") < F.col("limit"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("hash", "doc_id"))
    return below.select(by, "doc_id", "hash").distinct().withColumn("rank", rank).where(F.col("rank") <= k).select(by, "doc_id")


def sample_rows(docs: DataFrame, ids: DataFrame, on: list[str], cols: list[str]) -> DataFrame:
    """ids' columns with those of one row of docs for each id, that with the smallest hash of `cols`. ids: a sample of bounded size, which is broadcast."""
    picked = docs.select(*on, *cols).join(F.broadcast(ids), on).groupBy(*ids.columns).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("row"))
    return picked.select(*ids.columns, "row.*")


def whole_examples(sample: DataFrame, by: str, size: str, most: int, salt: str) -> list[Row]:
    """Rows of a stored sample of bounded size, one an id, brought to the driver a partition at a time: of each group, in the order of the ids' hashes, every one that
    still fits so that their sizes add up to `most`, and the smallest if none does. Documents come whole or not at all."""
    left: dict = {}
    chosen = []
    sizes = sample.select(by, "doc_id", size, sample_hash(salt).alias("hash")).collect()
    for r in sorted(sizes, key=lambda r: (r["hash"], r["doc_id"])):
        if r[size] <= left.setdefault(r[by], most):
            left[r[by]] -= r[size]
            chosen.append((r[by], r["doc_id"]))
    for group in {r[by] for r in sizes} - {g for g, _ in chosen}:
        chosen.append(min((r[size], group, r["doc_id"]) for r in sizes if r[by] == group)[1:])
    if not chosen:
        return []
    groups, ids = zip(*chosen, strict=True)
    picked = sample.sparkSession.createDataFrame(pa.table({by: list(groups), "doc_id": list(ids)}))  # a table becomes a plan without Python workers
    return list(sample.join(F.broadcast(picked), [by, "doc_id"], "left_semi").toLocalIterator())


#: Bits for each id of a set, and of a whole set at most, 2**MOST_BITS: 32 MB.
ID_BITS, MOST_BITS = 64, 28
#: Levels of bits with which rows are told apart before what is left is joined.
LEVELS = 4


def id_bits(ids: DataFrame, n: int, salt: int) -> tuple[DataFrame, int]:
    """A set of n ids as a table of blocks of bits, 2**MOST_BITS of them at most, and the exponent of their number. Made by Spark with map-side combining; small enough to broadcast by that bound."""
    bits = min(MOST_BITS, max(15, (n * ID_BITS).bit_length()))
    at = _bit(F.col("doc_id"), bits, salt)
    blocks = ids.select(F.bitmap_bucket_number(at).alias("block"), F.bitmap_bit_position(at).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return stored(blocks, "id-bits"), bits


def _bit(doc_id: Column, bits: int, salt: int) -> Column:
    """The place of an id, from 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), doc_id), 64 - bits) + 1


def with_hit(rows: DataFrame, blocks: DataFrame, bits: int, salt: int, name: str) -> DataFrame:
    """rows with a column that is true where doc_id may be in the set, false where it is not. One look-up in a broadcast table of blocks; rows are not moved."""
    at = _bit(F.col("doc_id"), bits, salt)
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(blocks.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), F.bitmap_bucket_number(at) == F.col("__block"), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.col("doc_id").isNotNull() & (F.getbit(byte, (place % 8).cast("int")) == 1), F.lit(False)).alias(name))


def maybe_among(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows whose doc_id is among n distinct ids, and a few others: what of them has to be looked at, found without moving any."""
    blocks, bits = id_bits(ids, n, 0)
    return with_hit(rows, blocks, bits, 0, "__hit").where("__hit").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """rows whose doc_id is not among the distinct, stored ids. Rows with a null id stay.

    Up to `most` ids are broadcast. Beyond, bits of them are: a row that misses stays. Of those that hit, some are there by chance; these are found among the ids alone (which are small), and are told apart by
    bits of their own, and so on in turn; once `most` ids at most are left in doubt these decide. Other columns of rows are not shuffled while that succeeds within LEVELS, which it does up to some
    2**MOST_BITS / 8 ids; what is still in doubt then is joined.
    """
    n = ids.count()
    if n <= most:
        return rows.join(F.broadcast(ids), "doc_id", "left_anti").select(*rows.columns)
    everyone = stored(rows.select("doc_id").where("doc_id IS NOT NULL").distinct().join(ids.withColumn("__gone", F.lit(True)), "doc_id", "left").select("doc_id", F.col("__gone").isNotNull().alias("gone")), "ids-all")
    doubt, marked, stays = everyone, rows, F.lit(None).cast("boolean")
    for level in range(LEVELS):
        inside = level % 2 == 0  # bits of ids that go, then of those that stay, in turn
        members = stored(doubt.where(F.col("gone") == inside).select("doc_id"), "ids-in")
        blocks, bits = id_bits(members, members.count(), level)
        name = f"__hit{level}"
        marked = with_hit(marked, blocks, bits, level, name)
        stays = F.when(stays.isNull() & ~F.col(name), F.lit(inside)).otherwise(stays)
        doubt = stored(with_hit(doubt, blocks, bits, level, "__hit").where("__hit").select("doc_id", "gone"), "ids-doubt")
        others = stored(doubt.where(F.col("gone") != inside).select("doc_id"), "ids-chance")
        if others.count() <= most:  # all in doubt are members, but for these
            by_chance = F.broadcast(others.withColumn("__chance", F.lit(True)))
            marked = marked.withColumn("__stays", stays).join(by_chance, "doc_id", "left")
            kept = F.coalesce("__stays", F.when(F.col("__chance"), F.lit(inside)).otherwise(F.lit(not inside)))
            return marked.where(kept).select(*rows.columns)
    marked = marked.withColumn("__stays", stays)
    return marked.where("__stays").select(*rows.columns).unionByName(marked.where("__stays IS NULL").join(ids, "doc_id", "left_anti").select(*rows.columns))


def components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (a, b) long pairs -> (node, component), component = smallest node.

    Alternating large-star and small-star (hash-min contraction): each round regroups edges by node with a map-side
    minimum, writes them to the shared folder, and ends when a round changes nothing. Nothing is collected but a
    count and a checksum. Nodes without an edge do not appear. Null ends and loops are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    e = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark = None
    for k in range(1, max_rounds + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node go to the node's minimum
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lower neighbours go to the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        e = stored(small, f"{name}-{k}")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components: no fixed point within {max_rounds} rounds")
    # at the fixed point every node points at the smallest node of its component
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
