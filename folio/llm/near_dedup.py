"""Operator 2: near-duplicate documents by SuperMinHash, banding, exact verification and components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, in_arrow, maybe_among, stored, table
from .textbatch import WordHashes, chunks, mix64, shingles, words

#: Signature: BANDS bands of ROWS values. A pair at the threshold shares no band with a chance of (1 - 0.8**4)**32 = 5e-8.
BANDS, ROWS = 32, 4
#: Least share of equal bits between two sketches: a pair at 0.8 has 0.9 on average with a deviation of 0.027, this is 5.3 deviations below.
LEAST_BITS = 97
#: Ids that are broadcast to pick their texts; above that the texts are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Documents of a part of a bucket, on average, and elements of the sets that are held against one hub in a group.
PART, VERIFIED = 512, 1 << 17
#: Documents of a tile on either side, on average, where components are held against each other.
TILE = 1024
_U = np.uint64


def super_minhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """SuperMinHash signatures, a row of m uint32 for each set of 64-bit hashes: step j in the upper 8 bits, 24 random bits below.

    Each element draws a random permutation of the m positions, one swap a step, and offers j + r at position j of it. A set is
    done when all its positions hold values below the step, since later offers can only be larger. Elements of
    many sets go through each step together. Empty sets get all ones.
    """
    out = np.full((len(sets), m), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    el, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    flat, perm = out.reshape(-1), None
    for j in range(m):
        if j:
            going = out.max(axis=1) >= np.uint32(j << 24)
            keep = going[of]
            if not keep.any():
                break
            if not keep.all():
                el, of, perm = el[keep], of[keep], perm[keep] if perm is not None else None
        with np.errstate(over="ignore"):
            x = mix64(el + _U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)).astype(np.intp)
        rows = np.arange(len(el))
        if j == 0:
            at, first = k, k
        else:
            if perm is None:  # the swap of step 0, made up for
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(el), 1))
                k0 = first[keep]
                perm[rows, k0], perm[:, 0] = 0, k0
            at = perm[rows, k].astype(np.intp)
            perm[rows, k] = perm[:, j]
        np.minimum.at(flat, of * m + at, (np.uint32(j << 24) | (x >> _U(40)).astype(np.uint32)))
    return out


def _signed(batches, k: int):
    cache = WordHashes()
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("s1", pa.int64()), ("s2", pa.int64())])
    for b, texts in chunks(batches, most_bytes=1 << 17):
        sets = [shingles(cache.of([w.lower() for w in words(t)]), k) for t in texts]
        sig = super_minhash(sets)
        banded = np.ascontiguousarray(sig.reshape(len(sets), BANDS, ROWS)).view(np.uint64).reshape(len(sets), BANDS, 2)
        with np.errstate(over="ignore"):
            keys = mix64(mix64(banded[:, :, 0] + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _U(0x9E3779B97F4A7C15)) ^ banded[:, :, 1]).view(np.int64)
        bits = np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)
        full = [len(s) > 0 for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s) if ok else None for s, ok in zip(sets, full, strict=True)], pa.binary()), pa.array([list(r) if ok else None for r, ok in zip(keys, full, strict=True)], pa.list_(pa.int64())), pa.array(bits[:, 0]), pa.array(bits[:, 1])], schema=schema)


def _sets(batches, k: int):
    cache = WordHashes()
    for b, texts in chunks(batches):
        sets = [shingles(cache.of([w.lower() for w in words(t)]), k).view(np.int64) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "els"])


def counted(rows: DataFrame, name: str) -> DataFrame:
    """rows of a few numbers each, stored, and marked for broadcast if there are MOST_BROADCAST at most; else a join shuffles both sides as plain exchanges, whose hot keys
    adaptive execution splits."""
    rows = stored(rows, name)
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST else rows


def _sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, els) of the documents with these ids, read again from their texts. Texts are not shuffled: with many ids, bits of them tell which texts to look at, and the sets of these are joined with the ids."""
    pick, schema = stored(ids.distinct(), "dedup-ids"), "doc_id long, els array<long>"
    n = pick.count()
    if n <= MOST_BROADCAST:
        return stored(in_arrow(docs.join(F.broadcast(pick), "doc_id", "left_semi"), lambda it: _sets(it, k), schema), "dedup-sets")
    sets = in_arrow(maybe_among(docs, pick, n), lambda it: _sets(it, k), schema)
    return stored(sets.join(pick, "doc_id", "left_semi"), "dedup-sets")


def _checked(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a hub's set (b null) and some members' sets: (a, b) of the members that are similar enough."""
    hub = p["b"].isna()
    hubs, out = [np.asarray(x, np.int64) for x in p["els"][hub]], []
    for b, x in zip(p["b"][~hub], p["els"][~hub], strict=True):
        x = np.asarray(x, np.int64)
        both = [len(np.intersect1d(h, x, assume_unique=True)) for h in hubs]
        if any(100 * i >= percent * (len(h) + len(x) - i) for h, i in zip(hubs, both, strict=True)):
            out.append((p["a"].iloc[0], b))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else pd.DataFrame({"a": [], "b": []}).astype("int64")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the (a, b) pairs, n the size of b's set, whose full sets are similar enough.

    A hub a is dealt out to as many groups as its members' sets need, so that a group holds VERIFIED elements or so; it gets the hub's set once, and a member's set travels
    once for each of its pairs."""
    pairs = stored(pairs.groupBy("a", "b").agg(F.max("n").alias("n")), "dedup-pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs, k)
    loads = counted(pairs.groupBy("a").agg(F.ceil(F.sum("n") / VERIFIED).cast("int").alias("parts")), "dedup-loads")
    dealt = stored(pairs.join(loads, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")), "dedup-dealt")
    members = dealt.join(sets.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "els")
    hubs = loads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "els")
    return stored(members.unionByName(hubs).groupBy("a", "part").applyInPandas(lambda p: _checked(p, percent), "a long, b long"), "dedup-links")


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, over the elements found on both sides, some thousands at a time."""
    ex, ey = np.concatenate(xs), np.concatenate(ys)
    common = np.intersect1d(ex, ey)
    out = np.zeros((len(xs), len(ys)), np.float32)

    def placed(e, sets):
        at = np.searchsorted(common, e)
        ok = at < len(common)
        ok[ok] = common[at[ok]] == e[ok]
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    if len(common):
        (rx, cx), (ry, cy) = placed(ex, xs), placed(ey, ys)
        for s in range(0, len(common), 4096):
            a, b = np.zeros((len(xs), 4096), np.float32), np.zeros((len(ys), 4096), np.float32)
            m, w = (cx >= s) & (cx < s + 4096), (cy >= s) & (cy < s + 4096)
            a[rx[m], cx[m] - s], b[ry[w], cy[w] - s] = 1, 1
            out += a @ b.T
    return out


def _allowed(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> np.ndarray:
    """Which rows of x and y lie in different components and may be similar enough, by sizes and sketches."""
    nx, ny = x["n"].to_numpy(np.int64), y["n"].to_numpy(np.int64)
    may = (x["c"].to_numpy()[:, None] != y["c"].to_numpy()[None, :]) & (100 * np.minimum(nx[:, None], ny[None, :]) >= percent * np.maximum(nx[:, None], ny[None, :]))
    other = np.zeros(may.shape, np.int64)
    for s in ("s1", "s2"):
        other += np.bitwise_count(x[s].to_numpy(np.int64).view(np.uint64)[:, None] ^ y[s].to_numpy(np.int64).view(np.uint64)[None, :])
    return may & (128 - other >= LEAST_BITS)


def _possible(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The rows of a tile that some row of its other side may be similar to."""
    x, y = p[p["side"] == 0], p[p["side"] == 1]
    may = _allowed(x, y, percent)
    return pd.concat([x[may.any(axis=1)], y[may.any(axis=0)]])


def _joining(p: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components in one tile, those that union-find needs: (a, b)."""
    x, y = p[p["side"] == 0], p[p["side"] == 1]
    none = pd.DataFrame({"a": [], "b": []}).astype("int64")
    if not len(x) or not len(y):
        return none
    nx, ny = x["n"].to_numpy(np.int64), y["n"].to_numpy(np.int64)
    may = _allowed(x, y, percent)
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        return none
    xs, ys = ([np.asarray(v, np.int64) for v in q["els"].iloc[at]] for q, at in ((x, rows), (y, cols)))
    if may.sum() <= 4 * (len(rows) + len(cols)):
        i, j = np.nonzero(may)
        back = {r: k for k, r in enumerate(rows)}, {c: k for k, c in enumerate(cols)}
        both = np.array([len(np.intersect1d(xs[back[0][a]], ys[back[1][b]], assume_unique=True)) for a, b in zip(i, j, strict=True)])
        ok = 100 * both >= percent * (nx[i] + ny[j] - both)
        i, j = i[ok], j[ok]
    else:
        both = _overlaps(xs, ys)
        hit = (100 * both >= percent * (nx[rows][:, None] + ny[cols][None, :] - both)) & may[np.ix_(rows, cols)]
        i, j = np.nonzero(hit)
        i, j = rows[i], cols[j]
    ids, other, cx, cy = x["nid"].to_numpy(), y["nid"].to_numpy(), x["c"].to_numpy(), y["c"].to_numpy()
    parent: dict[int, int] = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for a, b in zip(i, j, strict=True):
        u, v = find(int(cx[a])), find(int(cy[b]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((int(ids[a]), int(other[b])))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none


def _similar(x: str, y: str, percent: int):
    """Sizes and sketches allow the pair."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    bits = 128 - F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) - F.bit_count(F.col(f"{x}.s2").bitwiseXOR(F.col(f"{y}.s2")))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (bits >= LEAST_BITS)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of documents whose k-word shingle sets have a Jaccard similarity of percent/100 or more.

    1. Every text becomes a set of shingles, a SuperMinHash signature of 128 values in 32 bands, and a sketch of 128 bits.
    2. Documents with equal sets form a class (map-side combine); its smallest id stands for it from here on.
    3. Only buckets that several documents share go on. A document's weight is the sum of its buckets' sizes: that from which the others of a group
       were copied shares most bands with them. A bucket is split into parts of PART documents or so; in each the heaviest document is paired with
       the part's others, and the parts' heaviest with the heaviest of all: pairs grow linearly with a bucket.
       Pairs whose sizes or sketches rule the similarity out are dropped; full sets decide on the others, group by group of a heavy document's pairs.
    4. Links become components. Buckets with the same heaviest document form a neighbourhood; two documents that share a bucket share one of these. In each
       that still holds several components, every document outside the largest one is held against those of other components, in tiles
       of bounded size: sketches first; only documents that some other may be similar to by these come to the second round with their full sets. A tile returns links that join components, at most one a document, so pairs are never listed, and
       no candidate pair that could join two groups is left out. The components are formed anew.
    No bucket, group or list of links is ever collected. A pair at exactly the threshold is missed with a chance of about
    5e-8 by the bands and 1e-7 by the sketch.

    Null and wordless texts have no shingles and are linked with nothing. Rows that repeat an id count as one document with
    several texts; rows with a null id are not linked and have no component. An empty table gives no rows. Ties do not matter: a group is named by its smallest id, and
    of equally heavy documents of a bucket any may stand for it. A very long text is one set, held by one task at a time. Columns besides the two have no part, whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    feats = stored(in_arrow(docs, lambda it: _signed(it, k), "doc_id long, n long, digest binary, bands array<long>, s1 long, s2 long"), "dedup-features")
    classes = feats.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    of_copies = feats.join(counted(classes.where("copies > 1").select("digest", "rep"), "dedup-copies"), "digest", "left")
    members = stored(of_copies.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "dedup-members")
    reps = of_copies.where("digest IS NOT NULL AND doc_id IS NOT NULL AND (rep IS NULL OR rep = doc_id)").select(F.struct(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), "s1", "s2").alias("d"), "bands")
    # an id with several texts: what one of them is a copy of is linked to the others
    several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    own = members.where("doc_id <> rep").join(counted(several, "dedup-several"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    banded = reps.select("d", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(banded.join(counted(sizes, "dedup-sizes"), "bucket"), "dedup-buckets")
    weights = shared.groupBy(F.col("d.id").alias("id")).agg(F.sum("size").alias("weight"))
    part = shared.withColumn("id", F.col("d.id")).join(weights, "id").select("bucket", "d", "weight", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PART)).cast("int").alias("salt"))
    heaviest = lambda *by: F.first("d").over(Window.partitionBy(*by).orderBy(F.desc("weight"), "d.id"))
    part = stored(part.withColumn("p", heaviest("bucket", "salt")), "dedup-parts")
    tops = part.where("d.id = p.id").withColumn("p", heaviest("bucket"))
    stars = part.select("d", "p").unionByName(tops.select("d", "p")).where("d.id <> p.id").where(_similar("d", "p", percent))
    texts = docs.where("doc_id IS NOT NULL")
    links = _verified(stars.select(F.col("p.id").alias("a"), F.col("d.id").alias("b"), F.col("d.n").alias("n")), texts, k, percent)
    comp = stored(components(links.unionByName(own), "dedup-cc1"), "dedup-comp1")

    of = counted(tops.where("d.id = p.id").select("bucket", F.col("p.id").alias("g")), "dedup-tops")
    near = shared.join(of, "bucket").select("g", F.col("d.id").alias("nid"), "d").dropDuplicates(["g", "nid"])
    near = near.join(comp.select(F.col("node").alias("nid"), "component"), "nid", "left").select("g", "nid", "d", F.coalesce("component", "nid").alias("c"))
    near = stored(near, "dedup-near")
    groups = near.groupBy("g", "c").agg(F.count("*").alias("m")).groupBy("g").agg(F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("n"), F.count("*").alias("cs")).where("cs > 1")
    groups = groups.select("g", F.col("top.c").alias("major"), F.ceil((F.col("n") - F.col("top.m")) / TILE).cast("int").alias("xs"), F.ceil(F.col("n") / TILE).cast("int").alias("ys"))
    mixed = stored(near.join(counted(groups, "dedup-groups"), "g"), "dedup-mixed")
    at = lambda parts: F.pmod(F.xxhash64("nid"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    x = mixed.where("c <> major").select("g", at("xs").alias("xt"), every("ys").alias("yt"), F.lit(0).alias("side"), "nid", "c", "d.n", "d.s1", "d.s2")
    y = mixed.select("g", every("xs").alias("xt"), at("ys").alias("yt"), F.lit(1).alias("side"), "nid", "c", "d.n", "d.s1", "d.s2")
    tiles = x.unionByName(y)
    # documents of many tiles come with their sets only to those where some other may be similar; where a neighbourhood is one tile they come once anyway
    many = tiles.join(counted(groups.where("xs * ys > 1").select("g"), "dedup-wide"), "g", "left_semi")
    many = many.groupBy("g", "xt", "yt").applyInPandas(lambda p: _possible(p, percent), tiles.schema)
    tiles = stored(tiles.join(counted(groups.where("xs * ys = 1").select("g"), "dedup-narrow"), "g", "left_semi").unionByName(many), "dedup-tiles")
    sets = _sets_of(tiles.select(F.col("nid").alias("doc_id")), texts, k)
    tiles = tiles.join(sets.withColumnRenamed("doc_id", "nid"), "nid")
    more = stored(tiles.groupBy("g", "xt", "yt").applyInPandas(lambda p: _joining(p, percent), "a long, b long").distinct(), "dedup-joining")
    comp2 = components(comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "dedup-cc2")
    out = members.join(comp2.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
