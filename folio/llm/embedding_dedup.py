"""Operator 10: near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, in_arrow, stored, table

THRESHOLD = 0.98
#: Rows of a tile at most on average, and ranges of the leading coordinate over which tiles are laid.
TILE, RANGES = 2048, 32
#: Dimensions added at a time, the leading ones first; the rest in one go.
STEPS = (8, 8, 16, 32)
#: Share of open pairs below which they are finished one by one.
FEW = 0.02


def _moments(batches):
    """Sums of the outer products of unit vectors with a 1 behind their components, a row of the matrix as one row, for each length of vector.
    So the last row holds the vectors' sum and their number."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        col = b.column(0)
        sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            x = np.stack([np.asarray(v.values, np.float64) for v in col.filter(pa.array(sizes == d))])
            x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((len(x), 1))])
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    rows = [(d, i, m[i].tolist()) for d, m in sums.items() for i in range(d + 1)]
    if rows:
        d, i, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.list_(pa.float64()))], names=["dim", "i", "v"])


def principal_axes(vectors: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """For each length of vector, from all vectors, orthonormal axes, the strongest first, and the axis along which unit vectors spread most about their mean.
    Executors add up the matrix row by row."""
    parts = in_arrow(vectors.select("embedding"), _moments, "dim int, i int, v array<double>")
    total = parts.groupBy("dim", "i").applyInPandas(lambda p: pd.DataFrame({"dim": p["dim"][:1], "i": p["i"][:1], "v": [np.sum(np.stack(p["v"].to_list()), axis=0)]}), "dim int, i int, v array<double>")
    axes, spread = {}, {}
    for d, g in total.toPandas().groupby("dim"):
        m = np.stack(g.sort_values("i")["v"].to_list())
        m, mean = (m + m.T)[:-1, :-1] / (2 * m[-1, -1]), m[-1, :-1] / m[-1, -1]
        axes[int(d)] = np.linalg.eigh(m)[1][:, ::-1].copy()
        spread[int(d)] = np.linalg.eigh(m - np.outer(mean, mean))[1][:, -1].copy()
    return axes, spread


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which rows of x and y have a cosine of at least threshold, in double precision.

    Products over the leading axes are added up; what the rest can add is at most the product of the suffix norms. Once few pairs
    can still reach the threshold, those alone are computed in full, from the vectors as given.
    """
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    u, v = (x / nx[:, None]) @ axes, (y / ny[:, None]) @ axes
    acc, at, d = np.zeros((len(x), len(y))), 0, x.shape[1]
    for step in (*STEPS, d):
        to = min(d, at + step)
        acc += u[:, at:to] @ v[:, at:to].T
        rest = np.linalg.norm(u[:, to:], axis=1)[:, None] * np.linalg.norm(v[:, to:], axis=1)[None, :]
        open_ = acc + rest >= threshold - 1e-9
        at = to
        if at == d or open_.mean() <= FEW:
            break
    if open_.mean() > FEW:
        return open_ & (x @ y.T / (nx[:, None] * ny[None, :]) >= threshold)
    i, j = np.nonzero(open_)
    out = np.zeros_like(open_)
    for s in range(0, len(i), 1 << 16):
        a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[a, b] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return out


def _compare(p: pd.DataFrame, axes: dict[int, np.ndarray], threshold: float) -> pd.DataFrame:
    """One pair of tiles: for each vector with a link its number of linked vectors, and the smallest vector of its component there."""
    first = p["a"].iloc[0] == p["b"].iloc[0]
    x = p[p["side"] == 0]
    y = x if first else p[p["side"] == 1]
    if not len(x) or not len(y):
        return pd.DataFrame({"rep": [], "links": [], "to": []}).astype("int64")
    mx, my = (np.stack(q["embedding"].to_list()).astype(np.float64) for q in (x, y))
    hit = linked(mx, my, axes[mx.shape[1]], threshold)
    if first:
        np.fill_diagonal(hit, False)
    ix, iy, wx, wy = (q[c].to_numpy(np.int64) for c in ("rep", "copies") for q in (x, y))
    hit &= ix[:, None] != iy[None, :]  # values of one id
    lx = hit @ wy
    if first:
        ids, links, low = ix, lx, ix.copy()
        while True:  # smallest id along links, until it stands
            new = np.minimum(low, np.where(hit, low[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (new == low).all():
                break
            low = new
    else:
        lowx, lowy, top = ix.copy(), iy.copy(), np.iinfo(np.int64).max
        while True:
            newx = np.minimum(lowx, np.where(hit, lowy[None, :], top).min(axis=1))
            newy = np.minimum(lowy, np.where(hit, newx[:, None], top).min(axis=0))
            if (newx == lowx).all() and (newy == lowy).all():
                break
            lowx, lowy = newx, newy
        ids, links, low = np.concatenate([ix, iy]), np.concatenate([lx, wx @ hit]), np.concatenate([lowx, lowy])
    some = links > 0
    return pd.DataFrame({"rep": ids[some], "links": links[some], "to": low[some]})


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links between vectors of one label with a cosine of at least threshold.

    1. Equal vectors of a label form a class with a number of copies (map-side combine); its smallest id stands for it.
    2. All classes give the principal axes. Unit vectors whose cosine is at least t differ by at most sqrt(2 - 2t) along any axis, so
       along the one on which they spread most about their mean a class need only meet classes that near. Ranges of that coordinate, cut by hash into tiles of TILE rows
       or so, make the tiles of a label; pairs of tiles within reach of each other are compared, each in one task of bounded size.
    3. A pair of tiles returns a row for each vector that has links: how many, and the smallest vector it is connected with there.
       Counts are summed and those edges, one a vector, are joined to components; single links are never listed.
    The comparison is exact; its work grows with the square of a label's dense ranges, its memory does not.

    Vectors that are null, zero, or hold a null or non-finite component, and those with a null label, link with nothing and form their
    own component. Vectors of different lengths do not link. Rows that repeat an id are taken as one vector with several values, whose links
    to others are added up; a null id has no component. Ties do not matter: nothing is chosen.
    An empty table gives no rows. Further columns are ignored, whatever their names. A very long vector is one row; axes of its length are a matrix of that size squared on the driver.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = F.coalesce(sound, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    keyed = stored(v.select("vec_id", "label", "embedding", F.when(ok, F.xxhash64("embedding")).alias("h1"), F.when(ok, F.xxhash64(F.lit(1), "embedding")).alias("h2")), "vectors")
    classes = keyed.where("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes, "vector-classes")
    reps = keyed.where("h1 IS NOT NULL").join(classes.select("label", "h1", "h2", "rep", "copies"), ["label", "h1", "h2"]).where("vec_id = rep").dropDuplicates(["rep", "label", "h1", "h2"]).select("rep", "copies", "label", "embedding")
    reps = stored(reps, "vector-reps")
    axes, spread = principal_axes(reps)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lead = [F.when(F.size("embedding") == d, F.aggregate(F.zip_with(F.col("embedding"), F.lit([float(t) for t in a]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) / norm) for d, a in spread.items()]
    placed = stored(reps.select("rep", "copies", "label", "embedding", F.size("embedding").alias("dim"), (F.coalesce(*lead) if lead else F.lit(0.0)).alias("c")), "vector-places")
    cuts = sorted(set(placed.approxQuantile("c", [i / RANGES for i in range(1, RANGES)], 0.005)))
    placed = placed.withColumn("range", F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda q: q <= F.col("c"))))
    tiles = stored(placed.groupBy("label", "dim", "range").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "vector-tiles")
    placed = placed.join(tiles.select("label", "dim", "range", "parts"), ["label", "dim", "range"]).withColumn("tile", F.struct("range", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")))
    t = tiles.select("label", "dim", "lo", "hi", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct("range", i.alias("part")))).alias("tile"))
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.tile") <= F.col("b.tile")) & (F.col("b.lo") - F.col("a.hi") <= reach) & (F.col("a.lo") - F.col("b.hi") <= reach)).select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.col("a.tile").alias("a"), F.col("b.tile").alias("b"))
    pairs = stored(pairs, "vector-pairs")
    meets = pairs.select("label", "dim", "a", "b", F.col("a").alias("tile"), F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select("label", "dim", "a", "b", F.col("b").alias("tile"), F.lit(1).alias("side")))
    shared = spark.sparkContext.broadcast(axes)
    rows = placed.join(meets, ["label", "dim", "tile"]).select("label", "dim", F.to_json("a").alias("a"), F.to_json("b").alias("b"), "side", "rep", "copies", "embedding")
    found = stored(rows.groupBy("label", "dim", "a", "b").applyInPandas(lambda p: _compare(p, shared.value, threshold), "rep long, links long, to long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), "vector-cc")
    of = classes.join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "label", "h1", "h2").join(of, ["label", "h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
