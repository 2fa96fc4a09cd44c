"""Operator 12: vectors as short codes. Every part of a vector is replaced by the nearest entry of a codebook, found by filtering entries through cells (VA-file)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, join_groups, stored, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A component x becomes floor(SCALE * x).
SCALE = 1024
#: Entry coordinates are cut into 2**BITS cells a dimension.
BITS = 4
#: Part vectors compared at once, and bytes of the tables of bounds for them.
ROWS, TABLE_BYTES = 2048, 32 << 20


def largest(dim: int) -> int:
    """The largest magnitude of an integer component with which squared distances over dim of them stay below 2**62."""
    return 1 << int((62 - np.log2(max(dim, 1))) // 2 - 1)


class Cells:
    """A codebook (entries x dimensions, integers) whose coordinates are also known by the cell they lie in: 2**BITS cells a dimension, bounded by quantiles of the entries."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        n, d = self.entries.shape
        at = np.linspace(0, n - 1, (1 << BITS) + 1).round().astype(int)[1:-1]
        ranked = np.sort(self.entries, axis=0)
        self.cell = np.empty((n, d), np.int64)
        self.low, self.high = np.zeros((d, 1 << BITS), np.int64), np.zeros((d, 1 << BITS), np.int64)
        for j in range(d):
            self.cell[:, j] = np.searchsorted(ranked[at, j], self.entries[:, j], side="right")
            for c in np.unique(self.cell[:, j]):  # the tightest box: what lies in the cell
                inside = self.entries[self.cell[:, j] == c, j]
                self.low[j, c], self.high[j, c] = inside.min(), inside.max()

    def bounds(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of part vectors (rows) to every entry, by a lookup table for each vector, dimension and cell."""
        lower = np.zeros((len(part), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(part.shape[1]):
            q = part[:, j, None]
            below, above = self.low[j] - q, q - self.high[j]
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[:, j]]
            upper += (far * far)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index. Only entries whose lower bound does not pass the least upper bound are measured."""
        index, error = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        step = max(1, min(ROWS, TABLE_BYTES // (16 * max(1, len(self.entries)))))
        for at in range(0, len(part), step):
            q = part[at : at + step]
            lower, upper = self.bounds(q)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            off = q[row] - self.entries[entry]
            dist = np.einsum("ij,ij->i", off, off)
            order = np.lexsort((entry, dist, row))
            first = order[np.unique(row[order], return_index=True)[1]]
            index[at : at + step], error[at : at + step] = entry[first], dist[first]
        return index, error


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of equally long integer lists as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assigned(v: np.ndarray, books: list[Cells]) -> tuple[list[np.ndarray], np.ndarray]:
    """The entry of every part of every row, and the rows' errors summed over parts."""
    found = [book.nearest(x) for book, x in zip(books, np.split(v, len(books), axis=1), strict=True)]
    return [i for i, _ in found], sum(e for _, e in found)


def _sums(books: list[Cells]):
    """Batches of whole vectors -> what a task knows: for every part and entry used, the number of its parts and their componentwise sums."""

    def f(batches):
        n = np.zeros((len(books), len(books[0].entries)), np.int64)
        total = [np.zeros(b.entries.shape, np.int64) for b in books]
        for b in batches:
            v = _matrix(b.column(0))
            if not len(v):
                continue
            index, _ = _assigned(v, books)
            for p, (i, x) in enumerate(zip(index, np.split(v, len(books), axis=1), strict=True)):
                n[p] += np.bincount(i, minlength=n.shape[1])
                np.add.at(total[p], i, x)
        part, entry = np.nonzero(n)
        sums = pa.array([total[p][e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), sums], ["part", "entry", "n", "sums"])

    return f


def _codes(books: list[Cells]):
    def f(batches):
        for b in batches:
            v = _matrix(b.column(0))
            if len(v):
                index, error = _assigned(v, books)
                code = ["".join(f"{x:02x}" for x in row) for row in zip(*index, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return f


def whole_vectors(vectors: DataFrame, parts: int = PARTS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v), stored: kept vectors as integers, padded to one length that `parts` divides. Defined in encode()."""
    x = F.col(f"`{vector_col}`")
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    v = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), x.alias("x")).where(sound)
    longest = v.agg(F.max(F.size("x"))).first()[0] or 0
    dim = -(-longest // parts) * parts
    most = float(largest(dim // parts))
    whole = F.transform("x", lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(c.cast("double") * SCALE).cast("double"))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(dim) - F.size("x")))
    return stored(v.select("vec_id", "label", padded.alias("v")), "vectors-whole")


def codebooks(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One array (entries x dimensions of a part) for each part. The driver holds these and nothing else; each round adds up tasks' sums in Spark."""
    first = whole.select("v", "vec_id").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    if not first:
        return []
    books = np.split(np.array([r["v"] for r in first], np.int64).reshape(len(first), -1), parts, axis=1)
    for _ in range(rounds):
        told = in_arrow(whole.select("v"), _sums([Cells(b) for b in books]), "part int, entry int, n long, sums array<long>")
        each = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        for r in each.collect():  # at most entries x dimensions numbers
            books[r["part"]][r["entry"], r["at"]] = r["sum"] // r["n"]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error, label_error), codebooks): every kept vector as `parts` entry numbers, two hex digits each, its squared error in whole units and that of its label.

    Vectors become integers once and are stored. Each round sends the codebooks (entries x dimensions numbers, at most a few hundred kB) to the tasks; a task filters the entries
    for each part vector by bounds from cells, measures what is left in integers and adds up; Spark adds up the tasks' sums. A retry of a task gives the same numbers.

    Vectors that are null or hold a null or non-finite component are left out. A null vec_id sorts last; rows that repeat an id are vectors each, ordered by their components, and may
    start several entries. With fewer vectors than entries, all start one. Vectors shorter than the longest, and lengths that parts does not divide, are filled up with zeros at their end.
    Integers are held to magnitudes at which squared distances fit 64 bits (2**27 and more for parts of up to 64 components, so |x| < 131,072 stays as it is). Ties go to the lower index; null labels are one label.
    An empty table, or one without kept vectors, gives no rows. Columns besides the three named have no part.
    """
    whole = whole_vectors(vectors, parts, id_col, vector_col, label_col)
    books = codebooks(whole, parts, entries, rounds)
    kind = whole.select("vec_id", "label").schema
    schema = f"vec_id {kind['vec_id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error long"
    if not books:
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    coded = stored(in_arrow(whole.select("v", "vec_id", "label"), _codes([Cells(b) for b in books]), schema).withColumn("of", F.struct("label")), "vector-codes")
    labels = stored(coded.groupBy("of").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")), "vector-label-errors")
    return join_groups(coded, labels, ["of"], "n").select("vec_id", "label", "code", "error", "label_error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one by one: a book is (part, entry, v), an assignment the least (distance, entry) of each part."""
    dist = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := {dist}, e := entry)) AS best FROM p JOIN b{k} b USING (part) GROUP BY r, part)")
        if k < ROUNDS:
            mean = f"SELECT part, best.e AS entry, i, sum(p.v[i]) AS s, count(*) AS n FROM a{k} JOIN p USING (r, part) CROSS JOIN (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i) x GROUP BY ALL"
            whole = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            steps.append(f"m{k} AS MATERIALIZED (SELECT part, entry, list({whole} ORDER BY i) AS v FROM ({mean}) GROUP BY part, entry)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, vec_id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k CROSS JOIN (SELECT unnest(range({PARTS})) AS part) x),
b0 AS (SELECT part, r AS entry, v FROM p WHERE r < {ENTRIES}),
{''',
'''.join(steps)},
c AS (SELECT r, any_value(vec_id) AS vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM a{ROUNDS} JOIN p USING (r, part) GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c CROSS JOIN h
"""


OP12_SQL = _sql()
