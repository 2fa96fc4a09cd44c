"""Operator 11: lines that several documents share stay in one of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, in_arrow, join_groups, stored, table
from .textbatch import chunks

#: Shorter keys are never shared lines.
MIN_CHARS = 10
#: A line is shared if so many documents hold it.
MIN_DOCS = 2

STRIPPED = SPACES.encode()


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line, UTF-8: ASCII white space stripped at both ends, A-Z in lower case; none if it has fewer than min_chars code points."""
    key = line.strip(STRIPPED)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()  # of bytes: A-Z alone


def _lines(min_chars: int):
    """Batches of (of, doc_id, text) -> a row for each line that has a key: (of, doc_id, pos, h1, h2), the halves of a 128-bit hash of the key."""

    def f(batches):
        for b, texts in chunks(batches):
            rows, pos, hashes = [], [], []
            for i, text in enumerate(texts):
                for p, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        rows.append(i)
                        pos.append(p)
                        hashes.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            rows = pa.array(rows, pa.int64())
            cols = [b.column(0).take(rows), b.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, ["of", "doc_id", "pos", "h1", "h2"])

    return f


def _without(batches):
    """Batches of (row, text, gone): the row, its text without the lines at the positions in gone, the number of its lines, and of those that went."""
    for b, texts in chunks(batches):
        kept, n_lines, n_dropped = [], [], []
        for text, gone in zip(texts, b.column(b.schema.get_field_index("gone")).to_pylist(), strict=True):
            lines = (text or "").split("\n")
            out = set(gone or ())
            kept.append("\n".join(x for p, x in enumerate(lines) if p not in out) if out else text or "")
            n_lines.append(len(lines))
            n_dropped.append(len(out))
        cols = [b.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["row", "kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, kept_text, n_lines, n_dropped): a row of docs (its columns `keep`, all by default, as a struct) and its text without shared lines.

    1. Every line that has a key is hashed (128 bits); keys are counted by document with map-side combining. Those of min_docs documents or more are shared, and their smallest id is their home.
    2. Lines meet the shared keys again; those away from home are gone. Keys with many lines are joined by broadcast, so none falls to one task (join_groups).
    3. The positions of a document's gone lines are gathered, its text is split again and put together without them. Texts are shuffled once, in this step; a document nothing was taken from is unchanged.

    Nulls: a null text is one empty line. Rows with a null id are one document, whose id is above all others. Rows that repeat an id are one document: a line that only they hold is not shared
    (with min_docs 2), and stays in all of them if that id is its home. Repeats of a line within a document share its fate. An empty table gives no rows. A very long text is
    held by one task, as the row it is; columns of docs with whatever names travel in `row`.
    """
    cols = docs.columns if keep is None else keep
    text = F.col(f"`{text_col}`")
    of = F.xxhash64(F.col(f"`{id_col}`"), text)  # lines of rows that are alike go together
    rows = docs.select(of.alias("of"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    lines = in_arrow(rows, _lines(min_chars), "of long, doc_id long, pos int, h1 long, h2 long")
    one = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")  # sorts as ids do, null last
    if min_docs > 2:
        lines_of = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
        shared = lines_of.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min(one)["doc_id"].alias("home")).where(F.col("docs") >= min_docs)
    else:  # two ends tell one document from several, without a row for each document
        shared = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("home"), F.max("doc_id").alias("top"), F.max(F.col("doc_id").isNull()).alias("anon"))
        shared = shared.where("home < top OR (home IS NOT NULL AND anon)" if min_docs == 2 else "true")
    shared = stored(shared.select("h1", "h2", "n", "home"), "lines-shared")
    gone = join_groups(lines, shared, ["h1", "h2"], "n").where("NOT (doc_id <=> home)")
    gone = gone.groupBy("of", "doc_id").agg(F.collect_set("pos").alias("gone")).select(F.col("of").alias("gone_of"), F.col("doc_id").alias("gone_id"), "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), text.alias("text"), of.alias("of"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    met = whole.join(gone, (F.col("of") == F.col("gone_of")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    met = met.select("row", "text", "gone")
    kind = met.schema["row"].dataType.simpleString()
    return in_arrow(met, _without, f"row {kind}, kept_text string, n_lines long, n_dropped long")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS home FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) + CAST(bool_or(doc_id IS NULL) AS INT) >= 2),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.home AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r
"""
