"""Operator 7: pack documents into fixed-length sequences in the order of a space-filling curve."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, stored, table
from .textbatch import chunks, mix64, words

LENGTH = 4096
END_ID = 2
#: Dimensions and bits of the curve; with TIE bits of the id's hash the key has 53 bits, so that it is exact as a double.
DIMS, BITS, TIE = 3, 12, 17
#: Distinct pieces whose ids a Python worker remembers.
CACHE_WORDS = 400_000
#: Bytes of ids in a partition, about.
PART_BYTES = 64 << 20
#: Documents that are cut into pieces at a time.
CUT_ROWS = 256
#: How the default tokenizer cuts lower-cased text (fixed value of its file), and the texts whose lower case and normal form are beyond doubt.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[\x09-\x0d\x20-\x7eÀ-įı-ſ]+")
#: Byte -> letter of byte-level tokenizers (fixed rule): bytes that print stand for themselves, the others for the letters from U+0100 on.
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINT)))}
#: The same cut for such texts, with their letters and digits written out.
FIND = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\sa-z0-9ß-öø-ſ]+").findall


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, dims) with `bits` bits a coordinate."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest level on
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class _Vocabulary(dict):
    """Token ids of pieces of text, remembered, with each piece's direction in the projection of hashed vectors.

    The tokenizer never joins tokens over white space, so a text's ids are those of its words, one after the other. A text of
    plain Latin letters and ASCII is cut into the tokenizer's own pieces (str), lower-cased; any other text into its words (bytes), which
    are encoded as they stand. A piece not yet known gets the next number when it is looked up; `learn` then encodes all such pieces.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint32 if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16 else np.uint16
        # pieces are known for tokenizers that lower-case and split like the default one
        made = json.loads(self.tokenizer.to_str())
        steps, splits = (made.get("normalizer") or {}).get("normalizers", []), (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.like = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": PIECES} and made["model"]["type"] == "BPE"
        self.fresh: list = []
        self.flat, self.used = np.zeros(1 << 18, self.kind), 0
        self.start, self.size, self.hits, self.signs = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int64), np.zeros((1 << 14, DIMS), np.float32)

    def __missing__(self, piece) -> int:
        n = self[piece] = len(self)
        self.fresh.append(piece)
        return n

    def forget(self) -> None:
        """All pieces but those seen more than once, at most half of CACHE_WORDS of them, the most seen ones."""
        known = list(self)
        kept = np.flatnonzero(self.hits[: len(known)] > 1)
        if len(kept) > CACHE_WORDS // 2:
            kept = np.sort(kept[np.argsort(-self.hits[kept], kind="stable")[: CACHE_WORDS // 2]])
        size = self.size[kept].astype(np.int64)
        upto = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[kept] - upto + size, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.signs, self.hits, self.used = upto - size, self.size[kept], self.signs[kept], self.hits[kept] // 2, len(self.flat)
        self.clear()
        self.update(zip([known[i] for i in kept.tolist()], range(len(kept)), strict=True))

    def cut(self, text: str | None) -> list:
        if text and self.like and "<|" not in text and PLAIN.fullmatch(text):
            return FIND(text.lower())
        return words(text)

    def ids_of(self, new: list) -> list[list[int]]:
        """Ids of each piece: of str pieces from the tokenizer's merges alone, as they are cut and lower-cased already; of words from the whole tokenizer."""
        merged = self.tokenizer.model.tokenize
        rest = [i for i, w in enumerate(new) if not isinstance(w, str)]
        out = [[] if isinstance(w, bytes) else [t.id for t in merged(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))] for w in new]
        for i, e in zip(rest, self.tokenizer.encode_batch([new[i].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def learn(self) -> None:
        new, self.fresh = self.fresh, []
        if not new:
            return
        ids = self.ids_of(new)
        n, m = len(self) - len(new), len(new)
        size = np.fromiter(map(len, ids), np.int32, m)
        total = int(size.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + total, self.kind)])
        if n + m > len(self.start):
            self.start, self.size, self.hits, self.signs = (np.concatenate([x, np.zeros((n + m, *x.shape[1:]), x.dtype)]) for x in (self.start, self.size, self.hits, self.signs))
        self.start[n : n + m] = self.used + np.cumsum(size, dtype=np.int64) - size
        self.flat[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), self.kind, total)
        self.used += total
        self.size[n : n + m] = size
        h = np.fromiter(map(xxhash.xxh32_intdigest, new), np.int64, m)
        self.signs[n : n + m] = ((h[:, None] >> np.arange(DIMS)) & 1) * 2.0 - 1

    def encoded(self, texts: list[list], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' ids one after the other with end_id behind each, the number of each text's ids, and the means of their pieces' directions."""
        if len(self) > CACHE_WORDS:
            self.forget()
        n = np.array([len(t) for t in texts])
        at = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.int64, int(n.sum()))
        self.learn()
        self.hits[: len(self)] += np.bincount(at, minlength=len(self))
        ends = np.cumsum(n)
        size = self.size[at].astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(size)])[ends]
        sums = np.concatenate([np.zeros((1, DIMS)), np.cumsum(self.signs[at], axis=0, dtype=np.float64)])
        means = (sums[ends] - sums[ends - n]) / np.maximum(1, n)[:, None]
        ids = np.empty(int(cuts[-1] if len(cuts) else 0) + len(n), self.kind)
        last = cuts + np.arange(len(n))
        ids[last] = end_id
        inner = np.ones(len(ids), bool)
        inner[last] = False
        ids[inner] = self.flat[np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
        return ids, np.diff(last, prepend=-1), means


@functools.lru_cache(maxsize=1)
def _vocabulary(path: str) -> _Vocabulary:
    """What a Python worker remembers from task to task: CACHE_WORDS pieces and those of one batch at most."""
    return _Vocabulary(path)


def _tokenised(batches, path: str, end_id: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    vocabulary = _vocabulary(path)
    for b, texts in chunks(batches):
        ids, n, means = vocabulary.encoded([vocabulary.cut(t) for t in texts], end_id)
        grid = np.clip((means * 4 + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
        doc = b.column(0)
        i = np.asarray(doc.fill_null(-1)).astype(np.int64).view(np.uint64)
        key = (hilbert(grid) << TIE) | (mix64(i) >> np.uint64(64 - TIE)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
        raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([doc, pa.array(key), pa.array(n, pa.int64()), raw], names=["doc_id", "key", "n", "ids"])


def _pieces(b: pa.RecordBatch, starts: np.ndarray, length: int, kind) -> pa.RecordBatch:
    """A batch of documents, with each one's place in the stream of ids, cut at the multiples of `length`."""
    doc, n, raw = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "n", "ids"))
    n = np.asarray(n).astype(np.int64)
    parts = (starts + n - 1) // length - starts // length + 1
    of = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)  # which piece of its document
    sequence = starts[of] // length + k
    at = np.maximum(starts[of], sequence * length)
    size = np.minimum(starts[of] + n[of], (sequence + 1) * length) - at
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(n) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind).astype("<u4")
    upto = np.concatenate([[0], np.cumsum(size)]) * 4
    ids = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(upto), pa.py_buffer(data)]).cast(pa.binary())
    columns = [doc.take(pa.array(of)), pa.array(at - starts[of]), pa.array(size), ids, pa.array(n[of]), pa.array(sequence), pa.array(at - sequence * length)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _cut(batches, offsets: dict[int, int], length: int, width: int):
    """Rows sorted by (bucket, key, ...) become pieces; the position runs on from row to row within a bucket."""
    kind = np.uint32 if width == 4 else np.uint16
    last, pos = None, 0
    for whole in batches:
        for s in range(0, whole.num_rows, CUT_ROWS):
            b = whole.slice(s, CUT_ROWS)
            n, bucket = (np.asarray(b.column(b.schema.get_field_index(c))).astype(np.int64) for c in ("n", "bucket"))
            upto = np.cumsum(n)
            heads = np.flatnonzero(np.diff(bucket, prepend=-1 if last is None else last))  # rows that begin a bucket
            base = np.array([pos, *(offsets[k] for k in bucket[heads].tolist())]) - np.concatenate([[0], (upto - n)[heads]])
            starts = upto - n + base[np.searchsorted(heads, np.arange(len(n)), side="right")]
            last, pos = int(bucket[-1]), int(starts[-1] + n[-1])
            yield _pieces(b, starts, length, kind)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are unsigned 32-bit little-endian.

    1. Each text is tokenised once, gets end_id behind it, and a key: its hashed bag of words, projected at random to 3 dimensions,
       as a position on the Hilbert curve, with bits of the id's hash behind it so that many equal documents spread. Stored.
    2. Approximate quantiles of the keys cut the curve into buckets, one for PART_BYTES of ids or for each shuffle partition; the buckets' token sums give each its
       place in the stream of all tokens. That is all the driver sees: one number a bucket.
    3. One shuffle makes each bucket a partition, its documents in key order, and they are cut wherever the stream reaches a multiple of
       `length`. Only the last sequence of all is shorter; sequences run across buckets and partitions.
    Texts whose words repeat lie next to each other on the curve and come into the same sequences.

    Null texts are empty and give the end id alone; null ids and rows that repeat an id are packed like others, each row
    in its own pieces. Long documents span as many sequences as they need. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    from tokenizers import Tokenizer

    width = 4 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) > 1 << 16 else 2
    coded = stored(in_arrow(rows, lambda it: _tokenised(it, tokenizer, end_id), "doc_id long, key long, n long, ids binary"), "pack-ids")
    total = coded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * width // PART_BYTES))
    bounds = sorted(set(coded.approxQuantile("key", [i / parts for i in range(1, parts)], 0.1 / parts)))
    steps = [1 << s for s in range(len(bounds).bit_length(), -1, -1)]
    edges = F.lit(bounds) if bounds else F.array().cast("array<double>")
    at = F.aggregate(F.lit(steps), F.lit(0), lambda pos, s: pos + F.when((pos + s <= len(bounds)) & (F.get(edges, pos + s - 1) <= F.col("key")), s).otherwise(0))
    coded = coded.withColumn("bucket", at.cast("int"))
    sums = dict(coded.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    offsets, end = {}, 0
    for k in sorted(sums):
        offsets[k], end = end, end + sums[k]
    near = coded.select("doc_id", "bucket", "key", "n", "ids").repartitionById(parts, "bucket").sortWithinPartitions("bucket", "key", "doc_id", F.xxhash64("ids"))
    return in_arrow(near, lambda it: _cut(it, offsets, length, width), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
