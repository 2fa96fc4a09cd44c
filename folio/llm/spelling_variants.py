"""Operator 13: spelling variants of words, grouped by full neighbourhood generation."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_GROUPS, in_arrow, stored, table
from .textbatch import chunks, mix64

#: Letters of a word; after A-Z were lowered.
LETTERS = r"[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One word of so many, by the hash of document and word, loses a letter.
SLIP = 97
#: A word's form has at least so many times its occurrences.
RATIO = 2
#: Words a task counts before it hands them on; code points of a very long text that are read at a time.
MOST_HELD, PIECE = 200_000, 1 << 20
#: Bits of the filter of words: FILTER_BITS a word, 2**MOST_BITS (16 MB) at most, so what is sent to tasks is bounded; beyond, more candidates reach the join.
FILTER_BITS, MOST_BITS = 64, 27
#: Words of one length whose neighbours are made at once.
ROWS = 512

_U = np.uint64
#: Base of the words' polynomial hash, odd, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `most` code points, cut where no word is cut."""
    other, at = re.compile(r"[^A-Za-zÀ-ÿ]"), 0
    while len(text) - at > most:
        gap = other.search(text, at + most)
        if not gap:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def slipped(prefix: int, word: str) -> str:
    """The word as it counts: prefix is the CRC of '<doc_id>:'."""
    h = zlib.crc32(word.encode(), prefix)
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counted(min_length: int):
    """Batches of (doc_id as text, text) -> (word, n), added up over documents as far as MOST_HELD words allow."""
    find = re.compile("[a-zÀ-ÿ]+").findall

    def told(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def f(batches):
        held: Counter = Counter()
        for b, texts in chunks(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts, strict=True):
                prefix, found = zlib.crc32(f"{doc_id}:".encode()), Counter()
                for piece in pieces(text or ""):
                    found.update(find(piece.encode("utf-8", "replace").lower().decode()))  # lower() of bytes: A-Z alone
                for run, n in found.items():
                    if len(run) >= min_length and len(word := slipped(prefix, run)) >= min_length:
                        held[word] += n
                if len(held) >= MOST_HELD:
                    yield told(held)
                    held = Counter()
        yield told(held)

    return f


def letter_code(points: np.ndarray) -> np.ndarray:
    return mix64(points.astype(_U) * _U(2) + _U(1))


def place(h: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a word hash in a filter of 2**bits."""
    return (mix64(h) >> _U(64 - bits)).astype(np.int64)


def _points(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def word_hash(points: np.ndarray) -> np.ndarray:
    h = np.zeros(len(points), _U)
    with np.errstate(over="ignore"):
        for j in range(points.shape[1] - 1, -1, -1):
            h = h * _U(BASE) + letter_code(points[:, j])
    return h


def by_length(words: list[str], rows: int = ROWS) -> Iterator[list[str]]:
    of: dict[int, list[str]] = {}
    for w in words:
        of.setdefault(len(w), []).append(w)
    for same in of.values():
        for at in range(0, len(same), rows):
            yield same[at : at + rows]


def neighbours(words: list[str], alphabet: str, hit) -> Iterator[tuple[str, str]]:
    """(word, neighbour) for words of one length: each neighbour is made once, as a hash, and spelt out if hit(hashes) says so.

    All deletions, replacements and insertions over the alphabet. In a run of one letter only its first is deleted, and a letter is not inserted behind itself, so that what is made is distinct;
    the three kinds differ in length. A neighbour's hash comes from those of the parts before and after the place.
    """
    points = _points(words)
    n, length = points.shape
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    codes = letter_code(letters)
    same = points[:, 1:] == points[:, :-1]
    with np.errstate(over="ignore"):
        own, before, power = word_hash(points), np.zeros(n, _U), _U(1)
        for j in range(length + 1):
            after = own - before  # what stands at j and behind, at its power
            kind = letters[None, :] != points[:, j - 1, None] if j else np.ones((n, len(letters)), bool)
            made = before[:, None] + codes[None, :] * power + (after * _U(BASE))[:, None]
            for r, c in zip(*np.nonzero(hit(made) & kind), strict=True):
                yield words[r], words[r][:j] + alphabet[c] + words[r][j:]
            if j == length:
                break
            here = letter_code(points[:, j]) * power
            made = (own - here)[:, None] + codes[None, :] * power
            for r, c in zip(*np.nonzero(hit(made) & (letters[None, :] != points[:, j, None])), strict=True):
                yield words[r], words[r][:j] + alphabet[c] + words[r][j + 1 :]
            made = before + (after - here) * _U(INVERSE)
            first = ~same[:, j - 1] if j else np.ones(n, bool)
            for r in np.nonzero(hit(made) & first)[0]:
                yield words[r], words[r][:j] + words[r][j + 1 :]
            before, power = before + here, power * _U(BASE)


def _placed(bits: int):
    def f(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            at = np.empty(len(words), np.int64)
            index = {w: i for i, w in enumerate(words)}
            for same in by_length(words):
                at[[index[w] for w in same]] = place(word_hash(_points(same)), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["bit"])

    return f


def word_filter(words: DataFrame, bits: int) -> np.ndarray:
    """The words' bits as bytes: 2**bits of them, put together in blocks of 4 kB by Spark."""
    bit = in_arrow(words.select("word"), _placed(bits), "bit long").select((F.col("bit") + 1).alias("bit"))
    blocks = bit.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bytes"))
    out = np.zeros(max(1, (1 << bits) // 32768) * 4096, np.uint8)
    for r in blocks.toLocalIterator():
        at = (r["block"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bytes"]), np.uint8)
    return out


def _candidates(shared, bits: int, alphabet: str):
    def f(batches):
        filled = shared.value

        def hit(hashes: np.ndarray) -> np.ndarray:
            at = place(hashes, bits)
            return (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for b in batches:
            pairs: list[tuple[str, str]] = []
            for same in by_length(b.column(0).to_pylist()):
                for pair in neighbours(same, alphabet, hit):
                    pairs.append(pair)
                    if len(pairs) >= MOST_HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*pairs, strict=True)], ["word", "near"])
                        pairs = []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*pairs, strict=True)], ["word", "near"])

    return f


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n), stored: words of at least min_length code points with at least min_count occurrences."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counted = in_arrow(rows, _counted(min_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= min_count), "words")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words that differ by one code point, both ways round.

    All neighbours of every word over the alphabet of the words are made, (2 length + 1) x letters of them. A filter of bounded size, a bit for the hash of each word, lets through those
    that can be words; these are spelt out and joined with the words by equality, which decides.
    """
    alphabet = "".join(sorted(r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''").collect()))  # as many as LETTERS has at most
    bits = min(MOST_BITS, max(15, int(words.count() * FILTER_BITS).bit_length()))
    shared = words.sparkSession.sparkContext.broadcast(word_filter(words, bits))
    found = in_arrow(words.select("word"), _candidates(shared, bits, alphabet), "word string, near string")
    return found.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near").select("word", "near", "near_n")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word; see near_words. A word's form is its near word of largest n (ties: smallest in code-point order) if that has ratio times its n or more.

    Words are counted in tasks and then in Spark, so a frequent word is a row a task. Roots are found from the top down: words without a form are their own root, and each round finds those
    whose form has one; n grows by `ratio` along a chain, so there are at most log2(n) rounds, and a form is met by no more words than it has neighbours.

    Nulls: a null text has no words, a null id is an empty one in the hash. Rows that repeat an id count each, and lose the same letters. An empty table gives no rows.
    A very long text is read in pieces cut between words; a very long word has its neighbours made place by place. Further columns of docs do not matter.

    Tables as long as the vocabulary are joined by sorting: their files are small beside what they hold, and going by that size Spark would gather them in the driver to broadcast them.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: chains of forms would not have to end")
    words = vocabulary(docs, min_length, min_count, id_col, text_col)
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best"))
    met = words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("best"), (-F.col("best.order")).alias("best_n"))
    follows = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    formed = stored(met.select("word", F.when(follows, F.col("best")).alias("form"), "n", "n_near", F.when(follows, F.col("best_n")).alias("form_n")), "words-forms")
    return formed.join(_roots(formed).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    rest = stored(formed.where("form IS NOT NULL").select("word", "form"), "words-linked")
    ends = rest.select("form").distinct().join(rest.select(F.col("word").alias("form")).hint("merge"), "form", "left_anti")
    level = stored(ends.select(F.col("form").alias("at"), F.col("form").alias("root")), "words-root")
    found = None
    while not level.isEmpty():
        small = F.broadcast(level) if level.count() <= MOST_GROUPS else level.hint("merge")
        level = stored(rest.join(small, rest["form"] == small["at"]).select(F.col("word").alias("at"), "root"), "words-root")
        found = level if found is None else found.unionByName(level)
    return found.withColumnRenamed("at", "word") if found is not None else rest.select("word", F.col("form").alias("root"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def _nibbles() -> str:
    """CRC-32 of four bits at a time: the polynomial's remainders of 0 to 15."""
    out = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return str(out)


OP13_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t GROUP BY 1, 2),
b AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM u WHERE length(run) >= {MIN_LENGTH}),
c AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x)), lambda k: CAST(strpos('0123456789ABCDEF', x[k - k % 2 + 2 - k % 2]) - 1 AS BIGINT)),
             lambda c, d: xor(c >> 4, {_nibbles()}[(xor(c, d) & 15) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM b),
w AS (SELECT CASE WHEN h % {SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM c),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
d AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT d.word AS a, v.word AS b FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word
                   UNION SELECT x.word, y.word FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
f AS (SELECT a, count(*) AS n_near, min(struct_pack(o := -v.n, w := b)) AS best FROM p JOIN v ON p.b = v.word GROUP BY a),
g AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= {RATIO} * v.n THEN best.w END AS form, CASE WHEN -best.o >= {RATIO} * v.n THEN -best.o END AS form_n FROM v LEFT JOIN f ON v.word = f.a),
r AS (SELECT word, word AS root FROM g WHERE form IS NULL UNION ALL SELECT g.word, r.root FROM g JOIN r ON g.form = r.word)
SELECT word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM g JOIN r USING (word)
"""
