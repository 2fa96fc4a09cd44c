"""Operators 11, 12 and 13 against brute force on small tables with nulls, ties, repeats, clashing names and long rows, and against their SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import common, line_dedup, spelling_variants, vector_codes
from folio.llm.queries import ORACLES, QUERIES
from tests.llm.tests_data import SF

DOCS = "doc_id long, text string, lines string, gone long, row int, word string, n double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "l", 7, 1, "w", 0.5) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_vector_codes", "op13_spelling_variants"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


SHARED = "  A Line That Many\tShare \r"
LINES = [
    (5, f"first\n{SHARED}\nown line number five\n{SHARED}"), (2, f"{SHARED.strip().upper()}\nshort"), (9, "short\nshort\na line that many\tshare"), (7, None), (8, ""), (None, "only nulls hold this\nheld by null and four"),
    (None, "only nulls hold this\nétéétéétéé x\n"), (4, "held by null and four\nétéétéétéé x\nÉtéétéétéé x"), (4, "only id four has it\n\n\n"), (4, "only id four has it"), (6, "Étéétéétéé x\néééééééééé\nééééééééé"), (3, "éééééééééé\nééééééééé\n\x0b\x0ctail\x0b"),
    (11, "\n".join(f"filler {i % 40} of a long text" for i in range(20000))), (12, "filler 3 of a long text \nfiller 3 of a long text"),
]


def deduped(rows, min_docs=2, min_chars=10):
    holders = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == (float("inf") if i is None else i)]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return Counter(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_shared_lines_stay_in_the_smallest_document(spark, min_docs):
    got = line_dedup.dedup_lines(frame(spark, LINES).repartition(3), min_docs=min_docs)
    assert Counter((r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == deduped(LINES, min_docs)
    assert got.schema["row"].dataType.fieldNames() == DOCS.replace(",", "").split()[::2]


def test_hot_lines_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    got = line_dedup.dedup_lines(frame(spark, LINES))
    assert Counter((r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == deduped(LINES)


def test_empty_tables(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).isEmpty()
    assert spelling_variants.spelling_variants(frame(spark, [])).isEmpty()
    assert spelling_variants.spelling_variants(frame(spark, [(1, None), (2, "a bc")])).isEmpty()
    for rows in ([], [(1, None, 1, 2, "x")]):
        coded, books = vector_codes.encode(spark.createDataFrame(rows, VECTORS))
        assert coded.isEmpty() and books == [] and len(vector_codes.digest(books)) == 64


VECTORS = "vec_id long, embedding array<double>, label int, code long, v string"


def codes(rows, parts=4, entries=256, rounds=4):
    """Product quantisation as the words of the contract say it, in whole numbers."""
    dim = -(-max(len(x) for _, x, _ in rows) // parts) * parts
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [np.floor(1024 * c) for c in r[1]]))
    v = [[int(np.floor(1024 * c)) for c in x] + [0] * (dim - len(x)) for _, x, _ in kept]
    cut = [[tuple(x[p * dim // parts : (p + 1) * dim // parts]) for x in v] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for x in cut[p]:
                of[nearest(x, books[p])[1]].append(x)
            for i, xs in of.items():
                books[p][i] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    found = [[nearest(x, books[p]) for p in range(parts)] for x in zip(*cut, strict=True)] if not parts else [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(v))]
    errors = [sum(d for d, _ in f) for f in found]
    by = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    return Counter((i, label, "".join(f"{e:02x}" for _, e in f), err, by[label]) for (i, _, label), f, err in zip(kept, found, errors, strict=True)), books


@pytest.mark.parametrize("entries", [3, 256])
def test_codes_match_brute_force(spark, monkeypatch, entries):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(10)], (None, 1, 2)[i % 3]) for i in range(90)]
    rows += [(3, [0.25] * 10, 1), (3, [0.25] * 10, 1), (None, [-1.5] * 9, None), (95, [], 4), (96, [0.0] * 12, 4), (97, [-0.0001] * 12, 4), (98, [1e300, -1e300] + [0.0] * 8, 5)]
    bad = [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [float("inf")] * 10, 2)]
    saturated = [(i, [max(-131072.0, min(131072.0, c)) for c in x], label) for i, x, label in rows]
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    df = spark.createDataFrame([(*r, 5, "v") for r in rows + bad], VECTORS).repartition(3)
    got, books = vector_codes.encode(df, entries=entries)
    most = vector_codes.largest(3)
    assert most >= 131072 * 1024 and 3 * (2 * most) ** 2 < 2**62
    saturated = [(i, [max(-most / 1024, min(most / 1024, c)) for c in x], label) for i, x, label in rows]
    want, of = codes(saturated, entries=entries)
    assert [[tuple(map(int, e)) for e in b] for b in books] == of
    assert Counter(tuple(r) for r in got.select("vec_id", "label", "code", "error", "label_error").collect()) == want


def test_cells_bound_distances_and_filter_entries():
    rng = np.random.default_rng(3)
    book, q = rng.integers(-900, 900, (200, 6)), rng.integers(-2000, 2000, (300, 6))
    book[7] = book[3]
    cells = vector_codes.Cells(book)
    exact = ((q[:, None, :] - book[None, :, :]) ** 2).sum(2)
    lower, upper = cells.bounds(q)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.5  # most entries are never measured
    index, error = cells.nearest(q)
    assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


def variants(rows):
    n = Counter()
    import re

    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(others), n.get(form[w]))
    root = {w: w for w in n}
    for w in n:
        while form[root[w]]:
            root[w] = form[root[w]]
    return Counter((w, form[w], root[w], *out[w]) for w in n)


@pytest.mark.parametrize("bits", [27, 15, 3])
def test_variants_match_brute_force(spark, monkeypatch, bits):
    rng = random.Random(11)
    monkeypatch.setattr(spelling_variants, "MOST_BITS", bits)
    if bits == 15:
        monkeypatch.setattr(spelling_variants, "PIECE", 50)
        monkeypatch.setattr(spelling_variants, "MOST_HELD", 40)
    base = ["colour", "Färbung", "aaaaa", "aabaa", "ÿÿÿÿÿÿ", "straße", "letters", "×÷×÷×", "longer" * 30]
    made = set(base)
    while len(made) < 160:
        w = rng.choice(sorted(made))
        k = rng.randrange(len(w) + 1)
        made.add(rng.choice([w[:k] + rng.choice("abÀÿß") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abü") + w[k + 1 :]]))
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choices(sorted(made), k=200)) + "-Ānaïve") for _ in range(30)]
    rows += [(1, None), (2, ""), (3, "colour " * 3000), (3, "colour " * 3000), (4, "color1color2color,COLOR")]
    got = spelling_variants.spelling_variants(frame(spark, rows).repartition(3))
    assert Counter(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == variants(rows)


def test_neighbours_are_whole_and_distinct():
    every = lambda h: np.ones(h.shape, bool)
    for word in ("aab", "abcba", "zzzz"):
        made = [x for _, x in spelling_variants.neighbours([word], "abz", every)]
        want = {word[:k] + word[k + 1 :] for k in range(len(word))} | {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "abz"} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in "abz"}
        assert len(made) == len(set(made)) and set(made) == want - {word}
        seen = []
        list(spelling_variants.neighbours([word], "abz", lambda h, seen=seen: seen.append(h.ravel()) or np.ones(h.shape, bool)))
        hashes = {spelling_variants.word_hash(spelling_variants._points([x]))[0] for x in made}
        assert hashes <= set(np.concatenate(seen).tolist()) and len(hashes) == len(made)


def test_chains_of_forms(spark):
    words = spark.createDataFrame([("a1", "a2"), ("a2", "a3"), ("a3", None), ("b1", "a2"), ("c", None)], "word string, form string").withColumn("n", F.lit(1))
    assert {tuple(r) for r in spelling_variants._roots(words).collect()} == {("a1", "a3"), ("a2", "a3"), ("b1", "a3")}
    with pytest.raises(ValueError):
        spelling_variants.spelling_variants(frame(spark, []), ratio=1)


def test_digest_is_of_all_components():
    assert vector_codes.digest([np.array([[1, -2]]), np.array([[3, 4]])]) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_no_table_as_long_as_the_vocabulary_is_broadcast(spark):
    docs = spark.createDataFrame([(i, "garden gardem garden garden gardens") for i in range(9)], "doc_id long, text string")
    words = spelling_variants.vocabulary(docs)
    for df in (spelling_variants.near_words(words), spelling_variants.spelling_variants(docs)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
