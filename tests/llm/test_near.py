"""Operators 2 and 10 against brute force, and components against union-find."""

import random
from collections import Counter

import numpy as np
import pytest

from folio.llm import common, embedding_dedup, near_dedup
from folio.llm.textbatch import WordHashes, shingles


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(40)]
    want = union_find({x for p in pairs for x in p if p[0] != p[1]}, pairs)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for a, b in pairs if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, a, b = rng.integers(0, 2**63, 60, np.uint64), rng.integers(0, 2**63, 20, np.uint64), rng.integers(0, 2**63, 20, np.uint64)
        s = near_dedup.super_minhash([np.concatenate([both, a]), np.concatenate([both, b])])
        errors.append((s[0] == s[1]).mean() - 0.6)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < np.sqrt(0.6 * 0.4 / 128)
    one = near_dedup.super_minhash([np.array([7], np.uint64), np.zeros(0, np.uint64)])
    assert sorted(one[0] >> 24) == list(range(128)) and (one[1] == 0xFFFFFFFF).all()  # one element visits every position once


def sets_of(text, k):
    w = [x.lower() for x in (text or "").encode().split()]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for size in (6, 30, 120, 400):
        for _ in range(5):
            base = [rng.choice(vocabulary) for _ in range(size)]
            for _ in range(8):  # copies with edits: some chains link only through others
                copy = list(base)
                for _ in range(rng.randrange(0, max(2, size // 25))):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                texts[n] = " ".join(copy)
                n += 1
                base = copy if rng.random() < 0.5 else base
    texts |= {n: None, n + 1: "", n + 2: " \n\t", n + 3: "Two Words", n + 4: "two  words", n + 5: "two words three", n + 6: texts[0].upper()}
    rows = [(i, t, "x", 1) for i, t in texts.items()] + [(3, texts[3], "x", 1), (None, texts[0], "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, d string, bucket int")
    out = near_dedup.near_duplicates(d, k=k).collect()
    assert len(out) == len(rows)
    sets = {i: sets_of(t, k) for i, t in texts.items()}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(sets, links)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None
            continue
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_tile_joins_only_true_links(monkeypatch):
    import pandas as pd

    rng, cache = random.Random(9), WordHashes()
    base = [f"v{i}" for i in range(200)]
    docs = []
    for i in range(40):
        w = list(base)
        for _ in range(rng.randrange(3, 12)):
            w[rng.randrange(200)] = f"e{rng.random()}"
        docs.append(shingles(cache.of([x.encode() for x in w]), 4))
    sig = near_dedup.super_minhash(docs)
    bits = np.packbits((sig & 1).astype(np.uint8), axis=1).view(np.int64)
    p = pd.DataFrame({"nid": range(40), "c": range(40), "n": [len(s) for s in docs], "s1": bits[:, 0], "s2": bits[:, 1], "els": [s.view(np.int64) for s in docs]})
    both = pd.concat([p.assign(side=0), p.assign(side=1)])
    got = near_dedup._joining(both, 80)
    links = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(docs[i], docs[j])) >= 80 * len(np.union1d(docs[i], docs[j]))]
    assert union_find(range(40), links) == union_find(range(40), list(got.itertuples(index=False, name=None)))
    assert len(got) < 40 and set(map(tuple, map(sorted, got.to_numpy()))) <= set(map(tuple, map(sorted, links)))


@pytest.mark.parametrize("tile", [5, 2048])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(6):
            c = rng.normal(size=16)
            for _ in range(7):
                rows.append((n, [float(x) for x in np.float32(c + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2]))], label, "x"))
                n += 1
    rows += [(n, None, 0, "x"), (n + 1, [0.0] * 16, 0, "x"), (n + 2, [1.0, None] + [0.0] * 14, 0, "x"), (n + 3, [float("nan")] * 16, 0, "x"), (n + 4, [float("inf")] * 16, 0, "x"), (n + 5, rows[0][1], None, "x"), (n + 6, rows[0][1], 1, "x"), (n + 7, [1.0, 2.0], 0, "x"), (n + 8, [2.0, 4.0], 0, "x"), (n + 9, [], 0, "x"), (n + 10, [2 * x for x in rows[0][1]], 0, "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    out = {r["vec_id"]: r for r in embedding_dedup.near_vectors(d).collect()}
    ok = {i: np.array(v, float) for i, v, lab, _ in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    lab = {i: x for i, _, x, _ in rows}
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    links = [(i, j) for i in ok for j in ok if i < j and lab[i] == lab[j] and len(ok[i]) == len(ok[j]) and cos(ok[i], ok[j]) >= 0.98]
    degree, want = Counter(x for p in links for x in p), union_find([r[0] for r in rows], links)
    assert len(out) == len(rows) and links
    for i, r in out.items():
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], want[i], i == want[i]), i
    assert embedding_dedup.near_vectors(d.limit(0)).count() == 0
