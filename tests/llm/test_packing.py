"""Operator 7: exact round trip of every token id, and the curve."""

from collections import defaultdict

import numpy as np
import pytest
from tests_data import SF
from tokenizers import Tokenizer

from folio.llm import packing


def test_hilbert_curve_visits_every_cell_by_steps():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    h = packing.hilbert(g, 3)
    assert sorted(h) == list(range(512))
    assert (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_words_have_the_tokenizers_ids():
    t = Tokenizer.from_file(packing.default_tokenizer())
    v = packing._Vocabulary(packing.default_tokenizer())
    assert v.like
    texts = ["It's they'll we'VE <|endoftext|> a<|startoftext|>b ÀÉÎ Straße İstanbul Σίσυφος ﬁne éte 12.5% x_y-z…“q” 日本語 nb em \x1cfs \x85", "", " ", "''s 'd've ſoft ŉa ×÷ a×b"]
    texts += ["It's they'll we'VE 'S ''s 'd've ×÷ a×b Straße 12.5%\n\tx_y-z... don't 'tis"]
    split = [v.cut(x) for x in texts]
    assert isinstance(split[-1][0], str) and isinstance(split[0][0], bytes)
    ids, n, _ = v.encoded(split, 2)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("length", [16, 4096])
def test_round_trip(spark, length):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows += [(900, None), (901, ""), (902, "word " * 9000), (903, "same"), (903, "same"), (903, "other"), (None, "no id"), *[(1000 + i, "one text many times") for i in range(40)]]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, key int, ids int, start int")
    got = packing.pack(docs, packing.default_tokenizer(), length=length).collect()
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = defaultdict(list)
    for i, x in rows:
        want[i].append(tuple(t.encode(x or "", add_special_tokens=False).ids + [2]))
    at = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    pos = 0
    for s, o, n in at:  # the stream has no gap, so only its end is padded
        assert s * length + o == pos and o + n <= length
        pos += n
    assert pos == sum(len(x) for v in want.values() for x in v)
    pieces = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        pieces[r["doc_id"]].append((r["start"], r["length"], tuple(np.frombuffer(r["ids"], "<u4")), r["doc_tokens"]))
    for i, p in pieces.items():
        texts, now = [], ()
        for start, n, ids, total in p:
            assert start == len(now) and n == len(ids)
            now += ids
            if len(now) == total:
                texts.append(now)
                now = ()
        assert not now and sorted(texts) == sorted(want[i])
    assert packing.pack(docs.limit(0), packing.default_tokenizer()).count() == 0
