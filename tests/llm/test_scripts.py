"""Operator 8: languages of many letters, and samples with one long document."""

import random

import numpy as np

from folio.llm import language_id


def brute_phrases(s, t):
    i, n = 0, 0
    while i < len(s):
        k = 1
        while i + k <= len(s) and s[i : i + k] in t:
            k += 1
        i, n = i + max(1, k - 1), n + 1
    return n


def text(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(n))


def test_letters_of_every_script_are_learned():
    rng = random.Random(8)
    latin, han, hangul = "abcdefghij", [chr(0x4E00 + i) for i in range(400)], [chr(0xAC00 + i) for i in range(300)]
    texts = {k: [text(rng, a, n) for n in (300, 200)] for k, a in (("la", latin), ("zh", han), ("ko", hangul))}
    p = language_id.CrossParser(texts)
    assert p.guess([text(rng, a, 40) for a in (latin, han, hangul)])[0] == ["la", "zh", "ko"]
    probes = [text(rng, a, n) for a in (latin, han, hangul, latin + "".join(han[:50]), "ω日") for n in (1, 30, 200)] + [texts["zh"][0][50:90]]
    coded = [p.alphabet.encode(t) for t in probes]
    got = p.phrases(coded)
    chars = lambda c: "".join(map(chr, c.tolist()))
    for k, lang in enumerate(p.langs):
        sample = "".join(chars(np.append(p.alphabet.encode(t), 0)) for t in texts[lang])
        for c, row in zip(coded, got, strict=True):
            assert row[k] == brute_phrases(chars(c), sample)


def test_whole_texts_across_windows():
    """Texts of many windows, periodic ones among them, whose phrases never begin where a window does, are cut as one."""
    rng = random.Random(10)
    texts = {"x": [text(rng, "abcd", 300), "aaa aba"], "y": [text(rng, "cdef", 300), "a" * 1100 + "b"]}
    p = language_id.CrossParser(texts)
    w = language_id.WINDOW
    probes = ["a" * n for n in (1, w - 1, w, w + 1, 7 * w + 3)] + ["ab" * 3 * w, "q" * 2 * w + "a", text(rng, "abcdef", 2000), text(rng, "abq", 900), "abc" * w + text(rng, "cdef", 400)]
    coded = [p.alphabet.encode(t) for t in probes]
    for k, lang in enumerate(p.langs):
        sample = "".join("".join(map(chr, np.append(p.alphabet.encode(t), 0).tolist())) for t in texts[lang])
        for c, row in zip(coded, p.phrases(coded), strict=True):
            assert row[k] == brute_phrases("".join(map(chr, c.tolist())), sample)


def test_scripts_of_east_and_west():
    """Samples of documents with words of a language's own, in Han, kana, Hangul, Cyrillic, Arabic and Latin letters: other texts of it are found again."""
    rng = random.Random(11)
    blocks = {"ar": (0x627, 30), "de": (0x61, 24), "el": (0x3B1, 24), "ja": (0x3042, 80), "ko": (0xAC00, 2000), "ru": (0x430, 32), "th": (0xE01, 46), "zh": (0x4E00, 3000)}
    letters = {k: [chr(a + i) for i in range(n)] for k, (a, n) in blocks.items()}
    p = language_id.CrossParser({k: [text(rng, x, 400) for _ in range(3)] for k, x in letters.items()})
    for k, x in letters.items():
        assert p.guess([text(rng, x, 20)])[0] == [k]


def test_samples_are_whole_documents_one_an_id(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(language_id, "TRAIN_CHARS", 3000)
    rows = [(1, f"copy {i}", "x") for i in range(300)] + [(i, text(rng, "dexyz", 100), "x") for i in range(2, 9)] + [(9, text(rng, "dexyz", 2000), "x"), (10, text(rng, "fgh", 3000), "y"), (None, "null", "x"), (11, None, "x")]
    seen = {}
    monkeypatch.setattr(language_id, "CrossParser", lambda texts: seen.update(texts))
    language_id.learn_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    whole = {t for _, t, _ in rows}
    assert set(seen) == {"x", "y"} and all(t in whole for ts in seen.values() for t in ts)
    assert sum(t.startswith("copy") for t in seen["x"]) == 1 and sum(map(len, seen["x"])) <= 3000 and len(seen["y"]) == 1
