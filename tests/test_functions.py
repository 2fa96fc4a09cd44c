"""Scalar functions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from folio.functions import geometry, ids, latex, numbers, text


def value(spark, make, *args):
    names = "abcdefgh"[: len(args)]
    d = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip(names, args, strict=True)])
    return d.select(make(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    ("claim", "source", "missing"),
    [("score 3.7", "score 13.7", ["3.7"]), ("regret 0.6", "see p.6 for details", ["0.6"]), ("weight 0.01", "the weight .01 is default", []), ("score 1.0", "score 1", []), ("from 007 to 2.50", "7 and 2.5", []), ("5 2 10", "", ["10", "2", "5"])],
)
def test_missing_numbers(spark, claim, source, missing):
    assert value(spark, numbers.missing_numbers, claim, source) == missing


def test_glued_numbers(spark):
    assert {"42.2", "71.1"} <= set(value(spark, numbers.number_keys, "gains from42.2%to71.1%"))


def test_text(spark):
    assert value(spark, text.normalize_text, "  A\t B\nß ") == "a b ss"
    assert value(spark, text.claim_key, "It's_a: Test 5!") == "itsatest5"
    assert value(spark, text.slug, "Attention Is All You Need!") == "attention-is-all-you-need"
    assert value(spark, text.slug, "注意") == "paper" and value(spark, text.slug, "x" * 60) == "x" * 48
    assert value(spark, text.contains_cjk, "a 中") and not value(spark, text.contains_cjk, "abc")
    assert value(spark, text.title_problems, "Results.") == ["generic", "trailing_period"]
    assert value(spark, text.title_problems, "a — b") == ["punctuation"] and value(spark, text.title_problems, "Fine title") == []
    assert value(spark, text.own_voice, "Here WE PROPOSE x") and not value(spark, text.own_voice, "They propose")
    assert value(spark, text.strip_trailing_punctuation, "标题。！ ") == "标题" and value(spark, text.ends_with_punctuation, "a? ")
    assert value(spark, text.keyword_overlap, "The Model wins", "a model") and not value(spark, text.keyword_overlap, "ab", "cd")
    assert value(spark, text.keyword_overlap, "提出注意力", "关于注意的") and not value(spark, text.keyword_overlap, "提出", "关于")
    assert value(spark, text.strip_comments, "5\\% kept % gone\nnext \\\\% gone") == "5% kept \nnext \\\\"
    assert value(spark, text.clean_latex, "self-\\textbf{attention}s") == "self-attentions"
    assert value(spark, text.clean_latex, "A \\textbf{bold}~claim \\cite{x,y} % c\nend") == "A bold claim end"
    assert value(spark, text.clean_cell, "\\textbf{\\emph{x}} \\& 5\\%") == "x & 5%"
    assert value(spark, text.is_heading, "2.1 Model Architecture") and not value(spark, text.is_heading, "this is a sentence.")


def test_ids(spark):
    a = value(spark, lambda c: ids.evidence_id(c, F.array(F.lit("s1"))), " Claim ")
    assert a == value(spark, lambda c: ids.evidence_id(c, F.array(F.lit("s1"))), "claim") and a.startswith("evidence_") and len(a) == 21


def test_geometry(spark):
    box = spark.createDataFrame([(0, 0, 10, 10, 5, 0, 10, 10), (0, 0, 10, 10, 20, 0, 5, 5)], "ax int, ay int, acx int, acy int, bx int, by int, bcx int, bcy int")
    assert [r[0] for r in box.select(geometry.intersection_ratio("a", "b")).collect()] == [0.5, 0.0]
    assert value(spark, lambda t: geometry.looks_overfull(t, F.lit(1.0), F.lit(0.2), F.lit(20.0)), "long text " * 20)
    f = value(spark, lambda w: geometry.contain_fit(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0), w, F.lit(1.0)), 2.0)
    assert (f["x"], f["y"], f["w"], f["h"]) == (0.0, 1.0, 4.0, 2.0)
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (960).to_bytes(4, "big") + (540).to_bytes(4, "big")
    d = spark.createDataFrame([(bytearray(png),), (bytearray(b"no"),)], "c binary").select(geometry.png_size(F.col("c")).alias("s")).collect()
    assert (d[0]["s"]["w"], d[0]["s"]["h"]) == (960, 540) and d[1]["s"] is None


def test_latex():
    assert latex.to_text(r"\frac{QK^{\top}}{\sqrt{d_k}} + x^{2} \leq 3") == "QK^⊤/√(d_k) + x² ≤ 3"
    files = {"main.tex": r"a \input{sec/one} \input{sec/one} \include{gone}", "sec/one.tex": r"one \input{two}", "sec/two.tex": "two"}
    assert latex.expand_includes(files, "main.tex") == r"a one two  \include{gone}"
    with pytest.raises(ValueError):
        latex.expand_includes({"m.tex": r"\input{../x}"}, "m.tex")
