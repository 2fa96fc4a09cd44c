"""Operator 1: pages whose article is known."""

import pytest

from folio.llm import html_text

P = "A sentence of the article that is long enough to matter, with a second half. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<", "<"), ("<!-- open", ""), ("<script>var a='</p>';", ""),
        (f"<body><nav><a href=1>Home</a><a href=2>News</a></nav><article><h1>T &eacute;</h1><p>{P}<p>{P * 2}<br>end</article><footer>&copy; x</footer>", f"T é\n\n{P.strip()}\n\n{(P * 2).strip()} end"),
        (f"<body><div class='side-bar sidebar'>{P * 9}</div><div id=main><h1>T</h1><div><p>{P}</p><p>{P * 2}</p><p>x.</p></div></div><div id=comments><p>{P * 5}</p></div>", f"T\n\n{P.strip()}\n\n{(P * 2).strip()}\n\nx."),
        (f"<body><article><h2>A</h2><p>{P}</p><div class=ad>Buy</div><ul><li>one<li>two</ul><form>Name <input></form><p>b <i>c</i>\n d</p></article><aside>{P}</aside>", f"A\n\n{P.strip()}\n\none\n\ntwo\n\nb c d"),
        (f"<html><head><title>no</title><style>p{{}}</style></head><body><p>{P}</p><p>{P}</p></body></html>", f"{P.strip()}\n\n{P.strip()}"),
        (f"<body><section><h2>A</h2><p>{P}</p></section><section><h2>B</h2><p>{P * 2}</p><p>{P}</p></section>", f"A\n\n{P.strip()}\n\nB\n\n{(P * 2).strip()}\n\n{P.strip()}"),
        ("<article><p>&lt;b&gt; &#233; &#x41; &nbsp;&bogus; &amp;amp;</p></article>", "<b> é A &bogus; &amp;"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages(page, text):
    assert html_text.extract(page) == text


def test_rows(spark):
    d = spark.createDataFrame([(1, "u", "<p>a b</p>", "t", 1), (1, "u", None, "t", 1), (None, None, "", None, None)], "page_id long, url string, html string, text string, row int")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract_pages(d).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "a b", 3)]
    assert html_text.extract_pages(d.limit(0)).count() == 0
