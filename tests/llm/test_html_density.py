"""Operator 1: densities against a plain recursion, and pages where tags and names must not decide alone."""

import math
import random
import re

import pytest

from folio.llm import html_text

P = "A sentence of the article that is long enough to matter, with a second half. "
ONE, TWO = P.strip(), (P * 2).strip()


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if kind < 0.4 or depth > 4:
            out.append("word " * rng.randrange(1, 40))
        elif kind < 0.55:
            out.append(f"<a href=x>{'link ' * rng.randrange(1, 6)}</a>")
        else:
            tag = rng.choice(["div", "p", "section", "ul", "b"])
            out.append(f"<{tag}>{random_page(rng, depth + 1)}</{tag}>")
    return "".join(out)


def counts(x):
    """chars, tags, linked chars, linked tags below x, by recursion from the top."""
    if isinstance(x, str):
        return len(re.sub(r"\s+", " ", x).strip()), 0, 0, 0
    parts = [counts(c) for c in x.children]
    n = [sum(p[k] for p in parts) for k in range(4)]
    n[1] += sum(not isinstance(c, str) for c in x.children)
    return (n[0], n[1], n[0], n[1] + 1) if x.tag == "a" else tuple(n)


@pytest.mark.parametrize("seed", range(12))
def test_densities_match_a_recursion(seed):
    root = html_text.parse(f"<html><body>{random_page(random.Random(seed))}</body></html>")
    body = html_text.measure(root)
    c, _, lc, _ = counts(body)
    share = lc / max(1, c)
    nodes, stack = [], [body]
    while stack:
        x = stack.pop()
        nodes.append(x)
        stack += [y for y in x.children if not isinstance(y, str)]
    for x in nodes:
        assert (x.chars, x.tags, x.link_chars, x.link_tags) == counts(x)
        assert x.density == pytest.approx(naive(x, share), rel=1e-9, abs=1e-9)
        assert x.total == pytest.approx(sum(naive(y, share) for y in x.children if not isinstance(y, str)), rel=1e-9, abs=1e-9)


def naive(x, share):
    c, t, lc, lt = counts(x)
    if not c:
        return 0.0
    base = max(math.log(c * lc / max(1, c - lc) + share * c + math.e), 1e-9)
    return c / max(1, t) * math.log(max(1 + 1e-9, c / max(1, lc) * max(1, t) / max(1, lt))) / base


LINKS = "<ul>" + "".join(f"<li><a href={k}>Another story {k}</a></li>" for k in range(5)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # the whole body in one form
        (f"<body><form action=x><input type=hidden><div><article><h1>T</h1><p>{P}</p><p>{P * 2}</p></article></div><button>Go</button></form></body>", f"T\n\n{ONE}\n\n{TWO}"),
        (f"<body><form><div><p>{P}</p><p>{P * 2}</p></div><label>Name</label></form></body>", f"{ONE}\n\n{TWO}"),
        # a form within the article
        (f"<body><article><p>{P}</p><p>{P * 2}</p><form><fieldset><legend>Write</legend>Say what you think</fieldset></form></article></body>", f"{ONE}\n\n{TWO}"),
        # two articles, and small teasers beside one
        (f"<body><nav>{LINKS}</nav><article><p>{P}</p><p>{P}</p></article><article><p>{P * 2}</p><p>{P * 2}</p></article><footer>x</footer></body>", f"{ONE}\n\n{ONE}\n\n{TWO}\n\n{TWO}"),
        (f"<body><article><p>{P * 2}</p><p>{P * 2}</p><p>{P * 2}</p></article><article><a href=1>Read on</a> now</article></body>", f"{TWO}\n\n{TWO}\n\n{TWO}"),
        # lists of links within main
        (f"<body><main><p>{P}</p><p>{P * 2}</p><div><h3>More</h3>{LINKS}</div></main></body>", f"{ONE}\n\n{TWO}"),
        (f"<body><main><h1>T</h1><article><p>{P}</p><p>{P * 2}</p></article></main></body>", f"T\n\n{ONE}\n\n{TWO}"),
        # names of which a part is a word for noise
        (f"<body><article><p>{P}</p><div class='ad-hoc'><p>{P * 2}</p></div><div class='ad'>Buy this</div><section class='legal-analysis'><p>{P * 2}</p></section></article></body>", f"{ONE}\n\n{TWO}\n\n{TWO}"),
        # the title in the article's header
        (f"<body><header>Site name</header><article><header><h1>Title</h1></header><p>{P}</p><p>{P * 2}</p></article></body>", f"Title\n\n{ONE}\n\n{TWO}"),
        # a quote that is never closed
        (f"<body><article><p>{P}</p><p>See <a href=\"x>link</a> for more of the same kind of text, which goes on.</p></article></body>", f"{ONE}\n\nSee link for more of the same kind of text, which goes on."),
    ],
)
def test_pages_where_tags_do_not_decide(page, text):
    assert html_text.extract(page) == text
