"""What surrounds an article and what is part of it: comments by name and by structure, leads, formulas, lists of links."""

import pytest

from folio.llm.html_text import extract

P = [f"Paragraph {k} of the article tells at some length, and in whole sentences, what happened on day {k} and why it matters to its readers." for k in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in P)
WANT = "\n\n".join(P)


@pytest.mark.parametrize("comments", [
    '<article class="comment"><p>First!</p></article><article class="comment"><p>I do not agree with this at all.</p></article><article class="comment"><p>Nor do I.</p></article>',
])
def test_marked_articles_are_noise(comments):
    assert extract(f"<body><main><article>{BODY}</article>{comments}</main></body>") == WANT
    assert extract(f"<body><main><article>{BODY}{comments}</article></main></body>") == WANT


def test_a_marked_article_that_is_the_largest_stays():
    assert extract(f'<body><article>Other story</article><article class="post comments">{BODY}</article></body>') == WANT


@pytest.mark.parametrize("heading", ["Comments (3)", "3 Kommentare", "Commentaires", "Comentarios [12]", "Leserkommentare:"])
def test_comments_by_structure(heading):
    items = "".join(f'<div class="c-item"><b>User {k}</b><p>Short text number {k}, said by a reader.</p></div>' for k in range(3))
    assert extract(f"<body><article>{BODY}<section><h2>{heading}</h2>{items}</section></article></body>") == WANT
    assert extract(f"<body><main><article>{BODY}<h3>{heading}</h3>{items}</article></main></body>") == WANT


def test_an_article_about_comments_stays():
    got = extract(f"<body><article><h2>Comments</h2><p>{P[0]}</p><p>{P[1]}</p></article></body>")
    assert got == f"Comments\n\n{P[0]}\n\n{P[1]}"


@pytest.mark.parametrize("name", ["kommentare", "kopfzeile", "commentaires", "publicidad", "werbung"])
def test_names_of_four_languages(name):
    assert extract(f'<body><article>{BODY}<div class="{name}">Something short</div></article></body>') == WANT


def test_a_lead_beside_the_article():
    lead = "LEAD " + "that sums up what the article is about, in a sentence or two, for those in a hurry. " * 3
    got = extract(f'<body><nav><a href="/">Home</a></nav><main><div class="lead"><p>{lead}</p></div><article>{BODY}</article><div><a href="/a">Read also this</a></div></main></body>')
    assert got == lead.strip() + "\n\n" + WANT


def test_formulas_and_labels_in_prose():
    assert extract(f"<body><article>{BODY}<p>Formula <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> and <label>this</label>.</p></article></body>") == WANT + "\n\nFormula x=1 and this."


def test_a_list_of_links_goes_with_its_heading():
    links = "".join(f'<li><a href="/{k}">A source with a name, {k}</a></li>' for k in range(5))
    assert extract(f"<body><article>{BODY}<h2>Sources</h2><ul>{links}</ul></article></body>") == WANT
    assert extract(f"<body><article>{BODY}<h2>Last words</h2><p>{P[0]}</p><ul>{links}</ul></article></body>") == WANT + f"\n\nLast words\n\n{P[0]}"
