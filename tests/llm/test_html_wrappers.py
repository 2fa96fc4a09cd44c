"""Operator 1: names of noise on wrappers and sections of the article."""

import pytest

from folio.llm import html_text

P = "A sentence of the article that is long enough to matter, with a second half. "
ONE, TWO = P.strip(), (P * 2).strip()
SIDE = f"<div class=sidebar><p>{P}</p></div>"
NOTES = f"<div id=comments><article class=comment-body><p>{P * 9}</p></article></div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><div class='content-sidebar-wrap'><main><p>{P}</p><p>{P * 2}</p></main>{SIDE}</div></body>", f"{ONE}\n\n{TWO}"),
        (f"<body><div class='layout has-sidebar'><div><p>{P}</p><p>{P * 2}</p><p>{P * 2}</p></div>{SIDE}</div></body>", f"{ONE}\n\n{TWO}\n\n{TWO}"),
        (f"<body><article><p>{P}</p><section class='legal-analysis'><p>{P * 2}</p></section><div class='tags-politics'><p>{P * 2}</p></div><p>{P}</p></article></body>", f"{ONE}\n\n{TWO}\n\n{TWO}\n\n{ONE}"),
        (f"<body><article><p>{P * 2}</p><div class='share-buttons'>Share this</div><div class='related-posts'><a href=1>{P * 2}</a></div></article>{NOTES}</body>", TWO),
        (f"<body><div class=has-sidebar><main><p>{P * 2}</p><div class=related><article><p>{P}</p></article></div></main>{SIDE}</div>{NOTES}</body>", TWO),
    ],
)
def test_names_on_wrappers(page, text):
    assert html_text.extract(page) == text
