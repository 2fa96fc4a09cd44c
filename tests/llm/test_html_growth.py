"""Operator 1: pages without article or main, where the text lies in several parts."""

import pytest

from folio.llm import html_text

A, B, C = "a" * 200, "b" * 200, "c" * 100
LONG = "\n\n".join([B] * 10)
TEN = f"<div>{f'<p>{B}</p>' * 10}</div>"
LINKS = "<div><a href=1>one place</a> <a href=2>another place</a></div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div><div><p>{A}</p></div>{TEN}<div><p>{C}</p></div></div>", f"{A}\n\n{LONG}\n\n{C}"),
        (f"<body>{LINKS}<div><div><div><p>{A}</p></div></div><div>{TEN}</div>{LINKS}<div><p>{C}</p></div></div><div>Made by us</div></body>", f"{A}\n\n{LONG}\n\n{C}"),
        (f"<body><p>{A}</p><p>Short.</p>{TEN}<p>End.</p>{LINKS}</body>", f"{A}\n\nShort.\n\n{LONG}\n\nEnd."),
    ],
)
def test_parts_are_kept(page, text):
    assert html_text.extract(page) == text
