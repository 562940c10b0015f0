"""Line scans against plain restatements of their rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.functions import scan

LINE = st.sampled_from(["", "a", "```", "```py", "  ~~~", "---", "text | x", "Human: hi", "> q", "To: x", "page 1 of 2", "Chapter .... 3", "-----------", "   ", "this email and any attachments x", "- forwarded message -"])
TEXT = st.lists(LINE, max_size=14).map("\n".join)


def by_lines(text):
    """Segments by a walk over the lines."""
    mark = lambda y: y.strip().startswith(("```", "~~~"))
    ls, i, out, buf = text.split("\n"), 0, [], []
    if ls[0].strip() == "---":
        end = next((j for j in range(1, len(ls)) if ls[j].strip() == "---"), None)
        if end is not None:
            out.append(("yaml", "\n".join(ls[: end + 1])))
            i = end + 1
    while i < len(ls):
        if mark(ls[i]):
            if buf:
                out.append(("text", "\n".join(buf)))
                buf = []
            j = next((j for j in range(i + 1, len(ls)) if mark(ls[j])), len(ls) - 1)
            out.append(("code", "\n".join(ls[i : j + 1])))
            i = j + 1
        else:
            buf.append(ls[i])
            i += 1
    return out + ([("text", "\n".join(buf))] if buf else [])


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_segments(text):
    assert scan.segments(text) == by_lines(text)
    assert "\n".join(x for _, x in scan.segments(text)) == text


@given(TEXT)
@settings(max_examples=200, deadline=None)
def test_code_is_never_touched(text):
    code = [x.strip() for k, x in scan.segments(text) if k == "code"]
    for f in (scan.clean_blanks, scan.clean_contents, lambda x: scan.clean_low_signal(x, set())):
        out = f(text)
        assert all(c in out for c in code)


def test_blanks():
    assert scan.clean_blanks("a   b  c\n----------\n===========\n| x    y |\n\n\n\nz  ") == "a b  c\n----------\n| x    y |\n\nz"


def test_low_signal():
    t = "From: a\nTo: b\n\nhello [logo] Page 1 of 2\nCONFIDENTIAL:\nSent from my phone\n--- Forwarded message ---\n\nThis email and any attachments are\nprivate\n\nend\nFrom: a\nTo:  b"
    assert scan.header_keys(t) == ["from: a to: b", "from: a to: b"]
    assert scan.clean_low_signal(t, {1}) == "From: a\nTo: b\n\nhello  \n\nend"


def test_header_inside_disclaimer_does_not_count():
    t = "this email and any attachments\nTo: x\n\nTo: x"
    assert scan.header_keys(t) == ["to: x"]


@pytest.mark.parametrize("n,kept", [(4, True), (5, False)])
def test_contents(n, kept):
    t = "\n".join(["x", *[f"Part {i} .... {i}" for i in range(n)], "y"])
    assert ("Part 0" in scan.clean_contents(t)) is kept


def test_quotes():
    blocks = scan.quote_blocks("a\nOn Monday x wrote:\n> b\n\n> c\nd")
    assert [q for q, _ in blocks] == [False, True, False]
    assert scan.quoted_lines(blocks[1][1]) == ["b", "c"]


def test_lines_by_any_end():
    assert scan.lines_of("a\r\nb\x0bc d\n") == ["a", "b", "c", "d"] and scan.lines_of("") == []
    assert re.split("x", "") == [""]
