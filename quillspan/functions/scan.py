"""Line scans of one text: fences, headers, contents lists, quotes.

Each function sees one text at a time, so a row is all that a task holds; they run inside Arrow batches next to the
row (no shuffle). A fence line starts, after blanks, with three backticks or tildes; any fence line closes an open one.
"""

from __future__ import annotations

import re
from itertools import groupby

_OPAQUE = re.compile(r"^[^\S\n]*(?:```|~~~)[^\n]*(?:\n(?:.*?\n)??[^\S\n]*(?:```|~~~)[^\n]*(?=\n|\Z)|\n.*\Z|\Z)", re.M | re.S)
_META = re.compile(r"\A[^\S\n]*---[^\S\n]*\n(?:.*?\n)??[^\S\n]*---[^\S\n]*(?=\n|\Z)", re.S)
_LINES = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")

# Line and inline patterns of the cleaning rules.
_SEPARATOR = re.compile(r"[-=_]{11,}")
_HEADER = re.compile(r"(?:from|sent|to|cc|bcc|subject|date)\s*:", re.I)
_DROPPED = re.compile(r"\s*-+\s*forwarded message\s*-+\s*|\s*(?:confidential|proprietary|do not distribute)[\s:!.\-]*|\s*(?:sent from my \w+|get outlook for \w+)\s*", re.I)
_DISCLAIMER = re.compile(r"\s*this email and any attachments", re.I)
_INLINE = re.compile(r"\bpage\s+\d+\s+of\s+\d+\b|\[(?:image|logo|signature|cid:[^\]]*)\]", re.I)
_CONTENTS = re.compile(r".+?(?:\.{3,}|\t+|\s{3,})\s*\d{1,4}\s*$")
_ATTRIBUTION = re.compile(r"\s*On .+ wrote:\s*$")
QUOTED = "[previous message quoted -- already captured above]"


def lines_of(text: str) -> list[str]:
    """Lines by any Unicode line end; the empty rest after the last one is no line."""
    out = _LINES.split(text)
    return out[:-1] if out and out[-1] == "" else out


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, text) with kind text, code or yaml; joined by line feeds they give the text again."""
    spans, at = [], 0
    if m := _META.match(text):
        spans.append((m.start(), m.end(), "yaml"))
        at = m.end()
    spans += [(m.start(), m.end(), "code") for m in _OPAQUE.finditer(text, at)]
    out, last = [], None
    for start, end, kind in [*spans, (len(text), len(text), None)]:
        between = text[last or 0 : start]
        if last is None:
            plain = between[:-1] if kind else between
            if between or not kind:
                out.append(("text", plain))
        elif kind:
            if len(between) > 1:
                out.append(("text", between[1:-1]))
        elif between:
            out.append(("text", between[1:]))
        if kind:
            out.append((kind, text[start:end]))
        last = end
    return out


def on_text(text: str, f) -> str:
    """``f`` applied to the text segments; code and metadata stay as they are."""
    return "\n".join(f(x) if kind == "text" else x for kind, x in segments(text)).strip()


def collapse(x: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", x)


def clean_blanks(text: str) -> str:
    """Line ends trimmed, separator lines dropped, three or more spaces made one outside tables."""

    def f(x: str) -> str:
        kept = (y for y in (z.rstrip() for z in x.split("\n")) if not _SEPARATOR.fullmatch(y.strip()))
        return collapse("\n".join(y if "|" in y else re.sub(" {3,}", " ", y) for y in kept))

    return on_text(text, f)


def _header_runs(x: str):
    """Runs of lines: (is a header block, lines)."""
    for head, run in groupby(x.split("\n"), key=lambda y: bool(_HEADER.match(y.strip()))):
        yield head, list(run)


def plain(x: str) -> str:
    return re.sub(r"\s+", " ", x.strip().lower())


def _without_disclaimers(x: str) -> str:
    """Paragraph rests that start with a disclaimer are dropped before header blocks are looked for."""
    out, inside = [], False
    for y in x.split("\n"):
        inside = bool(y.strip()) and (inside or (not _HEADER.match(y.strip()) and not _DROPPED.fullmatch(y) and bool(_DISCLAIMER.match(y))))
        if not inside:
            out.append(y)
    return "\n".join(out)


def header_keys(text: str) -> list[str]:
    """The header blocks of a text in order, each as one plain line."""
    return [plain(" ".join(run)) for kind, x in segments(text) if kind == "text" for head, run in _header_runs(_without_disclaimers(x)) if head]


def clean_low_signal(text: str, repeated: set[int]) -> str:
    """Without low-signal lines; ``repeated``: places among ``header_keys`` of blocks that came before."""
    place = -1

    def f(x: str) -> str:
        nonlocal place
        out: list[str] = []
        for head, run in _header_runs(_without_disclaimers(x)):
            if head:
                place += 1
                out += [] if place in repeated else run
            else:
                out += [_INLINE.sub("", y) for y in run if not _DROPPED.fullmatch(y)]
        return collapse("\n".join(out))

    return on_text(text, f)


def clean_contents(text: str, least: int = 5) -> str:
    """Runs of at least ``least`` lines of a table of contents are dropped."""

    def f(x: str) -> str:
        out: list[str] = []
        for listed, run in groupby(x.split("\n"), key=lambda y: bool(y.strip() and _CONTENTS.match(y.strip()))):
            rows = list(run)
            if not (listed and len(rows) >= least):
                out += rows
        return "\n".join(out)

    return on_text(text, f)


def quote_blocks(x: str) -> list[tuple[bool, list[str]]]:
    """Runs of lines: (is a quote block, lines); a block is an introduction and the quoted or blank lines after it."""
    out: list[tuple[bool, list[str]]] = []
    open_block = False
    for y in x.split("\n"):
        intro, quoted = bool(_ATTRIBUTION.match(y)), y.lstrip().startswith(">")
        if open_block and (quoted or not y.strip()):
            out[-1][1].append(y)
        elif intro or quoted:
            out.append((True, [y]))
            open_block = True
        else:
            if not out or out[-1][0]:
                out.append((False, []))
            out[-1][1].append(y)
            open_block = False
    return out


def quoted_lines(block: list[str]) -> list[str]:
    """The lines of a quote block without marks, plain, blank ones and introductions left out."""
    return [p for y in block if y.strip() and not _ATTRIBUTION.match(y) for p in (plain(re.sub(r"^\s*>+\s?", "", y)),) if p]
