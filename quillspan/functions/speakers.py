"""Speaker turns and markup of plain text transcripts as column expressions; no Python runs.

Line ends of any kind become line feeds first. A fence line starts, after blanks, with three backticks or tildes; any
fence line closes an open one. Cut in front of fence lines, the parts of a text lie outside and inside of fences in turn,
so what holds outside of fences is a replacement in every other part. Speaker lines outside of fences get a mark in
front, one of the characters that count as line ends and so occur in no line; the marks then split the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import ASSISTANT_LABELS, HUMAN_LABELS, col, strip

LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
_MARK = "\x1c"
_BL = r"[^\S\n]"  # a blank inside a line
_FENCE = rf"(?dmU)(?=^{_BL}*(?:```|~~~))"

# Lines of chat windows, tags, source lines and marks of exports, and how speakers are written.
_UI = r"copy code|copied!?|copy|retry|regenerate(?: response)?|share|edited|thumbs up|thumbs down|stop generating|ai-generated content may be incorrect\.?"
_TAGS = (
    "div|span|p|br|hr|b|i|em|strong|u|img|a|ul|ol|li|table|tr|td|th|thead|tbody|h[1-6]|blockquote|pre|details|summary|sup|sub|small|section|article|header|footer|nav|figure|figcaption"
)
_SOURCES = r"learn more:?|sources?:?|references?:?|ai-generated content may be incorrect\.?|copilot uses ai\. check for mistakes\.?"
_COPILOT = "You said|You|Me|User said|User|Copilot said|Copilot|Bing said|Bing|Microsoft 365 Copilot|M365 Copilot|Microsoft Copilot"
_COPILOT_STARTS = rf"copilot(?:{_BL}+said)?|bing|microsoft 365 copilot|microsoft copilot"

_LABELS = "|".join((*HUMAN_LABELS, *ASSISTANT_LABELS))
_SPEAKER = rf"{_BL}*(?:#{{1,6}}{_BL}+((?i-u:{_LABELS}))\.*{_BL}*:?{_BL}*(?:\n|\z)|[*_]{{0,2}}((?i-u:{_LABELS}))\.*[*_]{{0,2}}{_BL}*[:：]{_BL}*)"
_COPILOT_SPEAKER = rf"{_BL}*(?:#{{1,6}}{_BL}+)?[*_]{{0,2}}((?i-u:{_COPILOT}))[*_]{{0,2}}{_BL}*[:：]?{_BL}*"


def unified(c) -> Column:
    """Lines end in line feeds; the last line has none."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c), F.lit("")), LINE_END, "\n"), r"\n\z", "")


def outside_fences(c: Column, change) -> Column:
    """``change`` applied to the text outside of fences; fence lines stay as they are."""
    def one(part, i):
        fence = F.regexp_extract(part, r"\A[^\n]*\n?", 0)
        rest = F.substring(part, F.length(fence) + 1, F.length(part))
        return F.when(i % 2 == 1, part).when(i == 0, change(part)).otherwise(F.concat(fence, change(rest)))

    # a line feed in front, so that a fence in the first line begins the second part
    joined = F.array_join(F.transform(F.split(F.concat(F.lit("\n"), c), _FENCE, -1), one), "")
    return F.regexp_replace(joined, r"\A\n", "")


def without_citations(c: Column) -> Column:
    """Lists of sources, footnotes and citation marks removed."""
    def change(x):
        for pattern in (
            rf"(?dmiU)^{_BL}*(?:(?:{_SOURCES}|\d+{_BL}+of{_BL}+\d+{_BL}+responses?){_BL}*|\[\d+\][:.]?{_BL}+\S+[^\n]*)(?:\n|\z)",
            rf"(?U){_BL}*[\[⁽]\d+[\]⁾]", "[¹²³⁰⁴-⁹]+",
        ):
            x = F.regexp_replace(x, pattern, "")
        return x

    return outside_fences(c, change)


def without_markup(c: Column) -> Column:
    """Chat-window lines and common tags removed, blank lines collapsed, trimmed."""
    def change(x):
        return F.regexp_replace(F.regexp_replace(x, rf"(?dmiU)^{_BL}*(?:{_UI}){_BL}*(?:\n|\z)", ""), rf"(?i)</?(?:{_TAGS})\b[^>\n]*/?>", "")

    return strip(F.regexp_replace(outside_fences(c, change), r"\n{3,}", "\n\n"))


def clean_markup(c) -> Column:
    return without_markup(unified(c))


def speaker_turns(c, copilot: bool = False) -> Column:
    """array<struct<role, content>> in order. Lines before the first speaker are a human's; empty turns are left out."""
    speaker = _COPILOT_SPEAKER if copilot else _SPEAKER
    marked = outside_fences(unified(c), lambda x: F.regexp_replace(x, rf"(?dmU)^(?={speaker})", _MARK))

    def turn(piece, i):
        label = F.lower(F.concat(F.regexp_extract(piece, rf"(?U)\A{speaker}", 1), F.lit("") if copilot else F.regexp_extract(piece, rf"(?U)\A{speaker}", 2)))
        human = label.rlike("^(you|me|user)") if copilot else label.isin(*HUMAN_LABELS)
        body = F.when(i == 0, piece).otherwise(F.regexp_replace(piece, rf"(?U)\A{speaker}", ""))
        role = F.when((i == 0) | human, F.lit("human")).otherwise("assistant")
        return F.struct(role.alias("role"), without_markup(without_citations(body) if copilot else body).alias("content"))

    return F.filter(F.transform(F.split(marked, _MARK, -1), turn), lambda t: t["content"] != "")


def plain_turns(c) -> Column:
    """Speaker turns, or the whole cleaned text as one human turn where there are fewer than two."""
    turns, whole = speaker_turns(c), clean_markup(c)
    one = F.array(F.struct(F.lit("human").alias("role"), whole.alias("content")))
    return F.when(F.size(turns) >= 2, turns).otherwise(F.filter(one, lambda t: t["content"] != ""))


def looks_copilot(c) -> Column:
    """Does one of the first 200 lines start with the name of that assistant."""
    return F.substring_index(unified(c), "\n", 200).rlike(rf"(?dmiU)^{_BL}*(?:#{{1,6}}{_BL}+)?[*_]{{0,2}}(?:{_COPILOT_STARTS})")
