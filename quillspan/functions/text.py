"""Column functions over text: pure Catalyst expressions, no Python runs.

Python ``strip`` trims all Unicode blanks while SQL ``trim`` trims spaces only, so blanks are cut by pattern; ``(?U)``
makes Java's classes Unicode-aware. NULL in gives NULL out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speaker labels and the role each stands for.
HUMAN_LABELS = ("human", "user", "ed", "you", "me", "q", "question")
ASSISTANT_LABELS = ("assistant", "ai", "claude", "chatgpt", "gpt", "bot", "model", "a", "answer", "copilot", "bing", "gemini")
# Words that anchor no concept.
STOPWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "into", "over", "under", "between", "within", "their", "your", "about", "when", "what",
    "which", "while", "using", "used", "than", "then", "have", "has", "are", "was", "were", "will", "shall", "note", "notes", "via", "per",
)
# Line patterns of low-signal text.
PAGE_OF = r"(?i)\bpage\s+\d+\s+of\s+\d+\b"
PLACEHOLDER = r"(?i)\[(image|logo|signature|cid:[^\]]*)\]"
FORWARDED = r"(?i)^\s*-+\s*forwarded message\s*-+\s*$"
STAMP = r"(?i)^\s*(confidential|proprietary|do not distribute)[\s:!.\-]*$"
AUTO_FOOTER = r"(?i)^\s*(sent from my \w+|get outlook for \w+)\s*$"
# Fixed value: a link between notes; target up to '|' or '#'.
WIKILINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"

TOKEN_FACTOR, TURN_OVERHEAD = 1.15, 8


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize(c) -> Column:
    """Trimmed, lower case, runs of blanks as one blank."""
    return F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")


def count_tokens(c) -> Column:
    """A quarter of the length, at least 1; 0 for NULL and empty text."""
    x = col(c)
    return F.when(x.isNull() | (x == ""), 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(x) / 4))).cast("bigint")


def estimate_tokens(c) -> Column:
    """Planning estimate with a safety factor in double arithmetic; at least 1, also for NULL and empty text."""
    raw = F.greatest(F.lit(1), F.floor(F.coalesce(F.length(col(c)), F.lit(0)) / 4))
    return F.floor(raw.cast("double") * F.lit(TOKEN_FACTOR)).cast("bigint")


def turn_cost(c) -> Column:
    return estimate_tokens(c) + TURN_OVERHEAD


def role_of(c) -> Column:
    """human, assistant or NULL for a label nobody knows."""
    key = F.regexp_replace(F.lower(strip(c)), r"\.+$", "")
    return F.when(key.isin(*HUMAN_LABELS), "human").when(key.isin(*ASSISTANT_LABELS), "assistant")


def export_role(c) -> Column:
    """The role of an exported message's sender: only four spellings count."""
    key = F.lower(strip(c))
    return F.when(key.isin("human", "user"), "human").when(key.isin("assistant", "ai"), "assistant")


def prose_like(c) -> Column:
    """False for tables (two lines with '|') and number blocks (over 0.3 digits)."""
    x = col(c)
    tables = F.size(F.filter(F.split(x, "\n"), lambda y: y.contains("|")))
    digits = F.length(F.regexp_replace(x, r"(?U)\D", ""))
    return (tables < 2) & ((F.length(x) == 0) | (digits / F.length(x) <= 0.3))


def wikilinks(c) -> Column:
    """Trimmed targets of all links, in order, repeats kept; NULL gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(WIKILINK), F.lit(1))
    return F.transform(found, strip)


def ascii_kebab(c, cut: int = 80) -> Column:
    """Slug of text that holds no accents any more (see ``functions.unicode.nfkd_ascii``)."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, cut), "-+$", "")
    return F.when(s == "", "untitled-note").otherwise(s)


def ascii_topic(c, cut: int = 50) -> Column:
    """Topic of text that holds no accents any more: case kept, 'Untitled' where nothing is left."""
    s = F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    s = F.regexp_replace(F.substring(s, 1, cut), "-+$", "")
    return F.when(s.isNull() | (s == ""), "Untitled").otherwise(s)


def without_index_prefix(c) -> Column:
    return F.regexp_replace(col(c), r"(?i)^\s*moc\s*[-–—:]\s*", "")


def tags_of(c) -> Column:
    """Distinct trimmed lower-case tags of an array; NULL gives an empty array."""
    xs = F.transform(F.filter(F.coalesce(col(c), F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.lower(strip(x)))
    return F.array_distinct(F.filter(xs, lambda x: x != ""))


def concept_phrases(c) -> Column:
    """Phrases of a title that anchor a concept match: the whole title from six letters on, distinctive words, and
    pairs of significant words that follow each other once the others are left out."""
    title = strip(c)
    words = F.regexp_extract_all(title, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*[A-Za-z0-9]|[A-Za-z0-9]"), F.lit(0))
    plain = lambda t: ~F.lower(t).isin(*STOPWORDS)
    distinctive = lambda t: t.contains("-") | t.rlike("[0-9]") | (F.length(t) >= 7) | ((F.length(t) >= 2) & (F.upper(t) == t) & t.rlike("[A-Z]"))
    single = F.transform(F.filter(words, lambda t: plain(t) & distinctive(t)), F.lower)
    significant = F.filter(words, lambda t: plain(t) & (F.length(t) >= 4))
    n = F.size(significant)
    pairs = F.zip_with(
        F.slice(significant, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(significant, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(F.lower(a), F.lit(" "), F.lower(b)),
    )
    pairs = F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.length(title) >= 6, F.array(F.lower(title))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(whole, single, pairs), lambda p: F.length(p) >= 4))


def phrase_in(phrase, hay) -> Column:
    """Does the phrase stand in the text, bounded by no ASCII letter or digit on either side."""
    quoted = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(col(phrase), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return F.regexp_like(col(hay), quoted)


def iso_utc(c) -> Column:
    """Epoch seconds as text to the second in UTC (session time zone UTC); NULL and 0 give NULL."""
    x = col(c).cast("double")
    return F.when(x.isNotNull() & (x != 0), F.date_format(F.timestamp_seconds(F.floor(x)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def transcript(turns) -> Column:
    """An array<struct<role, content, timestamp>> in order as one tagged text, turns numbered from 1."""
    stamp = lambda t: F.when(F.coalesce(t["timestamp"], F.lit("")) != "", F.concat(F.lit(" timestamp="), t["timestamp"])).otherwise("")
    one = lambda t, i: F.concat(F.lit('<turn n="'), (i + 1).cast("string"), F.lit('" role="'), F.upper(t["role"]), F.lit('"'), stamp(t), F.lit(">\n"), F.coalesce(t["content"], F.lit("")), F.lit("\n</turn>"))
    return F.array_join(F.concat(F.array(F.lit("<conversation>")), F.transform(col(turns), one), F.array(F.lit("</conversation>"))), "\n")


def fill_template(template, values: dict[str, Column]) -> Column:
    """Literal replacement of ``{name}`` by each value (NULL as empty)."""
    out = col(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(v, F.lit("")))
    return out


def low_signal_line(c) -> Column:
    """A line that is only a forwarding mark, a confidentiality stamp or an automatic footer."""
    x = col(c)
    return x.rlike(FORWARDED) | x.rlike(STAMP) | x.rlike(AUTO_FOOTER)


def without_inline_noise(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), PAGE_OF, ""), PLACEHOLDER, "")


def markdown_table(rows) -> Column:
    """array<array<string>> as a table: blanks in cells made single, '|' escaped, blank rows dropped, short rows filled;
    '' where nothing is left."""
    cell = lambda x: F.replace(strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")), F.lit("|"), F.lit("\\|"))
    clean = F.filter(F.transform(col(rows), lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda x: x != ""))

    def laid(rows, width):
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        body = F.concat(F.transform(F.slice(rows, 1, 1), line), F.array(rule), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line))
        return F.when(F.size(rows) > 0, F.array_join(body, "\n")).otherwise("")

    # bound to variables of a lambda: an outer expression inside a lambda would be computed again for every row
    bound = F.transform(F.array(clean), lambda c: F.struct(c.alias("rows"), F.array_max(F.transform(c, F.size)).alias("width")))
    return F.get(F.transform(bound, lambda b: laid(b["rows"], b["width"])), F.lit(0))


def index_warning(body, pct) -> Column:
    """An index note's body with a notice about image-only pages on top, under its heading if it has one."""
    notice = F.concat(
        F.lit("> ⚠ This source PDF was "), col(pct).cast("string"), F.lit("% image-only. Notes below reflect\n> only the extractable text. Visual content (diagrams, photos,\n> scanned pages) was not captured.")
    )
    x = col(body)
    first = F.substring_index(x, "\n", 1)
    rest = F.regexp_replace(F.substring(x, F.length(first) + 1, F.length(x)), r"^\n+", "")
    return F.when(first.rlike(r"^\s*#"), F.concat(first, F.lit("\n\n"), notice, F.lit("\n\n"), rest)).otherwise(F.concat(notice, F.lit("\n\n"), x))


FOOTER = "## Related (Cross-Session)"


def bullet(title, reason) -> Column:
    return F.concat(F.lit("- [["), col(title), F.lit("]] — "), col(reason))


def append_footer(body, bullets) -> Column:
    """The body with the bullets (array) under the footer heading, which is added unless it is there."""
    x = F.regexp_replace(F.coalesce(col(body), F.lit("")), r"(?U)\s+$", "")
    block = F.concat(F.array_join(col(bullets), "\n"), F.lit("\n"))
    return F.when(x.contains(FOOTER), F.concat(x, F.lit("\n"), block)).otherwise(F.concat(x, F.lit(f"\n\n{FOOTER}\n\n"), block))
