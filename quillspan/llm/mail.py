"""Mails reduced to the text newly written by their sender.

Every mail is cut into pieces of about seven words at places that depend on the words alone, so that a quote has the same
pieces however it is wrapped, and also where only part of a sentence is quoted. Per thread, a pattern automaton is built
from those pieces of a mail that an earlier mail of the thread holds; the mail is scanned, matched intervals are merged
and subtracted. Closing blocks are learned: short lines and whole paragraphs that stand at the ends of mails in several
threads (formulas, legal notices), and lines that end several threads' mails of one sender (jobs, contacts). What neither
shows is read from the mail's own form: header blocks, prefixed quotes, introductions of quoted or passed on text,
signatures, device notes and rulers.

A thread is never brought together in one task: pieces are matched by (thread, hash), lines by hash; what reaches a mail
are those of its own pieces and lines that are known.

Defined results: of a repeated (conv_id, turn) the row ingested last counts; a NULL or empty content has no new line;
carriage returns before line feeds belong to the line end; mails with a NULL turn have no earlier mail. Extra columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.words import WordHashes, hash64
from quillspan.plans.blocks import latest
from quillspan.session import stored

#: Words on each side of the end of a piece that decide on it, and characters below which a piece is too common to show
#: a quote.
REACH, PIECE_CHARS = 3, 14
#: Threads that a closing line or paragraph must end mails of: of any sender, of one sender.
ANYONE, SAME_SENDER = 4, 2
#: What a hash stands for: a piece of a mail, a line or paragraph of anyone, a line of one sender.
PIECE, ANY_END, OWN_END = 0, 1, 2
#: Of the mails that hold a line, the share in which it must stand at the end to count as a closing line.
AT_END = 0.8
#: Characters of a line up to which it may be learned by itself; paragraphs behind it up to which it stands at the end.
SHORT, TAIL = 50, 3
#: Share of a line's characters inside matched intervals from which the line counts as earlier text.
COVERED = 0.8
#: Characters in a row that must be covered before text without any mark of a quote counts as earlier text.
MIN_STRETCH = 150
#: A quoted line without a sentence end may go on in the next line, unmarked, if it is at least this long.
MIN_WRAPPED = 35

_PREFIX = re.compile(r"^[ \t]*(?:[>|][ \t]?)+")
_UNENDED = re.compile(r"[^\s.!?…:;)>|\"'”»][ \t]*$")

# What mail programs and writers put around text, in the languages met.
_HEADER = re.compile(
    r"^[ \t*_]*(from|sent|to|cc|bcc|date|subject|reply-to|importance|von|gesendet|an|kopie|betreff|datum|de|envoyé|à|objet|date|para|enviado|asunto|assunto|data|van|verzonden|aan|onderwerp|от|отправлено|кому|тема|дата)[ \t]?:[*_]{0,2}(?=[ \t]|$)",
    re.I,
)
_HEADER_FIRST = re.compile(r"^[ \t*_]*(?:from|von|de|van|от)[ \t]?:", re.I)
_WROTE = r"(?:wrote|writes|schrieb|escribió|escribio|a écrit|a ecrit|escreveu|schreef|ha scritto|написал[аи]?|пишет)"
_MONTHED = r"\d{1,4}[./ -]\w{1,12}[./ -]\d{2,4}"
_INTRO = (
    re.compile(rf"^(?:on|am|el|le|il|em|op|в|\d).{{3,140}}?\b{_WROTE}\b.{{0,90}}:\s*$", re.I | re.S),
    re.compile(rf"^[^\n]{{2,90}}\b{_WROTE}\b.{{0,20}}{_MONTHED}.{{0,20}}:\s*$", re.I | re.S),
    re.compile(rf"^[\w.'’ -]{{2,50}}<[^>\n]+>[ \t]*\b{_WROTE}[ \t]?:\s*$", re.I),
    re.compile(rf"^{_MONTHED}(?:[ ,].{{0,20}})?,[ \t]*[\w.'’ -]{{2,50}}(?:<[^>\n]+>)?[ \t]*:\s*$"),
    re.compile(r"^[\w.'’-]+(?: [\w.'’-]+){0,2} <[^>\n]+@[^>\n]+>[ \t]*:\s*$"),
)
_BARE_INTRO = re.compile(rf"^[ \t]*[\w.'’ -]{{2,50}}\b{_WROTE}[ \t]?:\s*$", re.I)
_PASSED_ON = re.compile(
    r"^[-–—_ *]{0,40}(?:begin forwarded message|(?:original|forwarded) message|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|weitergeleitet"
    r"|mensaje (?:original|reenviado)|message (?:d'origine|original|transféré)|mensagem (?:original|encaminhada)|oorspronkelijk bericht|doorgestuurd bericht|исходное сообщение|пересылаемое сообщение)[-–—_ *:]{0,40}$",
    re.I,
)
# The plainest formulas; all others are learned.
_CLOSINGS = ("best regards", "kind regards", "regards", "sincerely", "yours sincerely", "thanks", "best", "mit freundlichen grüßen", "cordialement", "saludos", "met vriendelijke groet", "с уважением")
_CLOSING = re.compile(r"^(?:" + "|".join(sorted(map(re.escape, _CLOSINGS), key=len, reverse=True)) + r")(?:[ \t]*[,.!–—-]*[ \t]*$|[,.!–—-]*[ \t]+(?=\S))", re.I)
_DEVICE = re.compile(
    r"^[-–— \t]*(?:sent (?:from|via|on|with)\b|get \S+ for \S+|(?:von unterwegs )?gesendet\b|von (?:meinem|unterwegs)\b|envoyé (?:de|depuis)\b|enviado (?:desde|do|de)\b|verzonden (?:vanaf|met)\b|отправлено с\b)", re.I
)
_RULER = re.compile(r"^[ \t]*(?:[-–—_=*~#•][ \t]*){2,}$")
_IMAGE = re.compile(r"^[ \t]*(?:\[(?:image|cid|logo|signature|bild|photo|imagen)\b[^\]]*\]|<image\S*>)[ \t]*$", re.I)
_CONTACT = re.compile(
    r"^[ \t]*(?:(?:tel|phone|mobile?|mob|fax|cell|m|t|p|e|e-?mail|web|telefon|handy|tél|teléfono|телефон)\b[.:]{0,2}[ \t]*[+(\d]|(?:https?://|www\.)\S+[ \t]*$|\S+@\S+\.\S+[ \t]*$|[+(]?\d[\d ()./-]{6,}$)", re.I
)
_NUMBERED, _PARTS = re.compile(r"[^\W_]*\d[^\W_]*"), re.compile(r"[^\W_]+|[|:@/]")
_LEFT_OVER = re.compile(r"[^\W\d_]*[a-zà-öø-ÿа-я][^\W\d_]* ?.*[.?!]$|\d.*[.?!]$|[a-zà-öø-ÿа-я]")
_POSTSCRIPT = re.compile(r"^[ \t]*(?:p\.?[ ]?p?\.?s\.?|nachtrag|з\.?ы\.?)(?:[ \t]*[:.\-–—]|[ \t]+(?=\S))", re.I)
_NAME_LIKE = re.compile(r"^[-–—/ \t]*[^\W\d_][\w.'’-]*(?:[ \t]+[^\W\d_][\w.'’-]*){0,3}[ \t,]*$")
_ADDRESSED = re.compile(
    r"^[ \t]*(?:[*_]*(?:to|an|para|à|aan|кому)[ \t]?:[*_]*[ \t]*([^<\n]+)|(?:(?:dear|hi|hello|hey|hola|salut|bonjour|hallo|guten tag|liebe[r]?|buenos días|beste|olá)[, ]+)?([^\W\d_]{2,20})[ \t]*[,:!–-]{1,2}[ \t]*$)", re.I
)
_INITIAL = re.compile(r"^[-–—/ \t]*[^\W\d_]{1,2}\.?$")


def lines_of(content: str) -> list[str]:
    return [x[:-1] if x.endswith("\r") else x for x in content.split("\n")]


def flat(lines: list[str]) -> tuple[str, list[int]]:
    """The mail as one run of text without quote prefixes, blanks made single, and where each line begins in it.
    A line feed stands where a sentence cannot go on: at blank lines, behind header lines and greetings."""
    starts, parts, at, stop = [], [], 0, False
    for x in lines:
        bare = _PREFIX.sub("", x) if x.lstrip()[:1] in (">", "|") else x
        y = " ".join(bare.split()).lower()
        if parts and y:
            parts.append("\n" if stop else " ")
            at += 1
        starts.append(at)
        if y:
            parts.append(y)
            at += len(y)
        stop = not y or (":" in y[:24] and bool(_HEADER.match(bare))) or (len(y) < 32 and y[-1] in ",:-")
    return "".join(parts), starts


_store = WordHashes()


def pieces(text: str) -> list[str]:
    """The pieces of flat text as one run and, where they differ, of its parts between line feeds. A piece ends behind each word whose hash is the least among the REACH words before and
    behind it, so that only the REACH words next to a cut see what stands beyond it, and no piece is shorter."""
    parts = [part.split() for part in text.split("\n")]
    words = [w for part in parts for w in part]
    if not words:
        return []
    h, far = _store.of(words), np.iinfo(np.uint64).max
    breaks = np.cumsum([len(part) for part in parts])
    apart = np.full(len(words) + REACH * len(parts), far, dtype=np.uint64)  # the parts with REACH barriers behind each
    place = np.arange(len(words)) + REACH * np.repeat(np.arange(len(parts)), [len(part) for part in parts])
    apart[place] = h
    out: dict[str, None] = {}
    for ends in ({*(np.flatnonzero(_least(h, far)) + 1).tolist()}, {*(np.flatnonzero(_least(apart, far)[place]) + 1).tolist(), *breaks.tolist()}):
        last = 0
        for i in sorted(ends | {len(words)}):
            piece = " ".join(words[last:i])
            if len(piece) >= PIECE_CHARS:
                out[piece] = None
            last = i
    return list(out)


def _least(h: np.ndarray, far: int) -> np.ndarray:
    """Which values are less than the REACH values before them and not above the REACH behind."""
    out = h < far
    for k in range(1, REACH + 1):
        out[k:] &= h[k:] < h[:-k]
        out[:-k] &= h[:-k] <= h[k:]
    return out


def _paragraphs(lines: list[str]) -> list[list[int]]:
    """The numbers of the lines of each paragraph; a ruler is a paragraph of its own."""
    out, here = [], []
    for k, x in enumerate(lines):
        if not x.strip() or _RULER.match(x):
            if here:
                out.append(here)
            here = []
            if x.strip():
                out.append([k])
        else:
            here.append(k)
    return [*out, here] if here else out


def _plain(x: str, names: set[str]) -> str:
    """A line as it is counted: lower case, digits alike, the sender's own names out, no marks at the end."""
    words = _PARTS.findall(_NUMBERED.sub("0", x.lower()))
    own = names | {w[0] for w in names}
    return " ".join(w for w in words if w not in own)


def closing_keys(lines: list[str], sender: str | None, old: np.ndarray) -> list[tuple[int, int, bool, list[int]]]:
    """(scope, hash, at the end, lines) of the short lines of the own text and of its last paragraphs; ANY_END counts over all mails,
    OWN_END over those of the sender. Lines wrapped from a longer paragraph are left out."""
    names, out = own_words(sender), []
    who = " ".join(sorted(names))
    blocks = [[k for k in p if not old[k]] for p in _paragraphs(lines)]
    blocks = [p for p in blocks if p]
    for i, p in enumerate(blocks):
        end = len(blocks) - i - 1 <= TAIL
        whole = _plain(" ".join(lines[k] for k in p), names) if end else ""
        if whole:
            out.append((ANY_END, hash64("\x03" + whole), end, p))
        if max(len(lines[k].strip()) for k in p) <= SHORT:
            for k in p:
                line = _plain(lines[k], names)
                if line:
                    if len(p) > 1:
                        out.append((ANY_END, hash64("\x03" + line), end, [k]))
                    if who:
                        out.append((OWN_END, hash64(who + "\x02" + line), end, [k]))
        else:  # short lines right above or below longer ones; those that only end a wrapped sentence stand anywhere
            last = max(j for j, k in enumerate(p) if len(lines[k].strip()) > SHORT)
            for k in {p[0], *p[last + 1 :]} - {p[last]}:
                line = _plain(lines[k], names)
                if line and len(lines[k].strip()) <= SHORT and not _LEFT_OVER.match(lines[k].strip()):
                    out.append((ANY_END, hash64("\x03" + line), end, [k]))
    return out


def _is_intro(x: str) -> bool:
    return x.endswith(":") and len(x) < 240 and any(p.match(x) for p in _INTRO)


def _intro_lines(lines: list[str], i: int) -> int:
    """How many lines from ``i`` introduce quoted text (up to three, as they may be wrapped)."""
    joined = lines[i].strip()
    for n in (1, 2, 3):
        if _is_intro(joined):
            return n
        if i + n >= len(lines) or not lines[i + n].strip() or _PREFIX.match(lines[i + n]) or len(joined) > 200:
            return 0
        joined += " " + lines[i + n].strip()
    return 0


def _header_lines(lines: list[str], i: int) -> int:
    """How many lines from ``i`` form a header block (two lines of it at least)."""
    if not _HEADER_FIRST.match(lines[i]):
        return 0
    n = 0
    while i + n < len(lines) and _HEADER.match(lines[i + n]):
        n += 1
    return n if n >= 2 else 0


def _goes_on(quoted: str, line: str, known: bool) -> bool:
    """Is the line the rest of the quoted line above, wrapped without its prefix."""
    first = line.lstrip()[:1]
    if first.islower() or first.isdigit():
        return not re.search(r"[.!?…>|][)\"'”’»]*[ \t]*$", quoted)
    return not known and len(quoted) >= MIN_WRAPPED and bool(_UNENDED.search(quoted))


def covered_lines(lines: list[str], known: set[int]) -> np.ndarray:
    """Which lines lie in merged intervals that the automaton of the known pieces matches."""
    out = np.zeros(len(lines), bool)
    if not known:
        return out
    text, starts = flat(lines)
    patterns = {s for s in pieces(text) if hash64(s) in known}
    if not patterns:
        return out
    import ahocorasick

    machine = ahocorasick.Automaton()
    for p in patterns:
        machine.add_word(p, len(p))
    machine.make_automaton()
    marks = np.zeros(len(text) + 2, np.int32)  # merged intervals, as marks summed up
    for end, n in machine.iter(text.replace("\n", " ")):
        marks[end - n + 1] += 1
        marks[end + 1] -= 1
    hit = np.cumsum(marks) > 0
    for k, a in enumerate(starts):
        b = (starts[k + 1] - 1) if k + 1 < len(starts) else len(text)
        if b > a and hit[a:b].mean() >= COVERED:
            out[k] = True
    return out


def long_stretches(lines: list[str], covered: np.ndarray) -> np.ndarray:
    """The covered lines in stretches long enough not to agree by chance; blank lines do not end a stretch."""
    out, run, size = np.zeros(len(lines), bool), [], 0
    for k in [*range(len(lines)), -1]:
        if k >= 0 and (covered[k] or not lines[k].strip()):
            if covered[k]:
                run.append(k)
                size += len(lines[k].strip())
            continue
        if size >= MIN_STRETCH:
            out[run] = True
        run, size = [], 0
    return out


def own_words(sender: str | None) -> set[str]:
    """Lower-case parts of a sender's name or address."""
    return {w for w in re.split(r"[^\w]+", (sender or "").split("@")[0].lower()) if len(w) > 1}


def _is_sign(x: str, names: set[str]) -> bool:
    """A line that can only belong to a signature."""
    x = x.strip()
    if _CONTACT.match(x) or _IMAGE.match(x) or _DEVICE.match(x) or _RULER.match(x) or _INITIAL.match(x):
        return True
    parts = [w for w in re.split(r"[^\w]+", x.lower()) if w]
    if parts and names and _NAME_LIKE.match(x) and all(w in names for w in parts):
        return True
    return bool(re.match(r"^[-–—/][ \t]?\w+$", x)) or bool(re.match(r"^[^.!?]{2,50}[ \t]\|[ \t][^.!?]{2,40}$", x))


def closing_at(x: str) -> bool:
    """Is the line a closing formula, alone or with a name."""
    m = _CLOSING.match(x.strip())
    if not m:
        return False
    rest = x.strip()[m.end() :].strip()
    return not rest or bool(_NAME_LIKE.match(rest) and len(rest) <= 40 and all(w[:1].isupper() for w in rest.split()))


def earlier_text(lines: list[str], sender: str | None, known: set[int]) -> tuple[np.ndarray, set[str]]:
    """Which lines are earlier text, and the names of the sender as far as the mail shows them."""
    n = len(lines)
    blank = [not x.strip() for x in lines]
    old = np.zeros(n, bool)
    covered = covered_lines(lines, known)
    names = own_words(sender)

    i = 0
    while i < n and blank[i]:
        i += 1
    top = _header_lines(lines, i) if i < n else 0
    end = n  # own text ends where unmarked earlier text begins
    if top:
        m = re.match(r"^[^:]*:[*_]*\s*([^<]*)", lines[i])
        writer = own_words(m[1]) if m else set()
        if names and writer and not names & writer:
            end = i  # the header of another writer's mail: all of it is passed on
        names |= writer
        old[i : i + top] = True
        i += top

    while i < n and end == n:
        if blank[i]:
            i += 1
            continue
        if _PREFIX.match(lines[i]):
            old[i] = True
            i += 1
            continue
        k = _intro_lines(lines, i)
        if not k and _BARE_INTRO.match(lines[i]) and i + 1 < n and _PREFIX.match(lines[i + 1]):
            k = 1
        if k:
            j = i + k
            while j < n and blank[j]:
                j += 1
            old[i : i + k] = True
            if j < n and _PREFIX.match(lines[j]):
                i = j
                continue
            end = i
            break
        if _PASSED_ON.match(lines[i].strip()) or _header_lines(lines, i):
            end = i
            break
        if i and _PREFIX.match(lines[i - 1]) and _is_intro(_PREFIX.sub("", lines[i - 1]).strip() + " " + lines[i].strip()):
            old[i] = True  # an introduction inside the quote, wrapped without its prefix
        elif i and old[i - 1] and _PREFIX.match(lines[i - 1]) and _goes_on(lines[i - 1], lines[i], bool(known)):
            old[i] = True  # the rest of a quoted line that was wrapped without its prefix
        i += 1
    old[end:] = True
    old |= long_stretches(lines, covered)
    for k in range(1, n):  # an earlier line that lost its mark inside a quote
        if covered[k] and not old[k] and _PREFIX.match(lines[k - 1]) and (k + 1 == n or blank[k + 1] or _PREFIX.match(lines[k + 1])):
            old[k] = True
    if not names:  # the sender is whom the quoted mail speaks to
        for k in range(n):
            m = _ADDRESSED.match(_PREFIX.sub("", lines[k])) if old[k] else None
            if m and (m[1] or m[2][0].isupper()):
                names = own_words(m[1] or m[2])
                break
    return old, names


def analyse(lines: list[str], sender: str | None, known: set[int], closing: set[int]) -> list[int]:
    """The numbers of the new lines."""
    old, names = earlier_text(lines, sender, known)
    n = len(lines)
    blank = np.array([not x.strip() for x in lines], dtype=bool)
    learned = np.zeros(n, bool)
    if closing:
        for _, h, _, ks in closing_keys(lines, sender, old):
            if h in closing:
                learned[ks] = True
    gone = old | blank
    gone[_signature(lines, old, blank, learned, names, not own_words(sender))] = True
    return [k for k in range(n) if not gone[k]]


def _signature(lines, old, blank, learned, names, loose) -> list[int]:
    """Lines of closing formula, signature, device notes, rulers and learned closing blocks in the own text."""
    own = [k for k in range(len(lines)) if not old[k] and not blank[k]]
    sign: set[int] = set()
    first = None
    for at, k in enumerate(own):
        formula = closing_at(lines[k])
        if formula or (learned[k] and len(lines[k].strip()) <= SHORT and not (k and learned[k - 1])):
            rest = own[at + 1 :]
            signed = bool(rest) and (formula or learned[k]) and _signs(lines[rest[0]], names)
            ruled = next((i for i, r in enumerate(rest) if _RULER.match(lines[r])), len(rest)) if formula or signed else len(rest)
            body = sum(1 for i, r in enumerate(rest) if i < ruled and len(lines[r].strip()) > 60 and not learned[r] and not _in_postscript(lines, r))
            if body == 0 and (formula or signed or not rest or all(learned[r] or _is_sign(lines[r], names) or _in_postscript(lines, r) for r in rest)):
                first = k
                while at and not formula and (_is_sign(lines[own[at - 1]], names) or _is_name(lines, own[at - 1], names, loose)):
                    at -= 1
                    first = own[at]
                break
    if first is None:  # no formula: the block of signature lines at the end
        for k in reversed(own):
            if _in_postscript(lines, k):
                continue
            if _is_sign(lines[k], names) or learned[k]:
                first = k
                continue
            if _is_name(lines, k, names, loose) or _is_role(lines, k, own, names, loose):
                first = k
                continue
            break
    for k in own:
        x = lines[k].strip()
        if _RULER.match(x) or _IMAGE.match(x):
            sign.add(k)
        if first is not None and k >= first and not _in_postscript(lines, k):
            sign.add(k)
    return sorted(sign)


def _signs(x: str, names: set[str]) -> bool:
    """A line of only the sender's name or its first letter."""
    words = re.findall(r"[^\W_]+", x.lower())
    return bool(_INITIAL.match(x.strip())) or bool(words and names and len(words) <= 4 and all(w in names for w in words))


def _in_postscript(lines: list[str], k: int) -> bool:
    """Does line ``k`` belong to a paragraph that opens with P.S."""
    while True:
        if _POSTSCRIPT.match(lines[k]):
            return True
        if k == 0 or not lines[k - 1].strip():
            return False
        k -= 1


def _is_name(lines: list[str], k: int, names: set[str], loose: bool) -> bool:
    """A line of only a person's name: the sender's, or any name under a ruler or, if the sender is unknown, a blank line."""
    x = lines[k].strip()
    words = re.findall(r"[^\W_]+", x)
    if not words or len(x) > 40 or not _NAME_LIKE.match(x):
        return False
    if names and all(w.lower() in names for w in words):
        return True
    above = lines[k - 1].strip() if k else ""
    capital = len(words) <= 3 and all(w[:1].isupper() for w in words) and not re.search(r"\d", x)
    return capital and k > 0 and (bool(_RULER.match(above)) or (loose and not above))


def _is_role(lines: list[str], k: int, own: list[int], names: set[str], loose: bool) -> bool:
    """A short line without sentence marks right under a line of only a name."""
    x = lines[k].strip()
    return len(x) <= 45 and x[:1].isupper() and not re.search(r"[.!?:;,]$", x) and k - 1 in own and (_is_name(lines, k - 1, names, loose) or _is_sign(lines[k - 1], names))


def mails(turns: DataFrame) -> DataFrame:
    return turns.where("lower(trim(source_format)) = 'email' AND conv_id IS NOT NULL AND content IS NOT NULL")


def piece_hashes(m: DataFrame) -> DataFrame:
    """(conv_id, turn, scope, h, end) of all pieces and of the lines and paragraphs that may be learned."""

    def go(batches):
        for pdf in batches:
            conv, turn, scope, hashes, ends = [], [], [], [], []
            for c, t, x, s in zip(pdf.conv_id, pdf.turn, pdf.content, pdf.sender):
                lines = lines_of(x)
                hs = {(PIECE, hash64(y)): False for y in pieces(flat(lines)[0])} if t == t and t is not None else {}
                old, _ = earlier_text(lines, s, set())
                for sc, h, end, _ in closing_keys(lines, s, old):
                    hs[sc, h] = hs.get((sc, h), False) or end
                conv += [c] * len(hs)
                turn += [t] * len(hs)
                scope += [k[0] for k in hs]
                hashes += [k[1] for k in hs]
                ends += hs.values()
            yield pd.DataFrame({"conv_id": conv, "turn": turn, "scope": scope, "h": np.array(hashes, dtype=np.uint64).view(np.int64), "end": np.array(ends, dtype=bool)})

    return m.select("conv_id", "turn", "content", "sender").mapInPandas(go, "conv_id bigint, turn int, scope int, h bigint, end boolean")


def known_pieces(hashes: DataFrame) -> DataFrame:
    """(conv_id, turn, h): the pieces of each mail that an earlier mail of its thread holds."""
    own = hashes.where(F.col("scope") == PIECE).select("conv_id", "turn", "h")
    first = own.groupBy("conv_id", "h").agg(F.min("turn").alias("first"), F.max("turn").alias("last")).where("first < last")
    return own.join(first.select("conv_id", "h", "first"), ["conv_id", "h"]).where("first < turn").select("conv_id", "turn", "h")


def learned_closings(hashes: DataFrame) -> DataFrame:
    """(h): the lines and paragraphs that end mails of enough threads, and stand elsewhere in few."""
    threads = hashes.where(F.col("scope") != PIECE).groupBy("scope", "h", "conv_id").agg(F.max("end").alias("end"))
    counts = threads.groupBy("scope", "h").agg(F.count("*").alias("n"), F.sum(F.col("end").cast("int")).alias("ends"))
    need = F.when(F.col("scope") == ANY_END, F.lit(ANYONE)).otherwise(F.lit(SAME_SENDER))
    return counts.where((F.col("ends") >= need) & (F.col("ends") >= AT_END * F.col("n"))).select("h")


def _reduced(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line_nos, text) of every mail."""
    m = mails(turns)
    hashes = stored(piece_hashes(m), "mail-hashes")
    closings = hashes.where(F.col("scope") != PIECE).select("conv_id", "turn", "h").join(learned_closings(hashes), "h").select("conv_id", "turn", "h")
    known = known_pieces(hashes).withColumn("kind", F.lit(0)).unionByName(closings.withColumn("kind", F.lit(1)))
    known = known.groupBy("conv_id", "turn").agg(  # at most the pieces and lines of one mail
        F.collect_set(F.when(F.col("kind") == 0, F.col("h"))).alias("known"), F.collect_set(F.when(F.col("kind") == 1, F.col("h"))).alias("closing")
    )
    one = latest(m, ["conv_id", "turn"], F.col("ingested_at"), ["content", "sender"])

    def go(batches):
        for pdf in batches:
            rows = []
            for c, t, x, s, k, e in zip(pdf.conv_id, pdf.turn, pdf.content, pdf.sender, pdf.known, pdf.closing):
                lines = lines_of(x)
                seen, ends = (set(np.asarray(v, dtype=np.int64).view(np.uint64).tolist()) if v is not None else set() for v in (k, e))
                new = analyse(lines, s, seen, ends)
                rows.append((c, t, new, "\n".join(lines[i] for i in new)))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "line_nos", "text"])

    same = (one.conv_id == known.conv_id) & one.turn.eqNullSafe(known.turn)
    joined = one.join(known, same, "left").select(one.conv_id, one.turn, "content", "sender", "known", "closing")
    return joined.mapInPandas(go, "conv_id bigint, turn int, line_nos array<int>, text string")


def new_lines(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line_no) of the non-blank lines that the sender newly wrote."""
    return _reduced(turns).select("conv_id", "turn", F.explode("line_nos").alias("line_no"))


def new_texts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text): each mail reduced to its new lines, '' where it has none."""
    return _reduced(turns).select("conv_id", "turn", "text")
