"""Oversized turns and conversations cut at natural boundaries.

``split_turns`` cuts every turn longer than ``max_chars`` into overlapping pieces; ``plan_chunks`` cuts every
conversation longer than its limit into lists of whole turns. Both choose the cuts by dynamic programming over the
boundary positions: the sum of cut penalties (paragraph < line < sentence < word < none) and of the squared
deviations from even sizes is least, subject to the size limit and the overlap.

A conversation is planned as a stream of turn sizes: the planner keeps the states of the last ``limit`` characters, and as
soon as all of them go back to the same cut, what lies before it is final and leaves the task. The result does not depend
on how long a conversation is or how its rows arrive.

Defined results: of a repeated (conv, turn) the row ingested last counts (NULL times first, then the longer, then
the greater text); NULL contents count as empty; a text without any boundary is cut at the limit; a single turn
over the conversation limit forms a list of its own; where two shared turns leave no room for another turn, fewer
are shared; empty turns stay with the turn before. An overlap begins at a word start if there is one in the first half of
the ``overlap`` characters before the cut, else exactly ``overlap`` characters before it. ``max_chars`` must exceed
``overlap``. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import stored

MAX_CHARS, OVERLAP = 4000, 200
CONV_CHARS, SHARED_TURNS = 24000, 2
#: Turns after which the planner looks for cuts that are final.
SETTLE = 4096

# The penalty of a cut by the best boundary that ends there.
PARAGRAPH, LINE, SENTENCE, WORD, NONE = 0.0, 0.05, 0.1, 0.4, 5.0
#: Weight of the squared relative deviation from the even size.
BALANCE = 2.0
#: Parts of the room of a piece: a longer stretch between two candidate cuts gets finer boundaries inside.
STRETCHES = 8

_LEVELS = (
    (re.compile(r"\n[ \t\r]*\n\s*"), PARAGRAPH),
    (re.compile(r"\n\s*"), LINE),
    (re.compile(r"(?<=[.!?…。！？])[\"'”’)\]]*\s+|(?<=[。！？])"), SENTENCE),
)
_WORD = re.compile(r"\s+")


def _candidates(text: str, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions in rising order with their penalties; the text's end is the last, at no penalty."""
    n, best, gap = len(text), {}, max(1, room // STRETCHES)
    for pattern, penalty in _LEVELS:
        for m in pattern.finditer(text):
            if 0 < m.end() < n:
                best.setdefault(m.end(), penalty)
    at = sorted(best)

    def fill(at: list[int], inner) -> list[int]:
        out, last = [], 0
        for p in [*at, n]:
            if p - last > gap:
                for q, penalty in inner(last, p):
                    if last < q < p and q not in best:
                        best[q] = penalty
                        out.append(q)
            out.append(p)
            last = p
        return [p for p in out if p < n]

    at = fill(at, lambda a, b: ((m.end(), WORD) for m in _WORD.finditer(text, a, b)))
    at = fill(at, lambda a, b: ((q, NONE) for q in range(a + max(1, gap // 4), b, max(1, gap // 4))))
    best[n] = 0.0
    at = [*at, n]
    return np.array(at), np.array([best[p] for p in at])


def _starts(text: str, ends: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece after a cut begins: ``overlap`` characters before it, or at the first word start in the first half
    of them."""
    out = np.maximum(ends - overlap, 0)
    for k, s in enumerate(out.tolist()):
        if s and not text[s - 1].isspace():
            m = _WORD.search(text, s, s + overlap // 2)
            if m and not text[m.end()].isspace():
                out[k] = m.end()
    return out


def cut_text(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The (start, end) of each piece; one piece if the text is within the limit."""
    n = len(text)
    if not 0 <= overlap < max_chars:
        raise ValueError("the overlap must be shorter than a piece")
    if n <= max_chars:
        return [(0, n)]
    ends, penalty = _candidates(text, max_chars - overlap)
    starts = np.concatenate(([0], _starts(text, ends, overlap)))  # starts[k]: of the piece after cut k, cut 0 at 0
    even = n / np.ceil((n - overlap) / (max_chars - overlap))
    cost = np.full(len(ends) + 1, np.inf)
    cost[0], back = 0.0, np.zeros(len(ends) + 1, dtype=np.int64)
    low = 0
    for k, (e, p) in enumerate(zip(ends.tolist(), penalty.tolist()), 1):
        while e - starts[low] > max_chars:
            low += 1
        size = e - starts[low:k]
        total = cost[low:k] + BALANCE * ((size - even) / max_chars) ** 2
        j = int(np.argmin(total))
        cost[k], back[k] = total[j] + p, low + j
    out, k = [], len(ends)
    while k:
        out.append((int(starts[back[k]]), int(ends[k - 1])))
        k = int(back[k])
    return out[::-1]


class Planner:
    """Lists of whole turns of one conversation, by dynamic programming over its stream of turn sizes.

    A state is a cut in front of a non-empty turn: the least cost of the lists up to there. Position p lies in front of
    turn p; ``pre[p]`` characters lie before it. Only states within ``limit`` characters are kept, besides the way back
    to the last cut that is final."""

    def __init__(self, total: int, limit: int, shared: int):
        self.limit, self.shared = limit, shared
        self.even = min(limit, total / max(1, -(-total // limit)))
        self.base, self.turns, self.pre = 0, [], [0]  # turns and their prefix sums from position ``base`` on
        self.at, self.cost = np.zeros(16, dtype=np.int64), np.zeros(16)  # the states, in order, from ``first`` to ``last``
        self.chars = np.zeros(16, dtype=np.int64)
        self.first, self.last, self.final, self.opened = 0, 1, 0, False
        self.back: dict[int, tuple[int, int]] = {}

    def _grow(self) -> None:
        if self.last == len(self.at):
            live = slice(self.first, self.last)
            size = max(16, 2 * (self.last - self.first))
            for name in ("at", "cost", "chars"):
                old = getattr(self, name)
                new = np.zeros(size, dtype=old.dtype)
                new[: self.last - self.first] = old[live]
                setattr(self, name, new)
            self.first, self.last = 0, self.last - self.first

    def _reach(self, end: int, chars: int) -> float:
        """The least cost of a cut at position ``end``; the way to it is kept."""
        lo = self.first + int(np.searchsorted(self.chars[self.first : self.last], chars - self.limit, "left"))
        self.first = min(lo, self.last - 1)
        at = self.at[self.first : self.last]
        wish = np.maximum(at - self.shared, 0)
        room = self.base + bisect.bisect_left(self.pre, chars - self.limit)
        start = np.maximum(wish, np.minimum(room, at))
        size = chars - np.array([self.pre[p - self.base] for p in start.tolist()])
        total = self.cost[self.first : self.last] + 10.0 * (start - wish) + BALANCE * ((size - self.even) / self.limit) ** 2 + 0.05
        k = len(total) - 1 - int(np.argmin(total[::-1]))
        self.back[end] = (int(at[k]), int(start[k]))
        return float(total[k])

    def push(self, turn: int, size: int) -> None:
        here = self.base + len(self.turns)
        if size and self.opened:
            chars = self.pre[-1]
            cost = self._reach(here, chars)
            self._grow()
            self.at[self.last], self.cost[self.last], self.chars[self.last] = here, cost, chars
            self.last += 1
        self.opened = self.opened or size > 0
        self.turns.append(turn)
        self.pre.append(self.pre[-1] + size)

    def _lists(self, end: int) -> list[tuple[list[int], int]]:
        out = []
        while end > self.final:
            prev, start = self.back[end]
            out.append((self.turns[start - self.base : end - self.base], self.pre[end - self.base] - self.pre[start - self.base]))
            end = prev
        return out[::-1]

    def settle(self) -> list[tuple[list[int], int]]:
        """The lists that no further turn can change; what led to them is forgotten."""
        ways = sorted(set(self.at[self.first : self.last].tolist()))
        while len(ways) > 1 and ways[-1] > self.final:
            p = self.back[ways.pop()][0]
            k = bisect.bisect_left(ways, p)
            if k == len(ways) or ways[k] != p:
                ways.insert(k, p)
        out, self.final = self._lists(ways[0]), ways[0]
        self.back = {e: b for e, b in self.back.items() if e > self.final}
        keep = max(self.base, self.final - self.shared)
        self.turns, self.pre = self.turns[keep - self.base :], self.pre[keep - self.base :]
        self.base = keep
        return out

    def finish(self) -> list[tuple[list[int], int]]:
        end = self.base + len(self.turns)
        if end == self.final:
            return []
        self._reach(end, self.pre[-1])
        return self._lists(end)


def plan_sizes(sizes: list[int], limit: int, shared: int) -> list[list[int]]:
    """Lists of positions in ``sizes``."""
    planner = Planner(sum(sizes), limit, shared)
    for i, n in enumerate(sizes):
        planner.push(i, n)
    return [x for x, _ in planner.finish()]


def latest_turns(turns: DataFrame, keep_longer_than: int) -> DataFrame:
    """(conv_id, turn, n_chars, content): one row per key; the content stays only where it is over the limit,
    so that the shuffle carries no short texts."""
    n = F.coalesce(F.length("content"), F.lit(0))
    row = F.struct(
        F.coalesce(F.col("ingested_at").cast("double"), F.lit(float("-inf"))).alias("at"),
        n.alias("n_chars"),
        F.when(n > keep_longer_than, F.col("content")).alias("content"),
    )
    return turns.groupBy("conv_id", "turn").agg(F.max(row).alias("r")).select("conv_id", "turn", "r.n_chars", "r.content")


def split_turns(latest: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (conv_id, turn, piece_no, start_at, end_at, piece) of the turns over ``max_chars``."""

    def cut(batches):
        for pdf in batches:
            rows = [
                (c, t, i, s, e, x[s:e])
                for c, t, x in zip(pdf.conv_id, pdf.turn, pdf.content)
                for i, (s, e) in enumerate(cut_text(x, max_chars, overlap))
            ]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "piece_no", "start_at", "end_at", "piece"])

    long = latest.where(F.col("n_chars") > max_chars).select("conv_id", "turn", "content")
    return long.mapInPandas(cut, "conv_id bigint, turn int, piece_no int, start_at int, end_at int, piece string")


def plan_chunks(latest: DataFrame, limit: int = CONV_CHARS, shared: int = SHARED_TURNS, settle: int = SETTLE) -> DataFrame:
    """Lists of turns (conv_id, chunk_no, first_turn, last_turn, n_turns, n_chars, turns) of the conversations over
    ``limit`` characters. Numbers alone travel; a task holds the states of the conversation it is at."""
    sizes = latest.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), "n_chars")
    over = sizes.groupBy("conv_id").agg(F.sum("n_chars").alias("total")).where(F.col("total") > limit)
    sizes = sizes.join(over, "conv_id").repartition("conv_id").sortWithinPartitions("conv_id", "turn")

    def plan(batches):
        planner, conv, number = None, None, 0

        def rows(lists):
            nonlocal number
            out = [(conv, number + i, t[0], t[-1], len(t), n, t) for i, (t, n) in enumerate(lists)]
            number += len(lists)
            return out

        def frame(out):
            return pd.DataFrame(out, columns=["conv_id", "chunk_no", "first_turn", "last_turn", "n_turns", "n_chars", "turns"])

        for pdf in batches:
            out = []
            for c, t, n, total in zip(pdf.conv_id.tolist(), pdf.turn.tolist(), pdf.n_chars.tolist(), pdf.total.tolist()):
                if planner is None or c != conv:
                    if planner is not None:
                        out += rows(planner.finish())
                    planner, conv, number = Planner(total, limit, shared), c, 0
                planner.push(t, n)
                if len(planner.turns) % settle == 0:
                    out += rows(planner.settle())
            yield frame(out)
        if planner is not None:
            yield frame(rows(planner.finish()))

    return sizes.mapInPandas(plan, "conv_id bigint, chunk_no int, first_turn int, last_turn int, n_turns int, n_chars bigint, turns array<int>")


def oversized(turns: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, conv_chars: int = CONV_CHARS) -> DataFrame:
    """(conv_id, turn) of the turns that came out in pieces, (conv_id, -1) of the conversations that came out in lists."""
    latest = stored(latest_turns(turns, max_chars), "turns-latest")  # read by both ways
    pieces = split_turns(latest, max_chars, overlap).where("piece_no = 0").select("conv_id", "turn")
    chunks = plan_chunks(latest, conv_chars).where("chunk_no = 0").select("conv_id", F.lit(-1).alias("turn"))
    return pieces.unionByName(chunks)
