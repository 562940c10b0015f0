import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import splitting as s

TURNS = "conv_id bigint, turn int, content string, ingested_at timestamp, n_chars string, pos int, own string"


@given(st.lists(st.sampled_from(["word ", "longer-word", ". ", "\n", "\n\n", "x" * 60, "é🧭 ", "! ", "a"]), max_size=160).map("".join))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_with_overlap(text):
    pieces = s.cut_text(text, 120, 20)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= 20
    assert all(b - a <= 120 for a, b in pieces)


def test_cuts_fall_on_boundaries():
    text = "\n\n".join("A sentence of some words here. Another one follows it now." for _ in range(30))
    assert all(text[:b].endswith("\n\n") for _, b in s.cut_text(text, 300, 30)[:-1])
    words = "word " * 400
    assert all(words[b - 1] == " " for _, b in s.cut_text(words, 200, 30)[:-1])


def test_the_overlap_is_held():
    text = "w" * 150 + " " + "v" * 3000 + " short words here " * 40
    for (_, b), (c, _) in itertools.pairwise(s.cut_text(text, 1000, 200)):
        assert 100 <= b - c <= 200
    with pytest.raises(ValueError):
        s.cut_text("some text", 200, 200)


def best_cost(sizes, limit, shared):
    """The least cost of a plan, by trying every way to cut in front of non-empty turns."""
    n, total = len(sizes), sum(sizes)
    pre = [0, *itertools.accumulate(sizes)]
    even = min(limit, total / max(1, -(-total // limit)))
    first = next(i for i, x in enumerate(sizes) if x)
    cuts = [0] + [i for i in range(first + 1, n) if sizes[i]] + [n]
    cost = {0: 0.0}
    for k, e in enumerate(cuts[1:], 1):
        ways = []
        for prev in cuts[:k]:
            if pre[e] - pre[prev] > limit and prev != cuts[k - 1]:
                continue
            start = wish = max(0, prev - shared)
            while start < prev and pre[e] - pre[start] > limit:
                start += 1
            ways.append(cost[prev] + 10.0 * (start - wish) + s.BALANCE * ((pre[e] - pre[start] - even) / limit) ** 2 + 0.05)
        cost[e] = min(ways)
    return cost[n]


def cost_of(plan, sizes, limit, shared):
    total = sum(sizes)
    even = min(limit, total / max(1, -(-total // limit)))
    out, prev = 0.0, 0
    for t in plan:
        out += 10.0 * (t[0] - max(0, prev - shared)) + s.BALANCE * ((sum(sizes[i] for i in t) - even) / limit) ** 2 + 0.05
        prev = t[-1] + 1
    return out


def test_plans_are_the_cheapest_and_do_not_depend_on_settling():
    rng = random.Random(4)
    for k in range(60):
        sizes = [rng.choice((0, rng.randint(0, 300), rng.randint(0, 40))) for _ in range(rng.randint(1, 90))] + [rng.choice((5, 1500))]
        plan = s.plan_sizes(sizes, 1000, 2)
        assert plan[0][0] == 0 and plan[-1][-1] == len(sizes) - 1
        assert all(d[-1] > b[-1] and d[0] <= b[-1] + 1 for b, d in itertools.pairwise(plan))
        assert all(sum(sizes[i] for i in t) <= 1000 or sum(sizes[i] > 0 for i in t) == 1 for t in plan)
        assert abs(cost_of(plan, sizes, 1000, 2) - best_cost(sizes, 1000, 2)) < 1e-9
        planner, early = s.Planner(sum(sizes), 1000, 2), []
        for i, n in enumerate(sizes):
            planner.push(i, n)
            if i % (1 + k % 7) == 0:
                early += planner.settle()
        assert [x for x, _ in early + planner.finish()] == plan
        assert len(planner.turns) <= len(sizes)


def test_settling_keeps_the_planner_small():
    rng, planner, most, done = random.Random(1), s.Planner(40_000 * 50, 1000, 2), 0, 0
    for i in range(40_000):
        planner.push(i, rng.randint(1, 99))
        if i % 500 == 0:
            done += len(planner.settle())
            most = max(most, len(planner.turns))
    assert most < 6000 and done > 1000


def test_oversized(spark):
    rows = [(1, 0, "x " * 3000, None, "e", 1, "o"), (1, 0, "x " * 3000, None, "e", 1, "o"), (1, 1, None, None, None, None, None), (2, 0, "a" * 4000, None, None, None, None), (3, 5, "word. " * 5000, None, None, None, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    assert {tuple(r) for r in s.oversized(df).collect()} == {(1, 0), (3, 5), (3, -1)}
    assert s.oversized(df.limit(0)).count() == 0
    latest = s.latest_turns(df, 4000)
    for r in s.split_turns(latest).collect():
        assert len(r.piece) <= 4000 and r.piece == ("x " * 3000 if r.conv_id == 1 else "word. " * 5000)[r.start_at : r.end_at]


def test_a_large_conversation_has_one_plan(spark):
    rng = random.Random(6)
    sizes = [rng.randint(0, 90) for _ in range(137)]
    df = spark.createDataFrame([(7, 3 * i, "y" * n, None, None, None, None) for i, n in enumerate(sizes)], TURNS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        plan = s.plan_chunks(s.latest_turns(df, 4000), 300, 2, settle=7).orderBy("chunk_no").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert [[t // 3 for t in r.turns] for r in plan] == s.plan_sizes(sizes, 300, 2)
    assert [r.chunk_no for r in plan] == list(range(len(plan))) and all(r.n_chars <= 300 for r in plan)
