"""Cleaning passes against plain walks over small conversations."""

import difflib
import random
import re

from quillspan.functions import scan
from quillspan.operators import chunks, passes

SCHEMA = "conv_id bigint, turn int, role string, content string, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, "human", x, None) for c, t, x in rows], SCHEMA)


def result(df):
    return sorted((r.conv_id, r.turn, r.content) for r in df.collect())


def noise(rng, n):
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    return " ".join(rng.choice(words) for _ in range(n))


def test_boilerplate_like_a_walk(spark):
    rng = random.Random(5)
    base = [noise(rng, 9) for _ in range(4)]
    rows = []
    for c in range(6):
        for t in range(7):
            ps = []
            for _ in range(rng.randint(1, 4)):
                p = rng.choice(base)
                if rng.random() < 0.5:
                    k = rng.randrange(len(p))
                    p = p[:k] + rng.choice("xyz") + p[k + 1 :]
                ps.append(p)
            rows.append((c, t, "\n\n".join(ps)))

    def walk(conv):
        reps, entries = [], []
        for t, x in conv:
            for k, p in enumerate(re.split(r"\n\s*\n", x)):
                n = scan.plain(p)
                if len(n) >= 30:
                    for rep in reps:
                        if abs(len(n) - len(rep[0])) <= 0.1 * max(len(n), len(rep[0])) and difflib.SequenceMatcher(None, n, rep[0]).ratio() >= 0.9:
                            rep[1].append((t, k))
                            break
                    else:
                        reps.append((n, [(t, k)]))
                entries.append((t, k, p))
        gone = {m for _, ms in reps if len(ms) >= 3 for m in ms[1:]}
        out = {}
        for t, k, p in entries:
            if (t, k) not in gone:
                out.setdefault(t, []).append(p)
        return {t: "\n\n".join(ps).strip() for t, ps in out.items()}

    want = sorted((c, t, x) for c in range(6) for t, x in walk([(t, x) for cc, t, x in rows if cc == c]).items() if x)
    assert result(passes.boilerplate(frame(spark, rows))) == want


def test_repeated_headers_once_per_conversation(spark):
    rows = [(1, 0, "From: a\nTo: b\n\nx"), (1, 1, "y\nfrom:  A\nTo: b"), (2, 0, "From: a\nTo: b\nz")]
    assert result(passes.low_signal(frame(spark, rows))) == [(1, 0, "From: a\nTo: b\n\nx"), (1, 1, "y"), (2, 0, "From: a\nTo: b\nz")]


def test_quotes_of_earlier_turns(spark):
    rows = [
        (1, 0, "The lantern stays lit until noon.\nBring two ropes please."),
        (1, 1, "fine\nOn Mon 3 x wrote:\n> The lantern stays lit until noon.\n> bring two  ropes please.\n\nok"),
        (1, 2, "> something never said before here\nend"),
        (2, 0, "> The lantern stays lit until noon."),
    ]
    got = dict(((c, t), x) for c, t, x in result(passes.quoted(frame(spark, rows))))
    assert got[1, 1] == f"fine\n{scan.QUOTED}\nok"
    assert got[1, 2] == rows[2][2] and got[2, 0] == rows[3][2]


def test_adjacent_repeats_keep_the_later(spark):
    rows = [(1, 0, "the very same words here"), (1, 1, "the very same words herE"), (1, 5, "other"), (1, 6, "")]
    assert [t for _, t, _ in result(passes.repeated_turns(frame(spark, rows)))] == [1, 5, 6]


def test_optimize_gate_report_and_fallback(spark):
    long = " ".join(f"word{i}" for i in range(600))
    rows = [(1, 0, "short"), (2, 0, long), (2, 1, "   "), (3, 0, long), (3, 1, "fail")]

    def clean(x):
        if x == "fail":
            raise RuntimeError("no")
        return x.upper()

    out, report = passes.optimize(frame(spark, rows), clean)
    text = {(r.conv_id, r.turn): r.content for r in out.collect()}
    assert text[1, 0] == "short" and text[2, 0] == long.upper() and text[3, 0] == long and (2, 1) not in text
    rep = {r.conv_id: r for r in report.collect()}
    assert rep[1].skipped and rep[1].final_tokens == rep[1].raw_tokens and not rep[2].skipped and rep[2].turns_dropped == 1


def test_empty_table(spark):
    e = frame(spark, []).limit(0)
    for step in (passes.boilerplate, passes.whitespace, passes.low_signal, passes.contents, passes.quoted, passes.repeated_turns):
        assert step(e).count() == 0
    out, report = passes.optimize(e)
    assert out.count() == 0 and report.count() == 0


def test_window_plan_covers_every_turn():
    rng = random.Random(1)
    for _ in range(200):
        costs = [rng.randint(9, 400) for _ in range(rng.randint(0, 40))]
        s = chunks.spans(costs, 1000, 600, 3)
        assert sorted({k for a, b in s for k in range(a, b)}) == list(range(len(costs)))
        assert all(sum(costs[a:b]) <= 1000 or b - a == 1 for a, b in s)
