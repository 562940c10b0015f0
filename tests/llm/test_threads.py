import random
from datetime import datetime, timedelta

from quillspan.llm import threads

M = "chat_id bigint, node_id string, parent string, children array<string>, role string, content_type string, content string, is_hidden boolean, ingested_at timestamp, h string, pos string, up string"
S = "chat_id bigint, current_node string, updated_at timestamp, start string, n int"


def test_like_a_walk(spark):
    rng = random.Random(8)
    ms, ss = [], []
    for c in range(120):
        n = rng.randint(0, 9)
        ids = [f"n{i}" for i in range(n)]
        parent = {x: (None if i == 0 else ids[rng.randrange(max(0, i - 2), i)]) for i, x in enumerate(ids)}
        kids = {x: [y for y in ids if parent[y] == x] for x in ids}
        if n and rng.random() < 0.2:
            parent[rng.choice(ids)] = rng.choice(["gone", "", ids[-1]])
        for x in ids:
            if rng.random() < 0.05:
                continue
            role = rng.choice(["user", "Assistant ", "human", "AI", "system", None])
            if rng.random() < 0.7 and parent[x]:
                role = "assistant" if ids.index(x) % 2 else "user"
            ms.append((c, x, parent[x], rng.choice([kids[x], kids[x], kids[x] + ["gone"]]) if rng.random() < 0.1 else kids[x], role, rng.choice(["text"] * 6 + ["code", "tool"]), rng.choice(["hi"] * 8 + [" ", None]), rng.choice([None, False, False, True] if rng.random() < 0.2 else [None, False]), datetime(2024, 1, 2), None, None, None))
            if rng.random() < 0.2:
                ms.append((c, x, "old", [], "user", "text", "old", None, datetime(2024, 1, 1) if rng.random() < 0.5 else None, None, None, None))
        ss += [(c, rng.choice([None, "none", *ids[-2:]]), datetime(2024, 1, 1), "x", 1)] * rng.randint(0, 2)
    last = {}
    for m in sorted(ms, key=lambda m: m[8] or datetime(1, 1, 1)):
        last[m[0], m[1]] = m
    want = set()
    for c, cur in {s[:2] for s in ss}:
        rows = {k[1]: m for k, m in last.items() if k[0] == c}
        up = cur in rows
        roots = [x for x, m in rows.items() if not m[2]]
        if not up and len(roots) != 1:
            continue
        at, line, ok = cur if up else roots[0], [], True
        while True:
            if at not in rows or at in line:
                ok = False
                break
            line.append(at)
            m = rows[at]
            nxt = (m[2] or None) if up else (m[3][-1] if m[3] else None)
            if nxt is None:
                break
            at = nxt
        if not ok:
            continue
        who = {"user": "h", "human": "h", "assistant": "a", "ai": "a"}
        turns = [(x, who[m[4].strip().lower()]) for x in (line[::-1] if up else line) for m in (rows[x],) if (m[4] or "").strip().lower() in who and not m[7] and m[5] in ("text", "code") and (m[6] or "").strip()]
        if any(w == "h" for _, w in turns) and all(w == "a" or (i + 1 < len(turns) and turns[i + 1][1] == "a") for i, (_, w) in enumerate(turns)):
            want |= {(c, i + 1, x) for i, (x, _) in enumerate(turns)}
    messages, sessions = spark.createDataFrame(ms, M), spark.createDataFrame(ss, S)
    assert {tuple(r)[:3] for r in threads.conversations(sessions, messages).collect()} == want and want
    assert {r.chat_id for r in threads.verdicts(sessions, messages).where("verdict = 'kept'").collect()} == {w[0] for w in want}


def test_long_line_loop_nulls_and_empty(spark):
    t = datetime(2024, 1, 1)
    long = [(1, f"m{i}", f"m{i - 1}" if i else None, [], "user" if i % 2 == 0 else "ai", "text", "x", None, t + timedelta(seconds=i), None, None, None) for i in range(300)]
    loop = [(2, "a", "b", ["b"], "user", "text", "x", None, t, None, None, None), (2, "b", "a", ["a"], "ai", "text", "x", None, t, None, None, None)]
    nulls = [(3, None, None, None, None, None, None, None, None, None, None, None), (None, "q", None, None, None, None, None, None, None, None, None, None)]
    messages = spark.createDataFrame([*long, *loop, *nulls], M)
    sessions = spark.createDataFrame([(1, "m299", None, None, None), (2, "a", None, None, None), (3, "x", None, None, None), (None, None, None, None, None)], S)
    got = threads.conversations(sessions, messages).collect()
    assert sorted((r.turn_pos, r.node_id) for r in got) == [(i + 1, f"m{i}") for i in range(300)]
    assert threads.conversations(sessions.limit(0), messages).count() == 0 and threads.conversations(sessions, messages.limit(0)).count() == 0
