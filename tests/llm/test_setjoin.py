import random
from datetime import datetime

from quillspan.llm import setjoin

SCHEMA = "note_id bigint, tags array<string>, phrases array<string>, indexed_at timestamp, id string, vals string, field_name string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


def test_like_brute_force(spark):
    rng = random.Random(9)
    base = [rng.sample([f"value {i}" for i in range(40)], rng.randint(3, 9)) for _ in range(40)]
    sets = []
    for i in range(260):
        b = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = f"value {rng.randrange(40)}"
        sets.append((i, b))
    got = {tuple(r) for r in setjoin.note_pairs(frame(spark, [(i, b, None, None) for i, b in sets])).collect()}
    want = set()
    for i, a in sets:
        for j, b in sets:
            x, y = set(a), set(b)
            if i < j and min(len(x), len(y)) >= 3 and 10 * len(x & y) >= 6 * len(x | y):
                want.add(("tags", i, j))
    assert got == want and len(want) > 100
    links = {r.note_id: r.n_links for r in setjoin.note_links(frame(spark, [(i, b, None, None) for i, b in sets])).collect()}
    for i, _ in sets:
        if i in links:
            assert links[i] == sum(i in p[1:] for p in want)


def test_crowded_bands_lose_no_link(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):  # all share two values; some share a third and a fourth
        rows.append((i, ["common", "usual", f"topic {rng.randrange(12)}", f"own {rng.randrange(60)}"], None, None))
    sets = setjoin.stored(setjoin.value_sets(frame(spark, rows), "note_id", ["tags"], "indexed_at"), "test-sets")
    _, split = setjoin.similar_classes(sets, hot=4)
    _, plain = setjoin.similar_classes(sets, hot=10**6)
    split, plain = {tuple(r) for r in split.collect()}, {tuple(r) for r in plain.collect()}
    vals = {r.id: set(r.vals) for r in sets.collect()}
    heads = {}
    for i in sorted(vals):
        heads.setdefault(frozenset(vals[i]), i)
    heads = sorted(heads.values())
    want = {(0, i, j) for i in heads for j in heads if i < j and 10 * len(vals[i] & vals[j]) >= 6 * len(vals[i] | vals[j])}
    assert split == plain == want and len(want) > 100


def test_large_and_long_sets(spark):
    big = [f"v{i}" for i in range(45_000)]
    rows = [(1, big, None, None), (2, big[:40_000], None, None), (3, big[:20_000], None, None), (4, ["x" * 100_000, "y", "z"], None, None), (5, ["x" * 100_000, "y", "z", "w"], None, None)]
    assert {tuple(r) for r in setjoin.note_pairs(frame(spark, rows)).collect()} == {("tags", 1, 2), ("tags", 4, 5)}


def test_cleaning_nulls_states_and_copies(spark):
    old, new = datetime(2020, 1, 1), datetime(2021, 1, 1)
    rows = [
        (1, ["#A-b", "c_d", "é"], None, None), (2, ["a  B", " C D", "é", None, " "], None, None), (3, ["a b", "c d"], None, None),
        (4, ["q", "r", "s"], None, old), (4, ["a b", "c d", "é"], None, new), (4, ["a b", "c d", "é"], None, new), (None, ["a b", "c d", "é"], None, None), (5, None, [], None),
    ]
    df = frame(spark, rows)
    assert {tuple(r) for r in setjoin.note_pairs(df).collect()} == {("tags", 1, 2), ("tags", 1, 4), ("tags", 2, 4)}
    assert {(r.note_id, r.class_id, r.n_links) for r in setjoin.note_links(df).collect()} == {(1, 1, 2), (2, 1, 2), (4, 1, 2)}
    assert setjoin.note_pairs(df.limit(0)).count() == 0
