import random

import numpy as np

from quillspan.llm import leaks
from quillspan.llm.words import words

D, I = "doc_id bigint, text string, item_id string, tiles string", "item_id bigint, text string, doc_id string"


def ids(a, b):
    at = {}
    return [np.array([at.setdefault(w, len(at)) for w in x]) for x in (a, b)]


def test_like_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(25)] + [(3, None), (None, "x"), (90, "same " * 14)]
    docs = []
    for k in range(120):
        ws = [rng.choice(vocab) for _ in range(30)]
        for _ in range(rng.randint(0, 2)):
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(src) + 1)
            ws[5:5] = [w.upper() + "," for w in src[a : a + rng.randint(8, 16)]]
        docs.append((k, " ".join(ws), "x", "y"))
    docs += [(500, None, None, None), (501, "", None, None), (502, "same " * 13, None, None), (502, "same " * 13, None, None), (None, "same " * 13, None, None)]
    runs = lambda t: set(zip(*(words(t or "")[k:] for k in range(12))))
    text = {}
    for i, t in items:
        if i is not None and t is not None:
            text[i] = t
    want = {(k, i) for k, t, _, _ in docs if k is not None for i, x in text.items() if runs(t) & runs(x)}
    df, it = spark.createDataFrame(docs, D), spark.createDataFrame([(i, t, "z") for i, t in items], I)
    got = leaks.leaks(df, it, coverage=None)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want

    def covered(x, y):
        return sum(k for _, _, k in leaks.tile(*ids(words(x), words(y)), 5))

    docs_of = {k: t for k, t, _, _ in docs if k is not None and t}
    loose = want | {(k, i) for k, t in docs_of.items() for i, x in text.items() if words(x) and 2 * covered(t, x) >= len(words(x))}
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, it).collect()} == loose and loose > want
    assert leaks.leaks(df, it.limit(0)).count() == 0 and leaks.leaks(df.limit(0), it).count() == 0


def test_reordered_passages_are_covered(spark):
    a, b = [f"a{i}" for i in range(20)], [f"b{i}" for i in range(15)]
    df = spark.createDataFrame([(1, " ".join(["x", *b, "y", *a]), None, None)], D)
    r = leaks.leaks(df, spark.createDataFrame([(7, " ".join(a + b), None)], I)).first()
    assert (r.longest, r.tiles, r.matched_words, r.coverage) == (20, 2, 35, 1.0)


def test_short_reordered_runs_leak_by_coverage_only(spark):
    item = [f"a{i}" for i in range(110)]
    runs = [item[k : k + 11] for k in range(0, 110, 11)]
    random.Random(3).shuffle(runs)
    df = spark.createDataFrame([(1, " ".join(w for k, r in enumerate(runs) for w in [*r, f"x{k}"]), None, None), (2, " ".join(item[:54]), None, None), (3, " ".join(item[:11]), None, None)], D)
    it = spark.createDataFrame([(7, " ".join(item), None)], I)
    got = {r.doc_id: r for r in leaks.leaks(df, it).collect()}
    assert set(got) == {1, 2} and got[1].longest == 11 and got[1].coverage == 1.0
    assert {r.doc_id for r in leaks.leaks(df, it, coverage=None).collect()} == {2}


def slow_tiles(doc, item, least):
    d, i, out = list(doc), list(item), []
    while True:
        best = max(((k, -a, -b) for a in range(len(d)) for b in range(len(i)) for k in [run(d, i, a, b)] if k >= least), default=None)
        if best is None:
            return out
        k, a, b = best[0], -best[1], -best[2]
        out.append((a, b, k))
        d[a : a + k], i[b : b + k] = [-1] * k, [-2] * k


def run(d, i, a, b):
    k = 0
    while a + k < len(d) and b + k < len(i) and d[a + k] == i[b + k]:
        k += 1
    return k


def test_tiling_is_greedy():
    rng = random.Random(1)
    for _ in range(60):
        d, i = [np.array([rng.randrange(4) for _ in range(rng.randint(1, 50))]) for _ in range(2)]
        assert leaks.tile(d, i, 3) == slow_tiles(d, i, 3)


def test_tiles_do_not_overlap():
    x = np.array([1, 2, 3, 1, 2, 3, 4, -1, 2, 3, 4, 5])
    tiles = leaks.tile(x, np.array([1, 2, 3, 4, 5, 2, 3, 4]), 2)
    used = [k for i, _, n in tiles for k in range(i, i + n)]
    assert len(used) == len(set(used)) and tiles[0][2] == 4 and all(x[k] >= 0 for k in used)
