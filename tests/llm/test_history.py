import hashlib
import random

from quillspan.llm import history
from quillspan.llm.words import words

FILES = "file_id bigint, batch_no int, content string, sha256 string, n int, keys string, earlier int"
MANIFEST = "manifest_id bigint, processed array<struct<file_id:bigint,sha256:string>>, saved_at string"


def files(spark, rows):
    return spark.createDataFrame([(i, b, x, "stale", 1, "k", 2) for i, b, x in rows], FILES)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows, known, threshold=0.7):
    runs = lambda t: set(zip(*(words(t)[k:] for k in range(3))))
    accepted, out = [], []
    for i, b, x in sorted({r[0]: r for r in rows}.values()):
        if x is None:
            continue
        match = [k for k, h in known if h == sha(x)] if b else []
        if b:
            mine = runs(x)
            for j, y in accepted:
                theirs = runs(y)
                if x == y or (mine and theirs and len(mine & theirs) >= threshold * len(mine | theirs)):
                    match.append(j)
            if match:
                out.append((min(match), i))
                continue
        accepted.append((i, x))
    return set(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta omega kappa sigma lambda theta zeta".split()) for _ in range(60)) for _ in range(12)]
    rows = []
    for i in range(1, n):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"w{rng.randrange(999)}"
        rows.append((i, 0 if i < 30 else 1 + (i - 30) // 12, " ".join(w)))
    return [*rows, (n, 11, None), (n + 1, 11, ""), (n + 2, 11, ""), (n + 3, 11, "gone content here"), (n + 4, 11, "two words"), (n + 4, 11, "two words")]


def test_like_brute_force_at_any_delivery_size(spark):
    rows = corpus(3)
    known = [(5000, sha("gone content here")), (12, None)]
    m = spark.createDataFrame([(1, [(5000, " SHA256:" + sha("gone content here").upper() + " "), None, (12, None)], "x"), (2, None, None), (3, [], None)], MANIFEST)
    want = brute(rows, [(k, h) for k, h in known if h])
    assert len(want) > 40
    for size in (3, 50):
        assert {tuple(r) for r in history.repeated_files(files(spark, rows), m, size).collect()} == want


def text(rng, n=30):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_runs_are_compacted_reopened_and_empty_tables_allowed(spark, monkeypatch):
    monkeypatch.setattr(history, "MAX_RUNS", 3)
    h = history.History(spark)
    h.accept(files(spark, []).limit(0))
    for k in range(6):
        h = history.History(spark, h.folder)  # another session
        assert h.ingest(files(spark, [(k, 1, f"text number {k} is unlike the others {k * 7} {k * 11}")])).count() == 0
    for kind in history.KINDS:
        levels = [r["level"] for r in h.runs if r["kind"] == kind]
        assert max(levels) == 1 and all(levels.count(x) <= history.MAX_RUNS for x in levels)
        assert sum(x[3] for r in h.runs if r["kind"] == kind for x in r["ranges"]) == 6 * (history.KEYS if kind == "keys" else 1)
    h = history.History(spark, h.folder)
    assert [tuple(r) for r in h.ingest(files(spark, [(9, 1, "text number 3 is unlike the others 21 33")])).collect()] == [(3, 9)]
    h.drop()
    empty = spark.createDataFrame([], MANIFEST)
    assert history.repeated_files(files(spark, []).limit(0), empty).count() == 0


def test_a_delivery_reads_only_the_ranges_it_touches(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(history, "KINDS", {k: (a, b, 20 if k == "keys" else 5) for k, (a, b, _) in history.KINDS.items()})
    read = []
    for n in (60, 180):
        old = [(i, 0, text(rng)) for i in range(n)]
        h = history.History(spark)
        h.accept(files(spark, old))
        near = old[7][2].split()
        near[3] = "other"
        assert [tuple(r) for r in h.ingest(files(spark, [(1000, 1, " ".join(near))])).collect()] == [(7, 1000)]
        read.append(dict(h.last_read))
        h.drop()
    for kind, most in (("keys", history.KEYS), ("hashes", 1), ("sets", 1)):
        (a, held_a), (b, held_b) = read[0][kind], read[1][kind]
        assert a <= most and b <= most and held_b > 2.5 * held_a  # what is read does not grow with what is held
    assert read[1]["keys"][0] < read[1]["keys"][1] / 4
