import itertools
import random

import numpy as np

from quillspan.llm import language

D = "doc_id bigint, text string, lang string, label string, l string, rn int"


def test_forward_sums_all_segmentations():
    lat = language.Lattice(language.VOCABULARY)
    rng = np.random.RandomState(0)
    p = rng.rand(lat.size, 2)
    for w in ("the", "haus", "жук", "q"):
        edges, n = lat.edges(w), len(w) + 1
        ids = {(i, j): k for i, j, k in edges}
        total = np.zeros(2)
        for k in range(n):
            for cuts in itertools.combinations(range(1, n), k):
                path = list(zip((0, *cuts), (*cuts, n)))
                if all(s in ids for s in path):
                    total += np.prod([p[ids[s]] for s in path], axis=0)
        assert np.allclose(language.forward(edges, n, p)[-1], total)


def test_best_path_is_best():
    rng = random.Random(3)
    for _ in range(60):
        s = np.array([[rng.choice([0, -3, -20]) for _ in range(3)] for _ in range(rng.randint(1, 6))], dtype=float)
        cost = lambda way: sum(s[i, x] for i, x in enumerate(way)) - language.SWITCH * sum(a != b for a, b in zip(way, way[1:]))
        best = max(cost(w) for w in itertools.product(range(3), repeat=len(s)))
        assert abs(cost(tuple(language.best_path(s))) - best) < 1e-9


def test_labels(spark):
    names = ["EN", "en-GB", "en_US", " english ", "Deutsch", "de-AT", "fre", "français", "Español", "nl-BE", "pt-BR", "Русский", "it", "und", "n/a", "", None]
    got = [r.l for r in spark.createDataFrame([(x,) for x in names], "x string").select(language.label_language("x").alias("l")).collect()]
    assert got == ["en", "en", "en", "en", "de", "de", "fr", "fr", "es", "nl", "pt", "ru", None, None, None, None, None]


def test_held_out_accuracy_and_segments(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.segments(docs).where("n_segments = 1 AND label IS NOT NULL")
    held = found.join(docs.where("abs(xxhash64(doc_id)) % 2 = 0").select("doc_id"), "doc_id")
    assert held.where("lang = label").count() / held.count() > 0.9  # some labels are wrong
    p, _ = language.train(docs)
    lat = language.Lattice(language.VOCABULARY)
    m = language.Model(p.astype(float), lat)
    en, de = "The lamp still shows nine missing chunks and we should move them.", "Die Lampe zeigt noch neun Fehler und niemand weiß, woher sie kommen."
    text = f"You said:\n{en}\n\n```js\nfor row in rows: emit(row)\n```\n{de} {de.upper()}\n\nPage 1 of 2\n\n{en}"
    ix = np.array(m.index(language.tokens(text)))
    s, _ = language.sentence_scores(ix, np.zeros(len(ix), int), m.rows)
    assert [language.LANGS[k] for k in language.best_path(s)] == ["en", "de", "de", "en"]


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([(1, None, "en", "x", "y", 1), (2, "", None, None, None, None), (3, "123 !!!", "de", None, None, None), (None, "text", None, None, None, None), (4, "the " * 5000 + "x" * 5000, "en", None, None, None)], D)
    assert {r.doc_id for r in language.segments(df).collect()} == {4}
    assert language.unlabelled_or_mixed(df.limit(0)).count() == 0


def test_confidence_is_fitted_on_held_out_labels():
    rng = np.random.RandomState(3)
    langs = rng.randint(0, len(language.LANGS), 4000)
    # scores whose evidence counts five times too much
    totals = rng.randn(4000, len(language.LANGS)) * 4
    p = np.exp(0.2 * totals)
    p /= p.sum(axis=1, keepdims=True)
    langs = np.array([rng.choice(len(language.LANGS), p=x) for x in p])
    assert language.calibrated(totals, langs) in (0.15, 0.2, 0.3)
    assert language.calibrated(totals[:10], langs[:10]) == language.TEMPER
