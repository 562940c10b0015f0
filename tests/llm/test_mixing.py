import random

import numpy as np

from quillspan.llm import mixing

D, M = "doc_id bigint, text string, source string, label string, tokens string, q string", "source string, target_share double, max_repeats int"


def test_sizes_rates_and_shares(spark):
    rng = random.Random(1)
    rows, words = [], {"aa": "alpha beta gamma", "bb": "delta omega kappa", "cc": "theta zeta eta"}
    for i in range(300):
        s = "aa" if i < 100 else "bb" if i < 250 else "cc"
        rows.append((i, " ".join(rng.choice(words[s].split()) for _ in range(40)), rng.choice([s, f" {s.upper()}\t"]), "l", "t", "q"))
    rows += [(900, "other text", "dd", None, None, None), (901, "none", None, None, None, None), (902, None, "aa", None, None, None), (903, "", "aa", None, None, None), (None, "alpha", "aa", None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, D)
    m = mixing.Mixture(docs, spark.createDataFrame([("aa", 0.5, 3), ("bb", 0.3, 1), ("cc", 0.2, 2), ("empty", 0.0, 4), (None, 0.1, 1)], M))
    enc = mixing.encoder(mixing.TOKENIZER)
    size = {s: sum(len(enc.encode_ordinary(r[1] or "")) for r in {r[0]: r for r in rows if r[0] is not None}.values() if r[2] and r[2].strip().lower() == s) for s in words}
    rep = {r.source: r for r in m.report().collect()}
    assert {s: rep[s].size_tokens for s in words} == size and rep["empty"].size_tokens == 0 and rep["aa"].total_tokens == sum(size.values())
    assert all(abs(rep[s].expected_share - w) < 0.03 for s, w in (("aa", 0.5), ("bb", 0.3), ("cc", 0.2)))
    assert not any(r.short for r in rep.values())
    caps = {"aa": 3, "bb": 1, "cc": 2}
    assert all(0 <= r.rate <= caps[r.source] and 0 <= r.copies <= caps[r.source] for r in m.rates().collect())
    again = mixing.Mixture(docs, spark.createDataFrame([("aa", 0.2, 1), ("bb", 0.2, 1), ("cc", 0.5, 2), ("empty", 0.1, 9)], M)).report()
    assert {r.source for r in again.where("short").collect()} == {"cc", "empty"}


def test_empty_tables(spark):
    docs, t = spark.createDataFrame([], D), spark.createDataFrame([("aa", 1.0, 1)], M)
    r = mixing.Mixture(docs, t).report().first()
    assert (r.size_tokens, r.expected_share, r.short) == (0, 0.0, False)
    assert mixing.Mixture(docs, t.limit(0)).report().count() == 0


def test_small_sources_reach_their_share(spark):
    words = {"aa": "alpha beta gamma", "bb": "delta omega kappa", "cc": "theta zeta eta", "dd": "iota lambda sigma", "ee": "walnut violin granary"}
    many = {"aa": 140, "bb": 128, "cc": 128, "dd": 4}
    rows = lambda n: [(i, f"{words[s]} " * 20, s, None, None, None) for i, s in enumerate(s for s in n for _ in range(n[s]))]
    targets = [("aa", 0.35, 10), ("bb", 0.3, 10), ("cc", 0.3, 10), ("dd", 0.05, 10)]
    m = mixing.Mixture(spark.createDataFrame(rows(many), D), spark.createDataFrame(targets, M))
    rep = {r.source: r for r in m.report().collect()}
    assert all(abs(rep[s].expected_share - w) < 0.001 for s, w, _ in targets) and not rep["dd"].short
    assert m.converged and all(r.converged for r in rep.values())
    # a source that can never reach its share leaves the proportions of the others alone
    targets = [("aa", 0.3, 10), ("bb", 0.2, 10), ("cc", 0.2, 10), ("dd", 0.05, 10), ("ee", 0.25, 1)]
    rep = {r.source: r for r in mixing.Mixture(spark.createDataFrame(rows(many | {"ee": 4}), D), spark.createDataFrame(targets, M)).report().collect()}
    assert rep["ee"].short and all(abs(rep[s].expected_share / rep["aa"].expected_share - w / 0.3) < 0.01 for s, w, _ in targets[1:4])
    assert not mixing.fit(m.groups, m.caps, np.array([0.35, 0.3, 0.3, 0.05]), steps=1)[1]


def test_wrong_labels_are_seen(spark, monkeypatch):
    rng = random.Random(5)
    words = {"aa": "alpha beta gamma delta", "bb": "omega kappa theta zeta", "cc": "iota lambda sigma walnut"}
    rows, wrong = [], set()
    for i in range(600):
        true = ("aa", "bb", "cc")[i % 3]
        label = true
        if rng.random() < 0.1:
            label = rng.choice([s for s in words if s != true])
            wrong.add(i)
        rows.append((i, " ".join(rng.choice(words[true].split()) for _ in range(30)), label, None, None, None))
    targets = [("aa", 0.5, 3), ("bb", 0.3, 2), ("cc", 0.2, 2)]
    m = mixing.Mixture(spark.createDataFrame(rows, D), spark.createDataFrame(targets, M))
    assert 0.05 <= m.model.wrong <= 0.2
    for r in m.members.collect():
        assert int(np.argmax(r.q)) == r.doc_id % 3  # also where the label says otherwise
    rep = {r.source: r for r in m.report().collect()}
    # by what the texts are the targets are met; by label they cannot be
    assert all(abs(rep[s].expected_share - w) < 0.005 for s, w, _ in targets) and any(abs(rep[s].label_share - w) > 0.01 for s, w, _ in targets)
    near = m.prices
    monkeypatch.setattr(mixing, "LOCAL_GROUPS", 0)
    assert np.allclose(mixing.fit(m.groups, m.caps, np.array([w for _, w, _ in targets]))[0], near)


def test_texts_that_tell_nothing_leave_the_label(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(25)), ("aa", "bb")[i % 2], None, None, None) for i in range(300)]
    m = mixing.Mixture(spark.createDataFrame(rows, D), spark.createDataFrame([("aa", 0.5, 2), ("bb", 0.5, 2)], M))
    assert all(r.q[r.label] > 0.9 for r in m.members.collect())
