"""Inputs on which queries failed at larger sizes."""

import time

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.operators import notes


def test_escaped_characters_beyond_16_bits(spark):
    """extracted_notes: the writer's metadata is JSON, which writes such characters as two escapes."""
    text = '---\ntitle: "\\ud83d\\ude80 up"\ntags: ["\\ud83d\\ude80"]\nx: "\\ud83d\\ude80"\ntype: "\\ud83d"\n---\nbody'
    out = notes.first_line_writer("", '<turn n="1" role="HUMAN">\n\U0001f680 up\n</turn>')[0]
    got = notes.parse(spark.createDataFrame([(1, text), (2, out)], "k int, block string")).orderBy("k").collect()
    assert [r.title for r in got] == ["\U0001f680 up"] * 2
    assert got[0].tags == ["\U0001f680"] and got[0].extra == {"x": '"\U0001f680"'} and got[0].type == "\ufffd"


def test_long_table_in_linear_time(spark):
    """markdown_tables: the width of a table was computed again for each of its rows."""
    n = 6000
    rows = F.concat(F.array(F.array(F.lit("a"), F.lit("b"))), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(i.cast("string"))), F.array(F.array(F.lit(" "))))
    began = time.time()
    got = spark.range(1).select(T.markdown_table(rows).alias("t")).first().t
    assert got == "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} |  |" for i in range(1, n + 1))
    assert time.time() - began < 30
    assert spark.range(1).select(T.markdown_table(F.array(F.array(F.lit(" ")))).alias("t")).first().t == ""


def test_best_links_like_all_candidates(spark):
    """back_links, link_stats, link_topk, link_preview: the best links by blocks are those among all candidate pairs."""
    import random

    from quillspan.operators import linking
    from tests.test_notes_links import NOTE, some_notes

    df = spark.createDataFrame(some_notes(random.Random(5), 60), NOTE)
    for titles in (False, True):
        want = linking.top(linking.candidates(df, df, titles), df).collect()
        got = linking.top(linking.best(df, df, titles, block=9, sblock=25), df).collect()
        pick = lambda rs: sorted((r.src, r["rank"], r.tgt, r.score, r.reason) for r in rs)
        assert pick(got) == pick(want) and want


def test_no_note_table_is_broadcast(spark):
    """The planner takes exploded words for small, so the links of large vaults went to the driver."""
    import random

    from quillspan.operators import linking
    from tests.test_notes_links import NOTE, some_notes

    df = spark.createDataFrame(some_notes(random.Random(5), 60), NOTE)
    asked = df.select(F.explode("phrases").alias("phrase"))
    plan = linking.found_phrases(asked, df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_few_sources_search_no_other_pairs(spark, monkeypatch):
    """link_stats, link_topk, link_preview: phrases of few notes in all bodies and of all notes in few bodies, not all in all."""
    import random

    from quillspan.operators import linking
    from tests.test_notes_links import NOTE, some_notes

    df = spark.createDataFrame(some_notes(random.Random(6), 50), NOTE)
    few, calls, find = df.where("id % 10 = 0"), [], linking.found_phrases
    want = linking.top(linking.candidates(few, df, False), df).collect()
    monkeypatch.setattr(linking, "found_phrases", lambda a, b: calls.append((a.count(), b.count())) or find(a, b))
    got = linking.top(linking.best(few, df, False), df).collect()
    pick = lambda rs: sorted((r.src, r["rank"], r.tgt, r.score, r.reason) for r in rs)
    assert pick(got) == pick(want) and want
    phrases = df.select(F.explode("phrases")).count()
    assert calls and not any(a == phrases and b == df.count() for a, b in calls)


def test_relink_from_heads_like_all_candidates(spark):
    """relink_pairs: heads of the candidates, made longer where they run out, give the walk's pairs; all were written out."""
    import random

    from quillspan.operators import linking, relinking
    from tests.test_notes_links import NOTE, some_notes

    rng = random.Random(12)
    ns = [list(n) for n in some_notes(rng, 70)]
    for n in ns[::4]:  # equal titles, as of notes that nobody named
        n[2] = n[3] = n[5] = "walnut"
    df = spark.createDataFrame([tuple(n) for n in ns], NOTE)
    want = {(r.note_a, r.note_b) for r in linking.relink(linking.candidates(df, df), df).collect()}
    for plain, titles in ((2, 1), (24, 12)):
        got = [(r.note_a, r.note_b) for r in relinking.relink(df, plain=plain, near=titles).collect()]
        assert sorted(got) == sorted(want) and want


def test_best_links_compare_no_more_titles_than_needed(spark, monkeypatch):
    """link_topk_all: the best links come without all pairs of similar titles, also where the nearest titles can't be linked."""
    import random

    from quillspan.operators import linking, titles
    from tests.test_notes_links import NOTE, some_notes

    df = spark.createDataFrame(some_notes(random.Random(13), 60), NOTE)
    few = df.where("id % 4 = 0")
    want = linking.top(linking.candidates(few, df), df).collect()
    monkeypatch.setattr(linking, "title_pairs", None)
    monkeypatch.setattr(titles.best_pairs, "__defaults__", (2,))
    got = linking.top(linking.best(few, df), df).collect()
    pick = lambda rs: sorted((r.src, r["rank"], r.tgt, r.score, r.reason) for r in rs)
    assert pick(got) == pick(want) and want


def test_best_ratios_of_many_texts():
    """relink_pairs: the nearest titles without the exact ratio of all pairs."""
    import difflib
    import random

    from quillspan.functions.bounds import best_ratios

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.choice([2, 9, 20, 70])))
    asks, tells = list({word() for _ in range(25)}), list({word() for _ in range(120)}) + ["", "ab"]
    for size in (2, 1000):
        search = best_ratios(size, 0.5, block=50)
        search.ask([*asks, ""])
        search.tell(tells[:70])
        search.tell(tells[70:])
        got = search.found()
        for x in [*asks, ""]:
            all_ = {y: r for y in tells for r in (difflib.SequenceMatcher(None, x, y).ratio(),) if r >= 0.5}
            least = [r for a, y, r in got if a == x and y is None]
            assert len(least) == (1 if len(all_) > size else len(least)) and len(least) <= 1
            assert {y: r for a, y, r in got if a == x and y is not None} == {y: r for y, r in all_.items() if r > (least or [-1])[0]}


def test_link_topk_broadcasts_no_notes(spark, sf):
    """link_topk: what goes to all tasks is no table that grows with the notes."""
    from quillspan.plans import queries_notes

    plan = queries_notes.queries()["link_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_link_topk_sends_a_bit_set_once(spark, monkeypatch):
    """link_topk: tasks of a stage carried the bit set of 2 MB up to nine times, each copy written by the driver."""
    import re

    from quillspan.operators import linking

    rng_words = [f"w{i}" for i in range(12)]
    long_ = " ".join(rng_words)
    bodies = [f"see {long_} now", f"see {' '.join(rng_words[:9])} x {' '.join(rng_words[9:])}", "café w1, w2; w3-w4", "été — 北 x", ""]
    phrases = [long_, " ".join(rng_words[1:]), "w1", "w1, w2", "w3-w4", "w2 w4", "café", "é", "北", "absent", "x w9 w10", None]
    asked = spark.createDataFrame([(x,) for x in phrases * 2], "phrase string")
    notes_ = spark.createDataFrame(list(enumerate(bodies)), "id int, body_lower string")
    sizes, jvm = [], spark._jvm
    tag = getattr(getattr(jvm.scala.reflect, "ClassTag$"), "MODULE$").Any()

    def sized(f):
        def go(df, *a):
            rdd = df._jdf.queryExecution().toRdd()
            sizes.append(jvm.org.apache.spark.SparkEnv.get().closureSerializer().newInstance().serialize(rdd, tag).remaining())
            return f(df, *a)

        return go

    for name in ("cut", "stored"):
        monkeypatch.setattr(linking, name, sized(getattr(linking, name)))
    got = sized(lambda df: df)(linking.found_phrases(asked, notes_)).collect()
    want = {(p, i) for p in phrases if p for i, b in enumerate(bodies) if re.search(rf"(^|[^a-z0-9]){re.escape(p)}([^a-z0-9]|$)", b)}
    assert sorted((r.phrase, r.b) for r in got) == sorted(want) and len(want) > 6
    assert len(sizes) > 3 and max(sizes) < 2 * linking.BITS // 8


def test_link_preview_broadcasts_no_notes(spark, sf):
    """link_preview: the titles of the sources were joined without a hint."""
    from quillspan.plans import queries_notes

    plan = queries_notes.queries()["link_preview"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_forward_notes_search_from_all_notes(spark, sf):
    """forward_notes: every note gets its links, not only those with ids divisible by 100."""
    from quillspan.operators import linking
    from quillspan.plans import queries_notes

    v = queries_notes.vault(spark, sf)
    linked = {r.src for r in linking.candidates(v, v, False).select("src").distinct().collect()}
    got = {r.id for r in queries_notes.queries()["forward_notes"](spark, sf).collect()}
    assert got == linked and any(i % 100 for i in got)


def test_common_lengths_of_many_texts_at_once():
    """title_pairs: the bound of one title with all titles of a block is that of each pair."""
    import random

    from quillspan.functions.bounds import Matcher, common_lengths

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé\U0001f680") for _ in range(n)) for n in (0, 1, 5, 40, 63, 64, 65, 90)]
    common, m = common_lengths(texts), Matcher(0.0)
    for y in ["", "a", *texts, "bca" * 30]:
        m.set(y)
        assert common(y).tolist() == [m.common(x) if len(x) <= 64 else len(x) for x in texts]
