"""Notes and links against plain restatements."""

import difflib
import random
import re

from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.unicode import kebab_case, nfkd_ascii, ratio, topic
from quillspan.operators import archive, linking, manifest, notes
from quillspan.operators.similar import similar_pairs
from quillspan.plans.leaders import leaders


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_ratio_is_the_standard_librarys(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("x" + "ab" * 200, "ab" * 200), ("", ""), (None, "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(ratio("a", "b").alias("r"))
    assert [r.r for r in df.collect()] == [0.25, 0.5, 0.0, 1.0, None]


def test_slugs(spark):
    assert one(spark, kebab_case(F.lit("DSM Lip — Sweep ﬁ Ünï straße"))) == "dsm-lip-sweep-fi-uni-strae"
    assert one(spark, kebab_case(F.lit("日本"))) == "untitled-note" and one(spark, nfkd_ascii(F.lit("œuvre"))) == "uvre"
    assert one(spark, topic(F.lit("MOC - The Big: Plan"))) == "The-Big-Plan" and one(spark, topic(F.lit(None).cast("string"))) == "Untitled"


def test_token_estimates(spark):
    assert one(spark, T.estimate_tokens(F.lit("x" * 400))) == 114 and one(spark, T.estimate_tokens(F.lit(""))) == 1
    assert one(spark, T.count_tokens(F.lit(""))) == 0 and one(spark, T.count_tokens(F.lit("abc"))) == 1


def test_phrases(spark):
    got = set(one(spark, T.concept_phrases(F.lit("The QX-7 Soil probe for DSM"))))
    assert got == {"the qx-7 soil probe for dsm", "qx-7", "qx-7 soil", "soil probe"}
    assert one(spark, T.phrase_in(F.lit("a.b"), F.lit("x a.b, y"))) and not one(spark, T.phrase_in(F.lit("a.b"), F.lit("xa.b")))


def test_note_blocks_and_parsing(spark):
    text = "```markdown\n---\ntitle: One\ntags: [a, B]\nx: {y: 1}\n---\nbody\n--- ATOM_BREAK ---\n# Two\nmore\n---ATOM_BREAK---\n\n---ATOM_BREAK---\n---\n: : bad\n---\nplain first\n```"
    got = notes.parse(notes.blocks(spark.createDataFrame([(1, text)], "k int, text string"), "text")).orderBy("block_no").collect()
    assert [r.title for r in got] == ["One", "Two", "plain first"]
    assert got[0].tags == ["a", "B"] and got[0].extra == {"x": '{"y": 1}'} and got[1].type is None


def test_normalise_and_render(spark):
    n = spark.createDataFrame([("T", " Insight ", None, "sure", "", ["a ", "", None], None, None, None, "b")],
                              "title string, type string, source_domain string, confidence string, status string, tags array<string>, related array<string>, cross_links array<string>, extra map<string,string>, body string")
    r = notes.normalise(n, {"created": F.lit("2025-01-01")})
    x = r.select("type", "source_domain", "confidence", "status", "tags", "related").first()
    assert tuple(x) == ("insight", "general", "medium", "active", ["a"], [])
    assert r.select(notes.render(r, ["type", "created", "tags"]).alias("d")).first().d == "---\ntype: insight\ncreated: '2025-01-01'\ntags:\n- a\n---\n\n# T\n\nb\n"


def rewritten(text, survivors):
    return re.sub(r"\[\[([^\]|#]+)(\|[^\]]*)?\]\]", lambda m: f"[[{survivors.get(m[1].strip().lower(), m[1])}{m[2] or ''}]]", text)


def test_merge_like_a_walk(spark):
    rng = random.Random(3)
    base = ["alpha beam test", "gamma ray burst", "delta wing notes"]
    titles = []
    for _ in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz ")
        titles.append("".join(t))
    rows = [(1, k, t, f"see [[{rng.choice(titles)}|al]]", [f"[[{rng.choice(titles)}]]"]) for k, t in enumerate(titles)]
    kept, where = [], {}
    for t in titles:
        m = next((e for e in kept if difflib.SequenceMatcher(None, t.lower().strip(), e.lower().strip()).ratio() >= 0.85), None)
        where[t.lower()] = m or t
        if m is None:
            kept.append(t)
    df = spark.createDataFrame(rows, "g int, n int, title string, body string, related array<string>")
    got = {r.n: r for r in notes.merge(df, "g", "n")[0].collect()}
    assert [got[k].title for k in sorted(got)] == kept
    for k, r in got.items():
        assert r.body == rewritten(rows[k][3], where)


def test_survivors_keep_alias_and_anchors(spark):
    df = spark.createDataFrame([("[[ A |x]] [[A#b]] [[C]] [[a", {"a": "B"}), ("[[A]]", None), (None, {"a": "B"}), ("[[a]]", {"a": "A"})], "t string, m map<string,string>")
    got = [r.v for r in df.select(notes.with_survivors(F.col("t"), F.col("m")).alias("v")).collect()]
    assert got == ["[[B|x]] [[A#b]] [[C]] [[a", "[[A]]", None, "[[a]]"]


def test_leaders_chain(spark):
    e = spark.createDataFrame([("g", 2, 1), ("g", 3, 2), ("g", 4, 3), ("g", 5, 1), ("g", 5, 4)], "g string, item bigint, earlier bigint")
    got = {r.item: r.leader for r in leaders(e, ["g"]).collect()}
    assert got == {2: 1, 3: None, 4: 3, 5: 1}


def test_leaders_by_rounds_and_in_a_row(spark):
    rng = random.Random(8)
    edges = [(g, i, j, False) for g in ("a", "b", None) for i in range(2, 40) for j in range(1, i) if rng.random() < 0.08]
    edges += [("c", i, i - 1, False) for i in range(2, 120)] + [("b", i, 1000 + i, True) for i in (7, 11, 12)]
    want, leads = {}, {}
    for g, i in sorted({(g, i) for g, i, _, _ in edges}, key=lambda x: x[1]):
        hits = [j for h, k, j, old in edges if (h, k) == (g, i) and (old or leads.get((g, j), True))]
        leads[g, i], want[g, i] = not hits, min(hits, default=None)
    e = spark.createDataFrame(edges, "g string, item bigint, earlier bigint, old boolean")
    for few in (0 if len(edges) < 50 else 40, 10**6):
        assert {(r.g, r["item"]): r.leader for r in leaders(e, ["g"], few).collect()} == want
    assert leaders(e.limit(0), ["g"]).count() == 0


def test_similar_pairs_with_blocks(spark):
    rng = random.Random(2)
    items = [(c, i, "".join(rng.choice("abc") for _ in range(rng.randint(28, 40)))) for c in ("u", "v") for i in range(60)]
    items += [("u", 100 + i, items[i][2][:-1] + "z") for i in range(20)]
    df = spark.createDataFrame(items, "g string, item bigint, text string")
    got = {tuple(r) for r in similar_pairs(df, "g", 0.8, 0.1, block=7).collect()}
    want = {
        (g, i, j) for g, i, x in items for h, j, y in items
        if g == h and j < i and abs(len(x) - len(y)) <= 0.1 * max(len(x), len(y)) and difflib.SequenceMatcher(None, x, y).ratio() >= 0.8
    }
    assert got == want and want


NOTE = "id bigint, path string, title string, title_key string, stem string, slug string, tags array<string>, phrases array<string>, body_lower string, link_keys array<string>, session string, note_type string, new boolean"


def some_notes(rng, n):
    words = ["lantern", "harbour", "compass", "granary", "walnut", "violin", "orchard"]
    out = []
    for i in range(n):
        t = f"{rng.choice(words)} {rng.choice(words)} {rng.choice(words)}"
        out.append((i, f"d{rng.randint(0, 3)}/{t}-{i}.md", t, t, f"{t}-{i}", t.replace(" ", "-"), rng.sample(words, 4), [t, t.split()[0]],
                    " ".join(rng.choice(words) for _ in range(3)), [rng.choice(words)], rng.choice([None, "s1", "s2"]), rng.choice(["moc", "atomic-note", "atomic-note"]), False))
    return out


def plain_candidates(q, vault, links):
    out = []
    for v in vault:
        if v[11] == "moc" or v[0] == q[0] or (v[10] and q[10] and v[10] == q[10]) or v[3] in links or v[4].lower() in links or v[5] in links:
            continue
        s = 0.0
        r = difflib.SequenceMatcher(None, q[3], v[3]).ratio()
        if r >= 0.65:
            s = 3000 + r * 100
        k = len(set(q[6]) & set(v[6]))
        if k >= 3:
            s = max(s, 2000 + 10 * k)
        h = sum(p in v[8] for p in q[7]) + sum(p in q[8] for p in v[7])
        if h:
            s = max(s, 1000 + h)
        if s:
            out.append((-s, v[1].split("/"), v[0], v))
    return [(-s, v) for s, _, _, v in sorted(out, key=lambda x: x[:3])]


def test_candidates_and_relink_like_a_walk(spark):
    ns = some_notes(random.Random(11), 45)
    df = spark.createDataFrame(ns, NOTE)
    pairs = linking.candidates(df, df)
    got = {(r.src, r.tgt): round(r.score, 6) for r in pairs.collect()}
    want = {(q[0], v[0]): round(s, 6) for q in ns for s, v in plain_candidates(q, ns, set(q[9]))}
    assert got == want
    order = sorted(ns, key=lambda x: x[1].split("/"))
    links, done = {x[0]: set(x[9]) for x in ns}, set()
    for q in order:
        for _, v in plain_candidates(q, ns, links[q[0]])[:5]:
            p = (min(q[0], v[0]), max(q[0], v[0]))
            if p not in done:
                done.add(p)
                links[q[0]].add(v[3])
                links[v[0]].add(q[3])
    # index notes are sources as well here; the walk above treats them alike
    assert {(r.note_a, r.note_b) for r in linking.relink(pairs, df).collect()} == done


def test_lookup(spark):
    t = [("mec", "M"), ("interlake mecalux", "IM"), ("Interlake Mecalux ", "IM2"), ("xy", "X"), ("ab", "A")]
    df = spark.createDataFrame([("Interlake Mecalux inc.",), (" mec",), ("m",), ("zz",), ("",), (None,), ("xyab",)], "v string")
    assert [r.c for r in archive.lookup(df, "v", t, "c").collect()] == ["IM2", "M", "IM2", "UNK", "UNK", "UNK", "X"]


def test_sequences_and_names(spark):
    df = spark.createDataFrame([("d", 2), ("d", 1), ("e", 1)], "day string, k int")
    taken = spark.createDataFrame([("d", 7)], "day string, seq int")
    assert sorted(tuple(r) for r in archive.sequences(df, "day", ["k"], taken).select("day", "k", "seq").collect()) == [("d", 1, 8), ("d", 2, 9), ("e", 1, 1)]
    assert one(spark, archive.archive_name(F.lit("d"), F.lit(1234), *[F.lit("X")] * 3, F.lit("t"), F.lit(".MD"))) == "d_1234_X-X-X_t.md"


def test_manifest(spark):
    f = manifest.with_hash(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, content string"))
    known = f.where("id = 9")
    assert manifest.pending(f, known).count() == 3 and manifest.pending(f, f).count() == 1 and manifest.skipped(f, f).count() == 2 and manifest.pending(f, f, True).count() == 3


def test_index_warning_and_footer(spark):
    assert one(spark, T.index_warning(F.lit("# T\n\nx"), F.lit(40))).startswith("# T\n\n> ⚠") and one(spark, T.index_warning(F.lit("x"), F.lit(4))).endswith("\n\nx")
    f = one(spark, T.append_footer(F.lit("b "), F.array(F.lit("- 1"))))
    assert f == "b\n\n## Related (Cross-Session)\n\n- 1\n" and one(spark, T.append_footer(F.lit(f), F.array(F.lit("- 2")))).endswith("- 1\n- 2\n")


def test_stamp_and_merged_stats(spark):
    from quillspan.operators import summary

    assert one(spark, summary.stamp(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), {"b": F.lit('x"y'), "c": F.lit(None).cast("string")})) == {"a": "1", "b": '"x\\"y"'}
    cols = ["enabled", "forward", "forward_notes", "backlinks", "backlink_notes", "failures", "backups"]
    df = spark.createDataFrame([(True, 1, 2, 3, 4, 5, 6), (False, 1, 1, 1, 1, 1, 1)], "enabled boolean, " + ", ".join(f"{c} int" for c in cols[1:]))
    assert tuple(summary.merge_stats(df).first()) == (True, 2, 3, 4, 5, 6, 7) and summary.merge_stats(df.limit(0)).first().enabled is False


def test_model_clients(spark):
    import http.server
    import json
    import threading

    from quillspan.sources import models

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path.endswith("/messages"):
                body = {"content": [{"type": "text", "text": sent["messages"][0]["content"].upper()}, {"type": "other"}], "usage": {"input_tokens": 2, "output_tokens": 3}}
            else:
                body = {"choices": [{"message": {"content": sent["messages"][1]["content"] + "!"}}]} if sent["messages"][1]["content"] != "bad" else {}
            data = json.dumps(body).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}/v1"
    df = spark.createDataFrame([("s", "hi"), ("s", "bad")], "system string, user string")
    got = {r.user: r for r in notes.extract(df, models.build("local", endpoint=url), "system", "user").collect()}
    assert got["hi"].text == "hi!" and got["hi"].error is None and got["bad"].text is None and "unexpected" in got["bad"].error
    import os

    os.environ["SOME_KEY"] = "k"
    assert models.build("hosted", endpoint=url, model="m", key_variable="SOME_KEY")("s", "hi") == ("HI", 2, 3)
    server.shutdown()
