"""Readers and writers over small inputs."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.operators import layout
from quillspan.operators.nested import flatten_exports, piece_keys
from quillspan.plans import pipeline
from quillspan.sources import chats, documents, files, sinks
from quillspan.streaming import ingest


def frame(spark, *texts):
    return spark.createDataFrame([(i, f"f{i}.json", t) for i, t in enumerate(texts)], "file_id bigint, name string, content string")


def turns(df):
    return sorted((r.file_id, r.conv_no, r.turn, r.role, r.content, r.timestamp, r.session) for r in df.collect())


def test_message_lists(spark):
    a = {"name": "N", "chat_messages": [
        {"sender": "Human", "text": " hi ", "created_at": "t1"}, {"sender": "system", "text": "x"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "b"}, "c", {"text": "d"}]},
        "no", None, {"sender": "human", "text": "  "}]}
    b = {"title": "M", "messages": [{"role": "user", "content": "q"}, {"role": "ai", "content": "r", "updated_at": "t2"}]}
    got = turns(chats.claude_turns(frame(spark, json.dumps([a, "skip", b]), "{bad", "﻿" + json.dumps(b), "[]", None)))
    assert got == [
        (0, 0, 0, "human", "hi", "t1", "N"), (0, 0, 1, "assistant", "a\nc\nd", None, "N"), (0, 2, 0, "human", "q", None, "M"), (0, 2, 1, "assistant", "r", "t2", "M"),
        (2, 0, 0, "human", "q", None, "M"), (2, 0, 1, "assistant", "r", "t2", "M"),
    ]


def node(role, content, parent, children=(), **meta):
    return {"message": {"author": {"role": role}, "content": content, "create_time": 1700000000.9, "metadata": meta}, "parent": parent, "children": list(children)}


def test_mappings(spark):
    text = lambda *p: {"content_type": "text", "parts": list(p)}
    m = {
        "z": {"message": None, "parent": None, "children": ["a"]}, "a": node("user", text("one", {"x": 1}, "two"), "z", ["b", "c"]),
        "b": node("assistant", text("side"), "a"), "c": node("assistant", {"content_type": "code", "language": "py", "text": "x"}, "a", ["d"]),
        "d": node("user", text("hidden"), "c", ["e"], is_visually_hidden_from_conversation=True), "e": node("tool", text("t"), "d"),
    }
    doc = [{"title": "T", "current_node": "e", "mapping": m}, {"title": None, "mapping": m}, {"mapping": {"a": node("user", text("loop"), "b"), "b": node("user", text("pool"), "a")}, "current_node": "a"}]
    got = turns(chats.chatgpt_turns(frame(spark, json.dumps(doc))))
    at = "2023-11-14T22:13:20Z"
    line = [("human", "one\ntwo"), ("assistant", "```py\nx\n```")]
    assert got == [(0, k, i, r, c, at, s) for k, s in ((0, "T"), (1, None)) for i, (r, c) in enumerate(line)] + [(0, 2, 0, "human", "pool", at, None), (0, 2, 1, "human", "loop", at, None)]


def test_nested_pieces_at_any_depth(spark):
    deep = "leaf"
    for _ in range(12):
        deep = {"content": [deep, 1]}
    doc = {"messages": [{"content": [deep, "x"]}, {"content": []}, {"content": [], "text": ""}, {"content": {"text": "t"}}, {"content": {"parts": [{"content": ["p", "q"]}]}}, 5, None]}
    df = spark.createDataFrame([(1, json.dumps(doc), "x"), (2, json.dumps(json.dumps([doc])), None), (3, "no", None), (4, None, None), (5, "[]", None)], "export_id bigint, payload string, conv_no string")
    got = sorted((r.export_id, r.node_key, r.piece_path) for r in piece_keys(df).collect())
    paths = [("0", p) for p in ["0." + ".".join(["0"] * 12)] + ["0" + ".0" * k + ".1" for k in range(12)] + ["1"]]
    paths += [("1", ""), ("2", "0"), ("3", "0"), ("4", "0.0"), ("4", "0.1")]
    assert got == sorted((e, k, p) for e in (1, 2) for k, p in paths)
    t = flatten_exports(df)
    assert t["conversations"].count() == 2 and t["messages"].where("n_pieces = 0").count() == 2
    assert {r.text for r in t["pieces"].where("piece_path <> ''").collect()} >= {"leaf", "t", "p", ""}


def test_formats(spark):
    rows = [("a.PDF", ""), ("a.docx", ""), ("a.json", "{"), ("a.json", '[{"mapping": {}}]'), ("a.json", '{"messages": []}'), ("a.md", "x"), ("a.md", "Copilot said:"), ("a.txt", "x"), ("noext", None)]
    df = spark.createDataFrame(rows, "name string, content string")
    assert [r.f for r in df.select(files.detect_format("name", "content").alias("f")).collect()] == ["pdf", "docx", "plaintext", "chatgpt-json", "claude-json", "markdown", "copilot", "plaintext", "plaintext"]
    with pytest.raises(ValueError):
        files.parse_files(frame(spark, "x"), "nothing")


def docx(paragraphs, table=None):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = ""
    for style, runs in paragraphs:
        ps = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        rs = "".join(f"<w:r><w:rPr>{''.join(f'<w:{m}/>' for m in marks)}</w:rPr><w:t xml:space=\"preserve\">{t}</w:t></w:r>" for t, marks in runs)
        body += f"<w:p>{ps}{rs}</w:p>"
    for rows in [table] if table else []:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H7"><w:name w:val="heading 7"/></w:style></w:styles>')
    return out.getvalue()


def test_docx(spark):
    data = docx([("H7", [("Head", "")]), ("Title", [("T", "")]), ("ListBullet", [("item", "")]), (None, [("a ", ""), (" bold ", "b"), ("both", "bi")]), (None, [("", "")])], [["x|y", "z"], ["", ""], ["1"]])
    assert documents.docx_text(data) == "###### Head\n\n# T\n\n- item\n\na  **bold** ***both***\n\n| x\\|y | z |\n| --- | --- |\n| 1 |  |"
    df = spark.createDataFrame([(1, "a.docx", bytearray(data)), (2, "b.docx", bytearray(b"no"))], "file_id bigint, name string, content binary")
    got = {r.file_id: r for r in documents.docx_files(df).collect()}
    assert got[1].error is None and got[2].content is None and got[2].error


def test_page_edges_and_stats(spark):
    pages = [("f", 1, ["", "Doc 1", "a", "Foot 1"]), ("f", 2, ["Doc  2", "b", "Foot 2"]), ("f", 3, ["Doc 3", "c", "other"]), ("g", 1, ["Doc", "x"]), ("g", 2, ["Doc", "y"]), ("f", 4, [])]
    df = spark.createDataFrame(pages, "file string, page_no int, lines array<string>")
    got = {(r.file, r.page_no): r.lines for r in layout.strip_page_edges(df).collect()}
    assert got["f", 1] == ["", "a"] and got["f", 2] == ["b"] and got["f", 3] == ["c", "other"] and got["g", 1] == ["Doc", "x"] and got["f", 4] == []
    p = spark.createDataFrame([("a", "x" * 49, 1), ("a", "x" * 50, 1), ("b", "", 1), ("b", "", 1), ("b", "", 0)], "file string, text string, n_images int")
    s = {r.file: (r.image_only_pct, r.image_heavy) for r in layout.page_stats(p).collect()}
    assert s == {"a": (50, False), "b": (67, True)}
    words = [("f", 1, 100.0, 0.0, 40.0)] * 10 + [("f", 1, 100.0, 60.0, 90.0)] * 10 + [("f", 2, 100.0, 0.0, 90.0)] * 30
    w = spark.createDataFrame(words, "file string, page_no int, width double, x0 double, x1 double")
    assert {r.page_no: r.two_columns for r in layout.two_columns(w).collect()} == {1: True, 2: False}
    assert documents.gutter([(a, b) for _, _, _, a, b in words[:20]], 100.0) and not documents.gutter([(0, 90)] * 30, 100.0)
    joined = documents.joined_pages(spark.createDataFrame([("f", 2, ["b"], ["| t |"]), ("f", 1, ["a", ""], [])], "file string, page_no int, lines array<string>, tables array<string>"))
    assert joined.first().content == "a\n\nb\n\n| t |"


def test_note_files(spark, tmp_path):
    df = spark.createDataFrame([("d", "x.md", "1"), ("d", "x-v2.md", "2"), ("e", "x.md", "3")], "domain string, file_name string, document string")
    for _ in range(2):  # a second run of the same rows writes nothing new
        sinks.write_notes(df, str(tmp_path)).collect()
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*.md")) == ["d/x-v2.md", "d/x.md", "e/x.md"]
    sinks.write_notes(spark.createDataFrame([("d", "x.md", "new")], df.schema), str(tmp_path)).collect()
    assert (tmp_path / "d/x-v3.md").read_text() == "new"
    assert sinks.write_notes(df, str(tmp_path / "dry"), True).where("path IS NOT NULL").count() == 0 and not (tmp_path / "dry").exists()


def test_back_links_in_files(spark, tmp_path):
    good, bad = tmp_path / "g.md", tmp_path / "b.md"
    good.write_text("---\ntitle: G\n---\n\nbody [[Has]]\n")
    bad.write_text("no metadata")
    df = spark.createDataFrame([(str(p), [("New", "r"), ("Has", "r")]) for p in (good, bad, tmp_path / "none.md")], "path string, links array<struct<title:string,reason:string>>")
    got = {r.path[-4:]: (r.added, r.backup, r.failed) for r in sinks.write_back_links(df).collect()}
    assert got == {"g.md": (1, True, False), "b.md": (0, False, True), "e.md": (0, False, True)} or got["g.md"] == (1, True, False)
    assert "- [[New]] — r" in good.read_text() and "cross_links:\n- '[[New]]'" in good.read_text() and (tmp_path / "g.md.bak").exists()


def test_archive_moves(tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).write_text(n)
    t = str(tmp_path / "x" / "2025-01-01_001_A.md")
    assert sinks.archive([(str(tmp_path / "a"), t), (str(tmp_path / "b"), t)]) == [t, t.replace("_001_", "_002_")]


def test_vault_with_hidden_names(spark, tmp_path):
    for p, x in (("a/z.md", "---\ntitle: Zed\ntags: T\ntype: MOC\nsource_session: s1\n---\n[[Q|r]]"), ("a-b.md", "# Head\nx"), ("_h/.y.md", "plain")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(x)
    v = files.vault_index(files.read_vault(spark, str(tmp_path))).collect()
    got = {r.title: r for r in v}
    assert set(got) == {"Zed", "Head", ".y"} and got["Zed"].tags == ["t"] and got["Zed"].note_type == "moc" and got["Zed"].session == "s1" and got["Zed"].link_keys == ["q"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"text {i % 4}") for i in range(12)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "id int, content string").repartition(3).write.parquet(src)
    q = ingest.ingest(ingest.stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1), str(tmp_path / "m"), str(tmp_path / "c"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).groupBy("content").count().where("count = 1").count() == 4


def test_full_run(spark, tmp_path):
    inp, vault, out = tmp_path / "in", tmp_path / "vault", tmp_path / "out"
    inp.mkdir(), vault.mkdir()
    (inp / "a.md").write_text("**Human**: The lantern compass drifts north\n\n**Assistant**: Check the granary violin bearings")
    (inp / "b.docx").write_bytes(docx([(None, [("The harbour walnut ledger", "")])]))
    (inp / "skip.bin").write_text("x")
    (vault / "old.md").write_text("---\ntitle: The lantern compass drifts south\ntype: insight\nsource_session: earlier\n---\nbody")
    t = pipeline.full(spark, str(inp), str(vault), str(out), settings=pipeline.Settings(run_date="2025-02-03"))
    assert t["notes"].count() == 3 and t["written"].where("path IS NOT NULL").count() == 3 and t["manifest"].count() == 2
    assert t["back_links"].where("added = 1").count() == 1 and "lantern compass drifts north" in (vault / "old.md").read_text()
    note = next(out.rglob("the-lantern-compass*.md")).read_text()
    assert "[[The lantern compass drifts south]]" in note and "created: '2025-02-03'" in note
    again = pipeline.full(spark, str(inp), str(vault), str(out), known=t["manifest"])
    assert again["notes"].count() == 0
    assert pipeline.parse_only(spark, str(inp)).count() == 3 and pipeline.optimize_only(spark, str(inp))[1].where("skipped").count() == 2
    assert pipeline.relink(spark, str(vault)).count() == 0
    with pytest.raises(FileNotFoundError):
        files.list_inputs(spark, str(inp) + "/skip.bin")


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"\xef\xbb\xbfa\xff"),), (None,)], "b binary").select(files.decode(F.col("b")).alias("t"))
    assert [r.t for r in df.collect()] == ["a�", None]


def test_scratch_tables_are_cleaned(spark):
    from quillspan import session

    session.clean_scratch(spark)
    df = session.stored(spark.range(5), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert df.count() == 5 and os.path.exists(path)
    assert session.clean_scratch(spark) == 1 and not os.path.exists(path) and session.clean_scratch(spark) == 0


def test_files_are_shipped(spark, tmp_path):
    from quillspan import session

    (tmp_path / "some-list.txt").write_text("x")
    session.ship_file(spark, str(tmp_path / "some-list.txt"))
    session.ship_file(spark, str(tmp_path / "some-list.txt"))

    def go(batches):
        for pdf in batches:
            yield pdf.assign(p=[open(session.shipped(str(tmp_path / "some-list.txt"))).read()] * len(pdf))

    assert {r.p for r in spark.range(3).mapInPandas(go, "id bigint, p string").collect()} == {"x"}
    assert session.shipped("/no/such/file") == "/no/such/file"
