"""Merging and index notes of a run, by the number of chunks of a conversation."""

from quillspan.plans import pipeline

N = (
    "conv_id string, file_id bigint, n_chunks bigint, chunk_no int, note_no bigint, title string, type string, source_domain string, confidence string, status string, "
    "tags array<string>, related array<string>, cross_links array<string>, extra map<string,string>, body string"
)


def note(conv, chunks, no, title, type_=None, extra=None):
    return (conv, 7, chunks, no // 100_000, no, title, type_, None, None, None, None, None, None, extra, f"body {no}")


def test_merge_and_index_by_chunks(spark):
    alike = ["Quarterly ledger review 1", "Quarterly ledger review 2"]
    rows = [note(c, n, k * 100_000 * (n - 1) + k, t) for c, n in (("one", 1), ("two", 2), ("bare", 1)) for k, t in enumerate(alike)]
    rows += [note("one", 1, 5, "MOC first"), note("one", 1, 6, "Overview", "MOC"), note("two", 2, 6, "MOC part", None, {"detected_client": '"Acme"'})]
    atoms, index = pipeline.settled(spark.createDataFrame(rows, N))
    got = sorted((r.conv_id, r.title) for r in atoms.collect())
    assert got == [("bare", alike[0]), ("bare", alike[1]), ("one", alike[0]), ("one", alike[1]), ("two", alike[0])]
    by = {r.conv_id: r for r in pipeline.stamped(index.withColumn("is_index", pipeline.F.lit(True)), spark.createDataFrame([(8, 90)], "file_id bigint, image_only_pct int"), "d").collect()}
    assert len(by) == 3 == index.count() and by["one"].title == "Overview" and by["one"].body == "body 6"
    assert by["two"].body == f"# MOC - two\n\n## General\n- [[{alike[0]}]] (atomic-note)" and by["two"].extra == {"detected_client": '"Acme"'}
    assert by["bare"].title == "MOC - bare" and by["bare"].type == "moc" and by["bare"].body.count("[[") == 2
    warned = pipeline.stamped(index.where("conv_id = 'two'").withColumn("is_index", pipeline.F.lit(True)), spark.createDataFrame([(7, 90)], "file_id bigint, image_only_pct int"), "d").first()
    assert warned.body.startswith("# MOC - two\n\n> ⚠ This source PDF was 90% image-only.") and "90% image-only" in warned.extra["extraction_warning"]
