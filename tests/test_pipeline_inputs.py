"""Every input of a run comes out as turns or as a row with its error."""

import json

from quillspan.plans import pipeline
from quillspan.sources import sinks

READER = """
import json

class Page:
    width, height = 100.0, 100.0
    def __init__(self, text, images):
        self.text, self.images = text, images
    def find_tables(self):
        return []
    def extract_words(self):
        return []
    def extract_text(self):
        return self.text

class Doc:
    def __init__(self, pages):
        self.pages = [Page(*p) for p in pages]
    def __enter__(self):
        return self
    def __exit__(self, *a):
        pass

def open(data):
    return Doc(json.loads(data.read()))
"""


def test_pdfs_and_unreadable_files(spark, tmp_path):
    inp, vault, lib = tmp_path / "in", tmp_path / "vault", tmp_path / "lib"
    for d in (inp, vault, lib):
        d.mkdir()
    pages = [[f"Plant Report {n}\n{x}\nPage {n}", []] for n, x in enumerate(("the walnut ledger", "the granary violin", "the lantern compass"), 1)]
    (inp / "a.pdf").write_text(json.dumps(pages))
    (inp / "b.PDF").write_text(json.dumps([["short scan", ["i"]], ["", ["i"]]]))
    (inp / "broken.pdf").write_text("{")
    (inp / "broken.docx").write_bytes(b"no")
    (inp / "c.txt").write_text("plain words")

    def run():
        rows = [json.loads(r.json) for r in pipeline.parse_only(spark, str(inp)).collect()]
        return [r["content"] for r in rows if "error" not in r], {r["name"] for r in rows if "error" in r}

    # without the reader no PDF is lost without a word
    assert run() == (["plain words"], {"a.pdf", "b.PDF", "broken.pdf", "broken.docx"})
    (lib / "pdfplumber.py").write_text(READER)
    spark.sparkContext.addPyFile(str(lib / "pdfplumber.py"))
    texts, errors = run()
    assert sorted(texts) == ["plain words", "short scan", "the walnut ledger\n\nthe granary violin\n\nthe lantern compass"] and errors == {"broken.pdf", "broken.docx"}
    t = pipeline.full(spark, str(inp), str(vault), str(tmp_path / "out"))
    assert {r.name for r in t["failed"].collect()} == errors
    assert {r.input_file for r in t["manifest"].collect()} == {"a.pdf", "b.PDF", "c.txt"}
    warned = {r.title: (r.extra or {}).get("extraction_warning") for r in t["notes"].collect()}
    assert "100% image-only" in warned["short scan"] and warned["plain words"] is None
    assert pipeline.optimize_only(spark, str(inp))[2].count() == 2


def test_a_run_saves_its_manifest_and_archives(spark, tmp_path):
    inp, vault, out = tmp_path / "in", tmp_path / "vault", tmp_path / "out"
    inp.mkdir(), vault.mkdir()
    (inp / "Some talk.md").write_text("**Human**: The lantern compass drifts north\n\n**Assistant**: Check the granary violin bearings")
    (inp / "bad.docx").write_text("no archive")
    dirs = {"manifest_dir": str(tmp_path / "m"), "archive_dir": str(tmp_path / "a"), "codes": [("general", "GEN")]}
    planned = pipeline.full(spark, str(inp), str(vault), str(out), settings=pipeline.Settings(run_date="2025-02-03", dry_run=True, **dirs))
    assert [r.archived_as for r in planned["archived"].collect()] == ["2025-02-03_001_GEN-UNK-DOC_Some-talk.md"] and not (tmp_path / "m").exists()
    t = pipeline.full(spark, str(inp), str(vault), str(out), settings=pipeline.Settings(run_date="2025-02-03", **dirs))
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["2025-02-03_001_GEN-UNK-DOC_Some-talk.md"]
    assert [p.name for p in inp.iterdir()] == ["bad.docx"] and t["failed"].count() == 1
    saved, version = sinks.latest_manifest(spark, str(tmp_path / "m"))
    assert version == 1 and [(r.input_file, r.archived_as.endswith("Some-talk.md")) for r in saved.collect()] == [("Some talk.md", True)]
    (inp / "again.md").write_text("**Human**: The lantern compass drifts north\n\n**Assistant**: Check the granary violin bearings")
    (inp / "new.md").write_text("**Human**: Something else entirely\n\n**Assistant**: Yes")
    t = pipeline.full(spark, str(inp), str(vault), str(out), settings=pipeline.Settings(run_date="2025-02-03", manifest_dir=str(tmp_path / "m")))
    assert sorted(r.input_file for r in t["manifest"].collect()) == ["new.md"]
    saved, version = sinks.latest_manifest(spark, str(tmp_path / "m"))
    assert version == 2 and saved.count() == 2
