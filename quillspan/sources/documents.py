"""Office documents and PDF files as text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = re.compile(r"heading\s+(\d)", re.I)


def table_text(rows: list[list[str | None]]) -> str:
    """Rows of cells as a markdown table; '' without any text."""
    clean = [[re.sub(r"\s+", " ", c or "").strip().replace("|", "\\|") for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    if not clean:
        return ""
    width = max(map(len, clean))
    text = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in clean]
    return "\n".join([text[0], "| " + " | ".join(["---"] * width) + " |", *text[1:]])


def _on(run, tag: str) -> bool:
    e = run.find(f"{_W}rPr/{_W}{tag}")
    return e is not None and e.get(f"{_W}val", "true") not in ("0", "false", "off")


def _run(run) -> str:
    parts = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
    text = "".join(parts[t](e) for e in run for t in (e.tag.removeprefix(_W),) if t in parts)
    mark = "*" * (2 * _on(run, "b") + _on(run, "i"))
    core = text.strip()
    return text if not core or not mark else text.replace(core, f"{mark}{core}{mark}", 1)


def _paragraph(p, styles: dict[str, str]) -> str:
    text = "".join(_run(r) for r in p.iter(f"{_W}r"))
    if not text.strip():
        return ""
    s = p.find(f"{_W}pPr/{_W}pStyle")
    style = styles.get(s.get(f"{_W}val"), s.get(f"{_W}val", "")).strip() if s is not None else ""
    if m := _R.fullmatch(style):
        return "#" * min(int(m[1]), 6) + " " + text.strip()
    if style.lower() == "title":
        return "# " + text.strip()
    return "- " + text.strip() if style.lower().startswith("list") else text


def docx_text(data: bytes) -> str:
    """Paragraphs and tables of a .docx file in document order, with headings, lists and bold or italic runs marked.
    Raises ValueError for a file that is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
            styles = {}
            if "word/styles.xml" in z.namelist():
                for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                    name = s.find(f"{_W}name")
                    if name is not None:
                        styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ValueError(f"not a docx file: {e}") from e
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            out.append(_paragraph(e, styles))
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            out.append(table_text(rows))
    return "\n\n".join(x for x in out if x)


def docx_files(files: DataFrame) -> DataFrame:
    """(file_id, name, content text, error) of .docx files (file_id, name, content binary)."""

    @pandas_udf("text string, error string")
    def f(s: pd.Series) -> pd.DataFrame:
        rows = []
        for b in s:
            try:
                rows.append((docx_text(bytes(b)) if b is not None else None, None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["text", "error"])

    return files.select("file_id", "name", f("content").alias("r")).select("file_id", "name", F.col("r.text").alias("content"), "r.error")


def _page(n: int, page) -> tuple:
    try:
        tables = page.find_tables()
    except Exception:  # a page whose tables cannot be told is read as text
        tables = []
    boxes = [t.bbox for t in tables]

    def outside(o):
        x, y = (o["x0"] + o["x1"]) / 2, (o["top"] + o["bottom"]) / 2
        return not any(a <= x <= c and b <= y <= d for a, b, c, d in boxes)

    whole = page.extract_text() or ""
    if boxes:
        text = page.filter(outside).extract_text() or ""
    elif gutter([(w["x0"], w["x1"]) for w in page.extract_words()], float(page.width)):
        half = page.width / 2
        sides = (page.crop((0, 0, half, page.height)), page.crop((half, 0, page.width, page.height)))
        text = "\n".join((s.extract_text() or "").strip() for s in sides).strip()
    else:
        text = whole
    md = [x for x in (table_text(t.extract()) for t in tables) if x]
    return n, whole, len(page.images), [x.rstrip() for x in text.splitlines()], md


def pdf_pages(files: DataFrame) -> DataFrame:
    """(file, page_no, text, n_images, lines, tables, error) of .pdf files (file_id, name, content binary); needs the
    optional package ``pdfplumber``. Text inside tables is left to the tables; two columns are read one after the
    other. A file that cannot be read gives one row with its error and no page."""

    def go(batches):
        for pdf in batches:
            rows = []
            for name, data in zip(pdf.name, pdf.content):
                try:
                    import pdfplumber

                    with pdfplumber.open(io.BytesIO(bytes(data))) as doc:
                        rows += [(name, *_page(n, page), None) for n, page in enumerate(doc.pages, 1)]
                except Exception as e:
                    rows = [r for r in rows if r[0] != name] + [(name, None, None, None, None, None, f"not a readable pdf file: {type(e).__name__}: {e}"[:500])]
            yield pd.DataFrame(rows, columns=["file", "page_no", "text", "n_images", "lines", "tables", "error"]).astype({"page_no": "Int32", "n_images": "Int32"})

    return files.select("name", "content").mapInPandas(go, "file string, page_no int, text string, n_images int, lines array<string>, tables array<string>, error string")


def gutter(words: list[tuple[float, float]], width: float) -> bool:
    """Do the words (x0, x1) leave a clear gutter in the middle of the page."""
    low, high = width / 2 - width * 0.04, width / 2 + width * 0.04
    left = sum(b < low for _, b in words)
    right = sum(b >= low and a > high for a, b in words)
    return len(words) >= 20 and left >= 10 and right >= 10 and len(words) - left - right <= max(1, len(words) * 0.02)


def joined_pages(pages: DataFrame) -> DataFrame:
    """(name, content): pages (file, page_no, lines, tables) as one text per file, tables behind their page's text."""
    text = F.regexp_replace(F.array_join("lines", "\n"), r"(?U)^\s+|\s+$", "")
    block = F.array_join(F.filter(F.concat(F.array(text), F.coalesce("tables", F.array().cast("array<string>"))), lambda x: x != ""), "\n\n")
    per = pages.select("file", "page_no", block.alias("b")).where("b <> ''").groupBy("file")
    return per.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "b"))), lambda x: x["b"]), "\n\n").alias("content")).withColumnRenamed("file", "name")
