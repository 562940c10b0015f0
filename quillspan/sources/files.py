"""Files as rows, format detection and dispatch to turns.

A file row is (file_id, name, content) with decoded text; binary formats come from ``read_binary``. A turn row is
(file_id, conv_no, session, turn, role, content, timestamp).
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillspan.functions import speakers
from quillspan.functions.text import strip

# The file types that are read, and the names of formats.
SUFFIXES = (".md", ".txt", ".json", ".pdf", ".docx")
FORMATS = ("claude-json", "chatgpt-json", "markdown", "copilot", "plaintext", "pdf", "docx")


def list_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of one file or of a folder's files of known types, by path; raises if there is none.

    Spark's file source leaves out names that start with '.' or '_'."""
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    files = spark.read.format("binaryFile").load(path).where(suffix.isin(*SUFFIXES)).select("path", "length", "content")
    if not files.take(1):
        raise FileNotFoundError(f"no input of a known type at {path}")
    return files.orderBy("path")


@pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else bytes(b).decode("utf-8-sig", errors="replace"))


def decode(c) -> Column:
    """Bytes as UTF-8 text: a leading byte order mark goes, invalid bytes become U+FFFD."""
    return _decode(F.col(c) if isinstance(c, str) else c)


def detect_format(name, content) -> Column:
    """The format of a file by its name's suffix and its text; JSON that is none is plain text."""
    name, content = (F.col(x) if isinstance(x, str) else x for x in (name, content))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    doc = F.try_parse_json(F.regexp_replace(content, "^﻿", ""))
    first = F.coalesce(F.try_variant_get(doc, "$[0]", "variant"), doc)
    items = F.transform(F.slice(F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc)), 1, 5), lambda v: F.try_variant_get(v, "$.mapping", "map<string,variant>"))
    chatgpt = F.exists(items, lambda m: m.isNotNull())
    return (
        F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx")
        .when((suffix == ".json") & (doc.isNull() | first.isNull()), "plaintext")
        .when((suffix == ".json") & F.coalesce(chatgpt, F.lit(False)), "chatgpt-json")
        .when(suffix == ".json", "claude-json")
        .when(speakers.looks_copilot(content), "copilot")
        .when(suffix == ".md", "markdown").otherwise("plaintext")
    )


def text_turns(files: DataFrame, form: str) -> DataFrame:
    """Turns of markdown, copilot or plaintext files (also of text taken from pdf and docx)."""
    turns = speakers.plain_turns("content") if form not in ("markdown", "copilot") else speakers.speaker_turns("content", form == "copilot")
    return files.select("file_id", F.posexplode(turns).alias("turn", "t")).select(
        "file_id", F.lit(0).alias("conv_no"), F.lit(None).cast("string").alias("session"), "turn", "t.role", "t.content", F.lit(None).cast("string").alias("timestamp")
    )


def parse_files(files: DataFrame, form: str | None = None) -> DataFrame:
    """Turns of all files (file_id, name, content), each by its format (or all by ``form``); conversations without a
    turn give no rows. An unknown ``form`` raises ValueError."""
    from quillspan.sources.chats import chatgpt_turns, claude_turns

    if form not in (None, "auto", *FORMATS):
        raise ValueError(f"unknown format: {form}")
    auto = form in (None, "auto")
    marked = files.withColumn("format", detect_format("name", "content") if auto else F.lit(form))
    parts = [
        claude_turns(marked.where("format = 'claude-json'")), chatgpt_turns(marked.where("format = 'chatgpt-json'")),
        text_turns(marked.where("format = 'markdown'"), "markdown"), text_turns(marked.where("format = 'copilot'"), "copilot"),
        text_turns(marked.where("format IN ('plaintext', 'pdf', 'docx')"), "plaintext"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_vault(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all markdown files below a folder, hidden names included, by the parts of their paths.

    Names are listed on the driver (the file source skips hidden ones), contents are read by the tasks; the folder must
    be one that all executors share."""
    paths = [os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".md")]

    def load(batches):
        for pdf in batches:
            rows = []
            for p in pdf.path:
                try:
                    with open(p, "rb") as f:
                        rows.append((p, f.read().decode("utf-8-sig", errors="replace")))
                except OSError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "content"])

    listed = spark.createDataFrame([(p,) for p in sorted(paths, key=lambda p: p.split("/"))], "path string")
    return listed.mapInPandas(load, "path string, content string").orderBy(F.split("path", "/"))


def vault_index(notes: DataFrame) -> DataFrame:
    """The index row of each note file (path, content): title from its metadata, else its first heading, else the stem."""
    from quillspan.functions.text import concept_phrases, tags_of
    from quillspan.functions.unicode import kebab_case, link_target_keys, nfc
    from quillspan.operators.notes import parse

    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    titled = parse(notes.withColumn("raw", F.col("content")).withColumnRenamed("content", "block").withColumn("stem", stem))
    meta_title = F.regexp_extract("raw", r"(?ms)\A\s*---\s*\n.*?^title:\s*\S", 0) != ""
    heading = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    title = strip(nfc(F.when(meta_title, F.col("title")).when(heading != "", heading).otherwise(F.col("stem"))))
    session = F.regexp_replace(F.coalesce(F.get_json_object(F.to_json("extra"), "$.source_session"), F.lit("")), '^"|"$', "")
    return titled.withColumn("title", title).select(
        "path", "title", F.lower("title").alias("title_key"), "stem", kebab_case("title").alias("slug"), tags_of("tags").alias("tags"),
        session.alias("session"), F.coalesce(F.lower(strip("type")), F.lit("atomic-note")).alias("note_type"), F.lower("body").alias("body_lower"),
        link_target_keys("body", "related", "cross_links").alias("link_keys"), concept_phrases("title").alias("phrases"),
    )


def read_config(path: str) -> dict:
    """Settings from a YAML file, which must hold a mapping."""
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f) or {}
    if not isinstance(out, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return out


def read_legacy_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a saved JSON manifest; a missing or damaged file gives none, entries that are no objects are left out."""
    import json

    schema = "input_file string, original_path string, sha256 string, processed_date string, session_name string, notes_generated int, output_files array<string>, archived_as string"
    try:
        with open(path, encoding="utf-8") as f:
            entries = json.load(f).get("processed", [])
    except (OSError, ValueError, AttributeError):
        entries = []
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries if isinstance(e, dict)], schema)
