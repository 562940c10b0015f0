"""Notes: split from a writer's output, parsed, normalised, merged, indexed, named and rendered.

The column shape of a note is (note_no, title, type, source_domain, confidence, status, tags, related, cross_links,
extra map<string,string> of JSON values, body).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.functions.text import strip
from quillspan.functions.unicode import kebab_case
from quillspan.operators.similar import similar_pairs
from quillspan.plans.leaders import leaders

BREAK = r"(?m)^\s*-{3,}\s*ATOM_BREAK\s*-{3,}\s*$"
# The words that fields may hold, the default last.
TYPES = ("decision", "insight", "open-question", "artifact", "prompt", "moc", "atomic-note")
CONFIDENCE = ("high", "speculative", "medium")
DOMAINS = ("structural-engineering", "software", "strategy", "brand", "lab-ops", "general")
MERGE_SIMILARITY = 0.85

# Metadata in front of a note, and a first-level heading.
FRONT = r"(?s)\A\s*---\s*\n(.*?)\n---\s*\n?"
_HEADING = r"(?dmU)^#\s+(.+?)\s*$"
_FIELDS = ("title", "type", "source_domain", "confidence", "status")
_LISTS = ("tags", "related", "cross_links")
_NOTE = ", ".join([*(f"{c} string" for c in _FIELDS), *(f"{c} array<string>" for c in _LISTS), "extra map<string,string>"])


def blocks(df: DataFrame, text: str) -> DataFrame:
    """Adds (block_no, block): the text, freed of one outer fence, split at break lines; blank blocks are left out."""
    inner = F.regexp_extract(F.trim(strip(text)), r"(?s)\A```[a-zA-Z]*\n(.*)\n```\s*\z", 1)
    freed = F.when(inner != "", inner).otherwise(F.col(text))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(freed, BREAK)).alias("block_no", "block")).where(strip("block") != "")


def _as_list(v) -> list[str] | None:
    if v is None or v == "" or v is False:
        return None
    return [_whole(str(x)) for x in v] if isinstance(v, list) else [_whole(str(v))]


def _whole(x: str) -> str:
    """Escapes of both halves of a character, as JSON writes it, joined to the character; a half alone becomes U+FFFD."""
    return x if x.isascii() else x.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def metadata(front) -> Column:
    """Metadata text as a struct of the known fields, lists and ``extra``; NULL, broken or not a mapping counts as empty."""
    import yaml

    @pandas_udf(_NOTE)
    def load(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for x in texts:
            try:
                found = yaml.safe_load(x) if x else None
            except (yaml.YAMLError, ValueError):
                found = None
            found = {_whole(str(k)): v for k, v in found.items()} if isinstance(found, dict) else {}
            row = {c: None if found.get(c) is None else _whole(str(found[c])) for c in _FIELDS} | {c: _as_list(found.get(c)) for c in _LISTS}
            rows.append(row | {"extra": {k: _whole(json.dumps(v, default=str, ensure_ascii=False)) for k, v in found.items() if k not in row}})
        return pd.DataFrame(rows, columns=[*_FIELDS, *_LISTS, "extra"])

    return load(front)


def parse(df: DataFrame, block: str = "block") -> DataFrame:
    """Replaces ``block`` by the note's columns. The title is that of the metadata, else the first heading's, else the
    first line; blocks without any are dropped. Only the metadata text goes through Python."""
    text = F.coalesce(strip(block), F.lit(""))
    front = F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 1))
    named = df.withColumn("_m", metadata(front)).withColumn("body", F.when(text.rlike(FRONT), strip(F.regexp_replace(text, FRONT, ""))).otherwise(text))
    first = F.regexp_replace(strip(F.regexp_extract("body", r"\A([^\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]*)", 1)), "^#+", "")
    title = F.coalesce(*[F.nullif(x, F.lit("")) for x in (strip("_m.title"), F.regexp_extract("body", _HEADING, 1), F.substring(strip(first), 1, 80))])
    rest = [F.col(f"_m.{c}").alias(c) for c in (*_FIELDS[1:], *_LISTS, "extra")]
    return named.withColumn("_t", title).where("_t IS NOT NULL").select(*[c for c in df.columns if c != block], F.col("_t").alias("title"), *rest, "body")


def one_of(c, words: tuple[str, ...]) -> Column:
    x = F.lower(strip(c))
    return F.when(x.isin(*words), x).otherwise(words[-1])


def normalise(notes: DataFrame, provenance: dict[str, Column]) -> DataFrame:
    """Fields with a fixed vocabulary checked, lists cleaned, provenance set over whatever the note says."""
    lists = {
        c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))
        for c in ("tags", "related")
    }
    status = F.lower(strip("status"))
    return notes.withColumns({
        "type": one_of("type", TYPES), "confidence": one_of("confidence", CONFIDENCE), "source_domain": one_of("source_domain", DOMAINS),
        "status": F.when(status.isNull() | (status == ""), "active").otherwise(status), **lists, **provenance,
    })


def is_index(title, type_) -> Column:
    """Index notes: by type, or by a title that starts with 'moc'."""
    return F.coalesce(F.lower(strip(type_)) == "moc", F.lit(False)) | F.lower(F.col(title)).startswith("moc")


def merge(notes: DataFrame, group: str, order: str, threshold: float = MERGE_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Notes whose title is much like an earlier kept one's are dropped within ``group``; links are pointed at the
    survivors. Gives the kept notes and the map (group, title_key, survivor); of equal keys the last note counts."""
    keyed = notes.withColumn("_k", F.lower(strip("title")))
    items = keyed.groupBy(group, F.col("_k").alias("text")).agg(F.min(order).cast("bigint").alias("item"))
    lead = leaders(similar_pairs(items, group, threshold), [group])
    placed = items.join(lead, [group, "item"], "left").withColumn("leader", F.coalesce("leader", "item")).select(group, F.col("text").alias("_k"), "leader")
    joined = keyed.join(placed, [group, "_k"])
    kept = joined.where(F.col("leader") == F.col(order)).drop("_k", "leader")
    survivor = kept.select(group, F.col(order).cast("bigint").alias("leader"), F.col("title").alias("survivor"))
    titles = joined.join(survivor, [group, "leader"]).groupBy(group, F.lower("title").alias("title_key")).agg(F.max_by("survivor", order).alias("survivor"))
    return repoint(kept, titles, group, order), titles


def repoint(notes: DataFrame, titles: DataFrame, group: str, order: str) -> DataFrame:
    """Links in bodies and related lists rewritten by (group, title_key, survivor); a link with '#' stays."""
    found = F.regexp_extract_all(F.concat_ws("\n", F.coalesce("body", F.lit("")), "related"), F.lit(r"\[\[([^\]|#]+)(?:\|[^\]]*)?\]\]"), F.lit(1))
    asked = notes.select(group, order, F.explode(F.array_distinct(F.transform(found, lambda x: F.lower(strip(x))))).alias("title_key"))
    needed = asked.join(titles, [group, "title_key"]).where(F.lower("survivor") != F.col("title_key"))
    maps = needed.groupBy(group, order).agg(F.map_from_entries(F.collect_list(F.struct("title_key", "survivor"))).alias("_m"))  # at most the links of one note

    out = notes.join(maps, [group, order], "left")
    listed = F.array_distinct(F.transform("related", lambda x: with_survivors(x, F.col("_m"))))
    return out.withColumn("body", with_survivors(F.col("body"), F.col("_m"))).withColumn("related", listed).drop("_m")


def with_survivors(text: Column, survivors: Column) -> Column:
    """Link targets replaced by what ``survivors`` (map of lower-case titles) gives for them; shown text is kept. Cut at
    opening brackets, each part but the first begins with a target."""
    def one(part, i):
        target = F.regexp_extract(part, r"\A([^\]|#]+)(?=(?:\|[^\]]*)?\]\])", 1)
        new = F.try_element_at(survivors, F.lower(strip(target)))
        changed = (i > 0) & (target != "") & (new != "") & (F.lower(new) != F.lower(strip(target)))
        return F.when(changed, F.concat(new, F.substring(part, F.length(target) + 1, F.length(part)))).otherwise(part)

    return F.when(survivors.isNull(), text).otherwise(F.array_join(F.transform(F.split(text, r"\[\[", -1), one), "[["))


def index_note(notes: DataFrame, group: str, order: str) -> DataFrame:
    """(group, title, body): one index note per group, its notes listed by domain in order. The body holds a line
    for each note, so it is as large as the group's list of titles."""
    name = F.initcap(F.replace("source_domain", F.lit("-"), F.lit(" ")))
    line = F.concat(F.lit("- [["), F.col("title"), F.lit("]] ("), F.col("type"), F.lit(")"))
    per = notes.groupBy(group, "source_domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("ls"))
    part = F.concat(F.lit("## "), name, F.lit("\n"), F.col("ls"))
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_domain", part.alias("p")))), lambda x: x["p"]), "\n\n")
    return per.groupBy(group).agg(all_.alias("parts")).select(
        group, F.concat(F.lit("MOC - "), F.col(group)).alias("title"), F.concat(F.lit("# MOC - "), F.col(group), F.lit("\n\n"), F.col("parts")).alias("body")
    )


def names(notes: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """Adds ``slug`` and ``file_name``: the slug, then slug-v2, slug-v3 and so on within a folder, in order."""
    n = F.row_number().over(Window.partitionBy(folder, "slug").orderBy(*order))
    return notes.withColumn("slug", kebab_case("title")).withColumn("n", n).withColumn(
        "file_name", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("-v"), F.col("n").cast("string"))).otherwise(""), F.lit(".md"))
    ).drop("n")


def render(notes: DataFrame, fields: list[str]) -> Column:
    """The note as a document: metadata in the order of ``fields`` and then the extras, title line, body."""
    import yaml  # noqa: F401  (fails early where it is missing)

    @pandas_udf("string")
    def f(head: pd.Series, extra: pd.Series, title: pd.Series, body: pd.Series) -> pd.Series:
        import yaml

        out = []
        for h, e, t, b in zip(head, extra, title, body):
            meta = json.loads(h) | {k: json.loads(v) for k, v in (dict(e) if e is not None else {}).items()}
            text = (b or "").strip()
            text = text if text.startswith("#") else f"# {t}\n\n{text}"
            top = yaml.safe_dump(meta, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1000).strip()
            out.append(f"---\n{top}\n---\n\n{text}\n")
        return pd.Series(out)

    return f(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), F.col("extra"), F.col("title"), F.col("body"))


def extract(chunks: DataFrame, complete, system: str, user: str) -> DataFrame:
    """Runs an injected ``complete(system, user) -> (text, input tokens, output tokens)`` per row on the executors and
    adds (text, input_tokens, output_tokens, error); a failing call gives a row with its error."""

    @pandas_udf("text string, input_tokens bigint, output_tokens bigint, error string")
    def call(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            try:
                rows.append((*complete(x, y), None))
            except Exception as e:
                rows.append((None, 0, 0, str(e)[:500]))
        return pd.DataFrame(rows, columns=["text", "input_tokens", "output_tokens", "error"])

    return chunks.withColumn("_r", call(system, user)).select(*chunks.columns, "_r.*")


def first_line_writer(system: str, user: str) -> tuple[str, int, int]:
    """A stand-in for a language model, for tests and runs without a network: one note per turn, titled by its first line."""
    turns = re.findall(r'<turn n="\d+" role="(\w+)"[^>]*>\n(.*?)\n</turn>', user, re.S)
    parts = [f"---\ntitle: {json.dumps(b.strip().splitlines()[0][:60])}\ntype: atomic-note\ntags: [{r.lower()}]\n---\n{b.strip()}" for r, b in turns if b.strip()]
    text = "\n---ATOM_BREAK---\n".join(parts)
    return text, len(user) // 4, len(text) // 4
