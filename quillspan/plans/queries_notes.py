"""Queries over notes, links, manifests and archives, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.unicode import kebab_case, link_target_keys, topic
from quillspan.operators import archive, linking, manifest, notes, relinking, summary
from quillspan.plans.blocks import latest
from quillspan.session import cut, read
from quillspan.sources import sinks

# Settings of the taxonomy query: keys and codes, in order.
TAXONOMY = [("chat", "CH"), ("mail", "ML"), ("chat-export", "CX"), ("wiki", "WK"), ("reports", "RP"), ("vault", "VT"), ("log", "LG"), ("notes", "NT"), ("field-memos archive", "FM")]


def vault(spark, d) -> DataFrame:
    """Link rows of the newest state of each note."""
    cols = ["note_path", "title", "tags", "source_session", "note_type", "body_lower", "link_targets"]
    v = latest(read(spark, d, "vault_notes").where("note_id IS NOT NULL"), ["note_id"], F.col("indexed_at"), cols)
    stem = F.regexp_replace(F.substring_index("note_path", "/", -1), r"\.md$", "")
    return v.select(
        F.col("note_id").alias("id"), F.coalesce("note_path", F.lit("")).alias("path"), "title", F.lower(T.strip("title")).alias("title_key"), stem.alias("stem"), kebab_case("title").alias("slug"),
        T.tags_of("tags").alias("tags"), T.concept_phrases("title").alias("phrases"), F.coalesce("body_lower", F.lit("")).alias("body_lower"),
        F.coalesce("link_targets", F.array().cast("array<string>")).alias("link_keys"), F.col("source_session").alias("session"), F.lower(T.strip("note_type")).alias("note_type"), F.lit(False).alias("new"),
    )


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    """The searching notes (every id divisible by 100) and all notes."""
    v = cut(vault(spark, d))
    return v.where("id % 100 = 0"), v


def _tag_pairs(spark, d):
    s, v = _both(spark, d)
    return linking.tag_pairs(s, v).select("src", "tgt", F.array_join("shared_tags", ",").alias("shared_tags"))


def _concepts(spark, d):
    return linking.concept_pairs(*_both(spark, d))


def _titles(spark, d):
    return linking.title_pairs(*_both(spark, d))


def _top(spark, d, titles):
    s, v = _both(spark, d)
    return linking.top(linking.best(s, v, titles), v).select("src", "tgt", "score", "reason", "rank")


def _back(spark, d):
    s, v = _both(spark, d)
    fwd = linking.forward_links(linking.top(linking.best(s, v, False), v), v)
    return linking.back_links(fwd, s).select("tgt", F.array_join(F.transform("links", lambda x: F.concat(x["title"], F.lit(" | "), x["reason"])), "\n").alias("links"))


def _relink(spark, d):
    v = cut(vault(spark, d))
    return relinking.relink(v)


def _forward_notes(spark, d):
    """All notes that get new links, with the footer of these links."""
    v = cut(vault(spark, d))
    fwd = linking.forward_links(linking.top(linking.best(v, v, False), v), v)
    per = fwd.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", T.bullet("tgt_title", "reason").alias("b")))), lambda x: x["b"]).alias("bs"))
    return v.hint("merge").join(per.hint("merge"), F.col("src") == F.col("id")).select("id", F.md5(F.encode(T.append_footer("body_lower", "bs"), "UTF-8")).alias("body"))


def _dangling(spark, d):
    v = vault(spark, d).select("id", "title", "slug", F.col("body_lower").alias("body"), F.lit(None).cast("array<string>").alias("related"), F.lit(None).cast("array<string>").alias("cross_links"), "session")
    return linking.dangling(v, "session")


def _index_notes(spark, d):
    v = read(spark, d, "vault_notes").where("source_session IS NOT NULL AND title IS NOT NULL").select("note_id", "title", "source_session", "note_type").distinct()
    v = v.groupBy("note_id", "source_session").agg(F.max(F.struct("title", "note_type")).alias("r")).select("note_id", "source_session", "r.title", notes.one_of("r.note_type", notes.TYPES).alias("type"))
    v = v.withColumn("source_domain", F.when(F.pmod("note_id", F.lit(3)) == 0, "lab-ops").when(F.pmod("note_id", F.lit(3)) == 1, "software").otherwise("general"))
    return notes.index_note(v.withColumnRenamed("source_session", "session"), "session", "note_id")


def _names(spark, d):
    v = vault(spark, d).select("id", "title", F.substring_index("path", "/", 1).alias("folder"))
    return notes.names(v, "folder", ["id"]).select("id", "folder", "file_name")


def _note_documents(spark, d) -> DataFrame:
    """Note documents of a session as one writer's output with break lines."""
    docs = read(spark, d, "documents").where("doc_kind = 'note' AND session_name IS NOT NULL AND text IS NOT NULL")
    per = docs.groupBy("session_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n---ATOM_BREAK---\n").alias("text"))
    return notes.blocks(per, "text")


def _parsed(spark, d):
    return notes.parse(_note_documents(spark, d)).select("session_name", "block_no", "title", F.array_join("tags", ",").alias("tags"))


def _merged(spark, d):
    n = notes.parse(_note_documents(spark, d)).withColumn("note_no", F.col("block_no"))
    return notes.merge(n, "session_name", "note_no")[0].select("session_name", "note_no", "title")


def _rendered(spark, d):
    prov = {"source_session": F.col("session_name"), "created": F.lit("2025-01-01")}
    n = notes.normalise(notes.parse(_note_documents(spark, d)), prov)
    fields = ["type", "source_session", "source_domain", "created", "confidence", "tags", "related", "status"]
    return n.select("session_name", "block_no", notes.render(n, fields).alias("document"))


def _normalised(spark, d):
    v = read(spark, d, "vault_notes").select("note_id", F.col("note_type").alias("type"), F.lit(None).cast("string").alias("confidence"), F.col("source_session").alias("source_domain"), F.lit(" Active ").alias("status"), "tags", F.col("link_targets").alias("related"))
    return notes.normalise(v, {}).select("note_id", "type", "confidence", "source_domain", "status", F.array_join("tags", "|").alias("tags")).distinct()


def _extracted(spark, d):
    from quillspan.plans import queries_text

    t = queries_text.turns(spark, d).withColumn("timestamp", F.lit(None).cast("string"))
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "timestamp"))).alias("ts")).select("conv_id", T.transcript("ts").alias("user"), F.lit("").alias("system"))
    out = notes.extract(per, notes.first_line_writer, "system", "user")
    return notes.parse(notes.blocks(out.select("conv_id", "text"), "text")).select("conv_id", "block_no", "title")


def _files(spark, d) -> DataFrame:
    f = read(spark, d, "input_files").select("file_id", "input_file", "content", "batch_no", "arrived_at").distinct()
    return manifest.with_hash(f)


def _known(spark, d) -> DataFrame:
    e = manifest.entries(read(spark, d, "manifest"))
    return e.withColumn("content_sha", F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", ""))


def _upsert(spark, d):
    """The manifest as one row per hash, with the files of all batches after the accepted history put in anew."""
    old = _known(spark, d).where("content_sha IS NOT NULL").groupBy("content_sha").agg(F.max("file_id").alias("file_id"))
    new = _files(spark, d).where("batch_no > 0").groupBy("content_sha").agg((-F.max("file_id")).alias("file_id"))
    return manifest.upsert(old, new)


def _archive(spark, d):
    f = read(spark, d, "input_files").select("file_id", "input_file", "arrived_at", "session_name").distinct().groupBy("file_id").agg(F.min(F.struct("arrived_at", "input_file", "session_name")).alias("r")).select("file_id", "r.*")
    f = f.where("arrived_at IS NOT NULL").withColumn("day", F.date_format("arrived_at", "yyyy-MM-dd"))
    f = archive.lookup(archive.sequences(f, "day", ["file_id"]), "session_name", [("inbox", "INB"), ("sess", "SES")], "code")
    suffix = F.regexp_extract("input_file", r"(\.[^./]+)$", 1)
    return f.select("file_id", archive.archive_name(F.col("day"), F.col("seq"), F.col("code"), F.lit("UNK"), F.lit("DOC"), topic("session_name"), suffix).alias("name"))


def _taxonomy(spark, d):
    return archive.lookup(read(spark, d, "documents").select("doc_id", "source"), "source", TAXONOMY, "code").select("doc_id", "code")


def _majority(spark, d):
    r = read(spark, d, "documents").where("session_name IS NOT NULL AND source IS NOT NULL").select("session_name", F.lower(F.trim("source")).alias("source"), "doc_id")
    return archive.majority(r, "session_name", "source", "doc_id")


def _link_stats(spark, d):
    s, v = _both(spark, d)
    fwd = cut(linking.forward_links(linking.top(linking.best(s, v, False), v), v))
    return summary.link_stats(fwd, linking.back_links(fwd, s))


def _preview(spark, d):
    s, v = _both(spark, d)
    fwd = linking.forward_links(linking.top(linking.best(s, v, False), v), v)
    return summary.preview(fwd, s)


def _reports(spark, d):
    from quillspan.plans import queries_text

    return summary.report_lines(queries_text.queries()["optimize_report"](spark, d))


def queries() -> dict:
    return {
        "link_stats": _link_stats,
        "link_preview": _preview,
        "report_lines": _reports,
        "first_source": lambda s, d: summary.first_value(read(s, d, "documents").where("session_name IS NOT NULL"), "session_name", "source", "doc_id"),
        "last_document": lambda s, d: summary.last_row(read(s, d, "documents").where("session_name IS NOT NULL"), "session_name", "doc_id", ["lang", "doc_kind"]),
        "session_lists": lambda s, d: summary.ordered_distinct(read(s, d, "documents").where("doc_kind IS NOT NULL"), "doc_kind", "lang", "doc_id").select("doc_kind", F.array_join("values", "|").alias("langs")),
        "wikilinks": lambda s, d: read(s, d, "vault_notes").select("note_id", F.array_join(T.wikilinks("body_lower"), "|").alias("links")).distinct(),
        "link_targets": lambda s, d: read(s, d, "vault_notes").select("note_id", F.array_join(F.array_sort(link_target_keys("body_lower", F.lit(None).cast("array<string>"), "link_targets")), "|").alias("targets")).distinct(),
        "kebab_slugs": lambda s, d: read(s, d, "vault_notes").select("note_id", kebab_case("title").alias("slug")).distinct(),
        "archive_topics": lambda s, d: read(s, d, "vault_notes").select("note_id", topic("title").alias("topic")).distinct(),
        "concept_phrases": lambda s, d: read(s, d, "vault_notes").select("note_id", F.array_join(F.array_sort(T.concept_phrases("title")), "|").alias("phrases")).distinct(),
        "tag_sets": lambda s, d: read(s, d, "vault_notes").select("note_id", F.array_join(F.array_sort(T.tags_of("tags")), "|").alias("tags")).distinct(),
        "index_notes_split": lambda s, d: vault(s, d).groupBy(notes.is_index("title", "note_type").alias("is_index")).agg(F.count("*").alias("n")),
        "tag_pairs": _tag_pairs,
        "concept_pairs": _concepts,
        "title_pairs": _titles,
        "link_topk": lambda s, d: _top(s, d, False),
        "link_topk_all": lambda s, d: _top(s, d, True),
        "back_links": _back,
        "forward_notes": _forward_notes,
        "relink_pairs": _relink,
        "dangling_links": _dangling,
        "index_notes": _index_notes,
        "versioned_names": _names,
        "note_blocks": lambda s, d: _note_documents(s, d).select("session_name", "block_no", F.md5(F.encode(T.strip("block"), "UTF-8")).alias("block")),
        "parsed_notes": _parsed,
        "merged_notes": _merged,
        "normalised_notes": _normalised,
        "rendered_notes": _rendered,
        "extracted_notes": _extracted,
        "manifest_pending": lambda s, d: manifest.pending(_files(s, d), _known(s, d)).select("file_id", "content_sha").distinct(),
        "manifest_skipped": lambda s, d: manifest.skipped(_files(s, d), _known(s, d)).select("file_id", "content_sha").distinct(),
        "manifest_upsert": _upsert,
        "manifest_status": lambda s, d: manifest.status(manifest.entries(read(s, d, "manifest"))),
        "usage_by_session": lambda s, d: manifest.usage(manifest.entries(read(s, d, "manifest")), "session_name"),
        "archive_names": _archive,
        "taxonomy_lookup": _taxonomy,
        "majority_source": _majority,
        "summary_by_type": lambda s, d: vault(s, d).groupBy(F.coalesce("note_type", F.lit("")).alias("note_type"), F.substring_index("path", "/", 1).alias("folder")).agg(F.count("*").alias("n")),
        "json_dump": lambda s, d: sinks.as_json(read(s, d, "turns").select("conv_id", "turn", "role", "content").distinct()),
    }


_STRIP = r"regexp_replace({x}, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("{x}", x)


def _slug(x: str) -> str:
    """SQL: accents off, the rest of non-ASCII out (titles hold no compatibility forms)."""
    plain = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    s = f"regexp_replace(regexp_replace(lower({plain}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"coalesce(nullif(regexp_replace({s}[1:80], '-+$', ''), ''), 'untitled-note')"


def _tags(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(list_filter(coalesce({x}, []), lambda v: v IS NOT NULL), lambda v: lower({_strip('v')})), lambda v: v <> ''))"


_STOP = "['" + "', '".join(T.STOPWORDS) + "']"


def _phrases(x: str) -> str:
    w = f"regexp_extract_all({_strip(x)}, '[A-Za-z0-9][A-Za-z0-9\\-]*[A-Za-z0-9]|[A-Za-z0-9]')"
    plain = f"NOT list_contains({_STOP}, lower(v))"
    single = f"list_transform(list_filter({w}, lambda v: {plain} AND (contains(v, '-') OR regexp_matches(v, '[0-9]') OR length(v) >= 7 OR (length(v) >= 2 AND upper(v) = v AND regexp_matches(v, '[A-Z]')))), lambda v: lower(v))"
    sig = f"list_filter({w}, lambda v: {plain} AND length(v) >= 4)"
    pairs = f"list_transform(range(1, len({sig})), lambda i: lower({sig}[i]) || ' ' || lower({sig}[i + 1]))"
    whole = f"CASE WHEN length({_strip(x)}) >= 6 THEN [lower({_strip(x)})] ELSE [] END"
    return f"list_distinct(list_filter(list_concat({whole}, list_concat({single}, {pairs})), lambda p: length(p) >= 4))"


_VAULT = f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY coalesce(indexed_at, TIMESTAMPTZ '0001-01-01') DESC) AS rn FROM vault_notes WHERE note_id IS NOT NULL),
v AS (SELECT note_id AS id, coalesce(note_path, '') AS path, title, lower({_strip('title')}) AS title_key, regexp_replace(string_split(coalesce(note_path, ''), '/')[-1], '\\.md$', '') AS stem,
  {_slug('title')} AS slug, {_tags('tags')} AS tags, {_phrases('title')} AS phrases, coalesce(body_lower, '') AS body_lower, coalesce(link_targets, []) AS link_keys, source_session AS session, lower({_strip('note_type')}) AS note_type
  FROM ranked WHERE rn = 1)
"""
_TAGP = """,
st AS (SELECT id, unnest(tags) AS tag FROM v WHERE id % 100 = 0), tt AS (SELECT id, unnest(tags) AS tag FROM v),
tp AS (SELECT a.id AS src, b.id AS tgt, count(*) AS k, string_agg(a.tag, ',' ORDER BY a.tag) AS csv, string_agg(a.tag, ', ' ORDER BY a.tag) AS shared FROM st a JOIN tt b USING (tag) WHERE a.id <> b.id GROUP BY ALL HAVING count(*) >= 3)
"""
_ESC = r"regexp_replace(p, '([\\.\+\*\?\(\)\[\]\{\}\^\$\|])', '\\\1', 'g')"
_CONP = f""",
s AS (SELECT * FROM v WHERE id % 100 = 0),
ph AS (SELECT id, unnest(phrases) AS p FROM v),
h1 AS (SELECT s.id AS src, t.id AS tgt FROM ph s JOIN v t ON contains(t.body_lower, s.p) WHERE s.id % 100 = 0 AND s.id <> t.id AND regexp_matches(t.body_lower, '(^|[^a-z0-9])' || {_ESC} || '([^a-z0-9]|$)')),
h2 AS (SELECT s.id AS src, t.id AS tgt FROM ph t JOIN s ON contains(s.body_lower, t.p) WHERE s.id <> t.id AND regexp_matches(s.body_lower, '(^|[^a-z0-9])' || {_ESC} || '([^a-z0-9]|$)')),
cp AS (SELECT src, tgt, CAST(count(*) AS BIGINT) AS hits FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY ALL)
"""
_TOP = """,
al AS (SELECT src, tgt, max(k) AS k, max(shared) AS shared, max(hits) AS hits FROM (SELECT src, tgt, k, shared, 0 AS hits FROM tp UNION ALL SELECT src, tgt, 0, NULL, hits FROM cp) GROUP BY ALL),
ok AS (SELECT al.*, t.path, t.title AS tgt_title, t.title_key AS tk FROM al JOIN v s0 ON s0.id = al.src JOIN v t ON t.id = al.tgt
  WHERE coalesce(t.note_type, '') <> 'moc' AND NOT (coalesce(s0.session, '') <> '' AND coalesce(s0.session = t.session, false))
    AND NOT coalesce(list_contains(s0.link_keys, t.title_key) OR list_contains(s0.link_keys, lower(t.stem)) OR list_contains(s0.link_keys, t.slug), false)),
sc AS (SELECT *, CAST(greatest(CASE WHEN k > 0 THEN 2000 + k * 10 ELSE 0 END, CASE WHEN hits > 0 THEN 1000 + hits ELSE 0 END) AS DOUBLE) AS score,
  CASE WHEN k > 0 THEN 'matched via shared tags: ' || shared ELSE 'matched via concept overlap' END AS reason FROM ok),
rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, string_split(path, '/'), tgt) AS rank FROM sc),
top AS (SELECT * FROM rk WHERE rank <= 5),
fw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tk ORDER BY rank) AS n FROM top) WHERE n = 1)
"""
_NOTEDOC = """
WITH per AS (SELECT session_name, string_agg(text, E'\\n---ATOM_BREAK---\\n' ORDER BY doc_id) AS text FROM documents WHERE doc_kind = 'note' AND session_name IS NOT NULL AND text IS NOT NULL GROUP BY session_name),
bl AS (SELECT session_name, unnest(range(len(bs))) AS block_no, unnest(bs) AS block FROM (SELECT session_name, string_split(text, E'\\n---ATOM_BREAK---\\n') AS bs FROM per))
"""
_FILES = "WITH f AS (SELECT DISTINCT file_id, input_file, content, batch_no, arrived_at, sha256(content) AS content_sha FROM input_files), e AS (SELECT unnest(processed) AS e FROM manifest), k AS (SELECT regexp_replace(lower(trim(e.sha256)), '^sha256:', '') AS content_sha, e.file_id AS file_id FROM e WHERE e IS NOT NULL)"


def _lookup_sql() -> str:
    exact = " ".join(f"WHEN x = '{k}' THEN '{c}'" for k, c in TAXONOMY)
    near = " ".join(f"WHEN contains(x, '{k}') OR contains('{k}', x) THEN '{c}'" for k, c in sorted(TAXONOMY, key=lambda kc: -len(kc[0])))
    return f"SELECT doc_id, CASE WHEN x IS NULL OR x = '' THEN 'UNK' {exact} {near} ELSE 'UNK' END AS code FROM (SELECT doc_id, lower({_strip('source')}) AS x FROM documents)"


def oracle_sql() -> dict[str, str]:
    link = r"regexp_extract_all({x}, '\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]', 1)"
    body = link.replace("{x}", "coalesce(body_lower, '')")
    keys = f"list_filter(list_concat(list_transform({body}, lambda x: trim(x)), list_transform(coalesce(link_targets, []), lambda x: coalesce({link.replace('{x}', 'x')}[1], trim(x)))), lambda x: x IS NOT NULL AND x <> '')"
    return {
        "link_stats": _VAULT + _TAGP + _CONP + _TOP + "SELECT count(*) AS forward, count(DISTINCT src) AS forward_notes, CAST((SELECT count(*) FROM (SELECT DISTINCT fw.tgt, s.title FROM fw JOIN v s ON s.id = fw.src)) AS BIGINT) AS backlinks, count(DISTINCT tgt) AS backlink_notes FROM fw",
        "link_preview": _VAULT + _TAGP + _CONP + _TOP + """SELECT fw.src, 'NEW: "' || any_value(s.title) || '"' || E'\\n' || string_agg('  → would link to: [[' || tgt_title || ']] (' || reason || ')', E'\\n' ORDER BY rank) || E'\\n  ← would backlink into: ' || string_agg('[[' || tgt_title || ']]', ', ' ORDER BY rank) AS lines FROM fw JOIN v s ON s.id = fw.src GROUP BY fw.src""",
        "first_source": f"SELECT session_name, arg_min({_strip('source')}, doc_id) AS source FROM documents WHERE session_name IS NOT NULL AND coalesce({_strip('source')}, '') <> '' GROUP BY 1",
        "last_document": "SELECT session_name, lang, doc_kind FROM (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY doc_id DESC) AS k FROM documents WHERE session_name IS NOT NULL) WHERE k = 1",
        "session_lists": "SELECT doc_kind, string_agg(lang, '|' ORDER BY f) AS langs FROM (SELECT doc_kind, lang, min(doc_id) AS f FROM documents WHERE doc_kind IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) GROUP BY 1",
        "wikilinks": f"SELECT DISTINCT note_id, array_to_string(list_transform({body}, lambda x: trim(x)), '|') AS links FROM vault_notes",
        "link_targets": f"SELECT DISTINCT note_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform({keys}, lambda x: lower(x)), list_transform({keys}, lambda x: {_slug('x')})))), '|'), '') AS targets FROM vault_notes",
        "kebab_slugs": f"SELECT DISTINCT note_id, {_slug('title')} AS slug FROM vault_notes",
        "archive_topics": r"""
WITH a AS (SELECT note_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(regexp_replace(title, '(?i)^\s*moc\s*[-–—:]\s*', '')), '[^\x00-\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM vault_notes)
SELECT DISTINCT note_id, coalesce(nullif(regexp_replace(s[1:50], '-+$', ''), ''), 'Untitled') AS topic FROM a""",
        "concept_phrases": f"SELECT DISTINCT note_id, array_to_string(list_sort({_phrases('title')}), '|') AS phrases FROM vault_notes",
        "tag_sets": f"SELECT DISTINCT note_id, coalesce(array_to_string(list_sort({_tags('tags')}), '|'), '') AS tags FROM vault_notes",
        "index_notes_split": _VAULT + "SELECT coalesce(note_type = 'moc', false) OR starts_with(lower(title), 'moc') AS is_index, count(*) AS n FROM v GROUP BY 1",
        "tag_pairs": _VAULT + _TAGP + "SELECT src, tgt, csv AS shared_tags FROM tp",
        "concept_pairs": _VAULT + _CONP + "SELECT src, tgt, hits FROM cp",
        "link_topk": _VAULT + _TAGP + _CONP + _TOP + "SELECT src, tgt, score, reason, CAST(rank AS INTEGER) AS rank FROM top",
        "back_links": _VAULT + _TAGP + _CONP + _TOP + ", b AS (SELECT fw.tgt, s.title, arg_max(fw.reason, fw.src) AS reason FROM fw JOIN v s ON s.id = fw.src GROUP BY ALL) SELECT tgt, string_agg(title || ' | ' || reason, E'\\n' ORDER BY title) AS links FROM b GROUP BY tgt",
        "dangling_links": _VAULT + f""", l AS (SELECT DISTINCT id, coalesce(session, '') AS b, trim(unnest({link.replace('{x}', 'body_lower')})) AS target FROM v),
kn AS (SELECT coalesce(session, '') AS b, lower(title) AS key FROM v UNION SELECT coalesce(session, ''), slug FROM v)
SELECT id, target FROM l WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.b = l.b AND kn.key = lower(l.target)) AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.b = l.b AND kn.key = {_slug('target')})""",
        "index_notes": f"""
WITH n AS (SELECT note_id, source_session AS session, max(struct_pack(a := title, b := note_type)) AS r FROM vault_notes WHERE source_session IS NOT NULL AND title IS NOT NULL GROUP BY ALL),
m AS (SELECT note_id, session, r.a AS title, CASE WHEN lower({_strip('r.b')}) IN ('decision', 'insight', 'open-question', 'artifact', 'prompt', 'moc') THEN lower({_strip('r.b')}) ELSE 'atomic-note' END AS type,
  CASE note_id % 3 WHEN 0 THEN 'lab-ops' WHEN 1 THEN 'software' ELSE 'general' END AS dom FROM n),
p AS (SELECT session, dom, '## ' || CASE dom WHEN 'lab-ops' THEN 'Lab Ops' WHEN 'software' THEN 'Software' ELSE 'General' END || E'\\n' || string_agg('- [[' || title || ']] (' || type || ')', E'\\n' ORDER BY note_id) AS part FROM m GROUP BY session, dom)
SELECT session, 'MOC - ' || session AS title, '# MOC - ' || session || E'\\n\\n' || string_agg(part, E'\\n\\n' ORDER BY dom) AS body FROM p GROUP BY session""",
        "versioned_names": _VAULT + ", n AS (SELECT id, split_part(path, '/', 1) AS folder, slug, row_number() OVER (PARTITION BY split_part(path, '/', 1), slug ORDER BY id) AS k FROM v) SELECT id, folder, slug || CASE WHEN k > 1 THEN '-v' || k ELSE '' END || '.md' AS file_name FROM n",
        "note_blocks": _NOTEDOC + f"SELECT session_name, CAST(block_no AS INTEGER) AS block_no, md5({_strip('block')}) AS block FROM bl WHERE {_strip('block')} <> ''",
        "normalised_notes": f"""
SELECT DISTINCT note_id, CASE WHEN lower({_strip('note_type')}) IN ('decision', 'insight', 'open-question', 'artifact', 'prompt', 'moc') THEN lower({_strip('note_type')}) ELSE 'atomic-note' END AS type, 'medium' AS confidence,
  CASE WHEN lower({_strip('source_session')}) IN ('structural-engineering', 'software', 'strategy', 'brand', 'lab-ops') THEN lower({_strip('source_session')}) ELSE 'general' END AS source_domain, 'active' AS status,
  coalesce(array_to_string(list_filter(list_transform(coalesce(tags, []), lambda x: {_strip('x')}), lambda x: x IS NOT NULL AND x <> ''), '|'), '') AS tags FROM vault_notes""",
        "manifest_pending": _FILES + " SELECT DISTINCT file_id, content_sha FROM f WHERE content_sha IS NULL OR content_sha NOT IN (SELECT content_sha FROM k WHERE content_sha IS NOT NULL)",
        "manifest_skipped": _FILES + " SELECT DISTINCT file_id, content_sha FROM f WHERE content_sha IN (SELECT content_sha FROM k WHERE content_sha IS NOT NULL)",
        "manifest_upsert": _FILES + ", o AS (SELECT content_sha, max(file_id) AS file_id FROM k WHERE content_sha IS NOT NULL GROUP BY 1), n AS (SELECT content_sha, -max(file_id) AS file_id FROM f WHERE batch_no > 0 GROUP BY 1) SELECT * FROM o WHERE content_sha NOT IN (SELECT content_sha FROM n) UNION ALL SELECT * FROM n",
        "manifest_status": "WITH e AS (SELECT unnest(processed) AS e FROM manifest) SELECT count(*) AS entries, CAST(coalesce(sum(e.notes_generated), 0) AS BIGINT) AS notes, max(e.processed_date) AS last_processed FROM e WHERE e IS NOT NULL",
        "usage_by_session": "WITH e AS (SELECT unnest(processed) AS e FROM manifest) SELECT e.session_name AS session_name, count(*) AS calls, CAST(coalesce(sum(e.token_usage.input), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(e.token_usage.output), 0) AS BIGINT) AS output_tokens FROM e WHERE e IS NOT NULL GROUP BY 1",
        "archive_names": r"""
WITH f AS (SELECT file_id, min(struct_pack(a := arrived_at, b := input_file, c := session_name)) AS r FROM input_files GROUP BY 1),
g AS (SELECT file_id, strftime(r.a, '%Y-%m-%d') AS day, r.b AS input_file, r.c AS s, row_number() OVER (PARTITION BY strftime(r.a, '%Y-%m-%d') ORDER BY file_id) AS seq FROM f WHERE r.a IS NOT NULL)
SELECT file_id, day || '_' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR) END || '_' || CASE WHEN contains(lower(s), 'inbox') THEN 'INB' WHEN contains(lower(s), 'sess') THEN 'SES' ELSE 'UNK' END || '-UNK-DOC_' ||
  coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(s, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:50], '-+$', ''), ''), 'Untitled') || lower(regexp_extract(input_file, '(\.[^./]+)$', 1)) AS name FROM g""",
        "taxonomy_lookup": _lookup_sql(),
        "majority_source": "WITH r AS (SELECT session_name, lower(trim(source)) AS source, count(*) AS n, min(doc_id) AS f FROM documents WHERE session_name IS NOT NULL AND source IS NOT NULL GROUP BY ALL) SELECT session_name, source FROM (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY n DESC, f) AS k FROM r) WHERE k = 1",
        "summary_by_type": _VAULT + "SELECT coalesce(note_type, '') AS note_type, split_part(path, '/', 1) AS folder, count(*) AS n FROM v GROUP BY ALL",
        # members without a value are left out
        "json_dump": "SELECT '{' || array_to_string(list_filter(['\"conv_id\":' || conv_id, '\"turn\":' || turn, '\"role\":' || to_json(role), '\"content\":' || to_json(content)], lambda x: x IS NOT NULL), ',') || '}' AS json FROM (SELECT DISTINCT conv_id, turn, role, content FROM turns)",
    }
