"""Queries over turns, documents and exports, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import speakers
from quillspan.functions import text as T
from quillspan.functions.unicode import nfc
from quillspan.operators import chunks, layout, passes
from quillspan.plans.blocks import latest, rank_in_groups
from quillspan.session import cut, read
from quillspan.sources import chats, files
from quillspan.streaming import ingest as streaming

#: Settings of the window plan: small, so that many conversations need several windows.
WINDOW = {"context": 5000, "share": 0.8, "shared": 2, "reserved": 2500, "least": 600}


def turns(spark, d) -> DataFrame:
    """(conv_id, turn, role, content): the latest row of each turn, role normalised, text trimmed, empty ones out."""
    t = latest(read(spark, d, "turns").where("conv_id IS NOT NULL AND turn IS NOT NULL"), ["conv_id", "turn"], F.col("ingested_at"), ["role", "content", "created_at"])
    t = t.select("conv_id", "turn", T.role_of("role").alias("role"), T.strip("content").alias("content"), "created_at")
    return t.where("role IS NOT NULL AND content <> ''")


def _turns(spark, d):
    return turns(spark, d).select("conv_id", "turn", "role", "content")


def _tokens(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.count_tokens("content").alias("tokens"))


def _conv_tokens(spark, d):
    per = turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum(T.count_tokens("content")).alias("tokens"))
    return per.withColumn("skipped", F.col("tokens") < passes.MIN_TOKENS)


def _plan(spark, d):
    ranked = rank_in_groups(turns(spark, d), ["conv_id"], "turn", "pos", first=0)
    return chunks.plan(ranked.select("conv_id", F.col("pos").alias("turn"), "content"), **WINDOW)


def _fenced(spark, d):
    return layout.fenced_lines(read(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").where("fenced").select("doc_id", "pos", "line")


def _contents_blocks(spark, d):
    return layout.contents_blocks(_with_contents(read(spark, d, "documents")), "doc_id", "text")


def _with_contents(docs: DataFrame) -> DataFrame:
    """Documents with a contents list in front of every third one: four or five lines, by the id."""
    toc = F.array_join(F.transform(F.sequence(F.lit(1), 4 + F.pmod("doc_id", F.lit(2)).cast("int")), lambda i: F.concat(F.lit("Part "), i.cast("string"), F.lit(" ..... "), (i * 7).cast("string"))), "\n")
    return docs.select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(toc, F.lit("\n"), "text")).otherwise(F.col("text")).alias("text"))


def _low_signal(spark, d):
    rows = layout.lines(read(spark, d, "turns").select("content", "conv_id", "turn").distinct().withColumn("key", F.struct("conv_id", "turn")), "key", "content")
    return rows.where(T.low_signal_line("line")).groupBy("line").agg(F.count("*").alias("n"))


def _inline(spark, d):
    return read(spark, d, "documents").select("doc_id", F.length(T.without_inline_noise("text")).alias("n_left"))


def _normal(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(F.encode(T.normalize("text"), "UTF-8")).alias("norm"))


def _prose(spark, d):
    p = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "par"))
    return p.where(T.prose_like("par")).groupBy("doc_id").agg(F.count("*").alias("n_prose"))


def _repeats_exact(spark, d):
    """Paragraphs that stand at least three times in the documents of one session, with their first place."""
    p = read(spark, d, "documents").where("session_name IS NOT NULL").select("session_name", "doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "par"))
    p = p.withColumn("norm", T.normalize("par")).where((F.length("norm") >= passes.MIN_PARAGRAPH) & T.prose_like("par"))
    g = p.groupBy("session_name", "norm").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("f"))
    return g.where(F.col("n") >= passes.CLUSTER).select("session_name", F.md5(F.encode("norm", "UTF-8")).alias("norm"), "n", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"))


def _repeated_exact(spark, d):
    t = rank_in_groups(turns(spark, d), ["conv_id"], "turn", "pos").select("conv_id", "turn", "pos", T.normalize("content").alias("norm"))
    after = t.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("norm").alias("next"))
    return t.join(after, ["conv_id", "pos"]).where("norm = next").select("conv_id", "turn")


def _pass(step, reads_once=False):
    return lambda spark, d: step(_turns(spark, d) if reads_once else cut(_turns(spark, d))).select("conv_id", "turn", F.length("content").alias("n_chars"))


def _optimized(spark, d):
    return passes.optimize(_turns(spark, d))[0].select("conv_id", "turn", "role", F.length("content").alias("n_chars"))


def _report(spark, d):
    return passes.optimize(_turns(spark, d))[1]


def _batch(spark, d):
    return passes.batch_totals(_report(spark, d))


def _documents_as_files(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


def _text_turns(form):
    return lambda spark, d: files.text_turns(_documents_as_files(spark, d), form).select("file_id", "turn", "role", "content")


def _markup(spark, d):
    return read(spark, d, "documents").select("doc_id", speakers.clean_markup("text").alias("content"))


def _formats(spark, d):
    f = read(spark, d, "input_files").select("file_id", "input_file", "content").distinct()
    return f.select("file_id", files.detect_format("input_file", "content").alias("format"))


def _parsed(spark, d):
    f = read(spark, d, "input_files").select("file_id", F.col("input_file").alias("name"), "content").distinct()
    return files.parse_files(f).select("file_id", "conv_no", "turn", "role", "content")


def _exports(spark, d):
    return read(spark, d, "raw_exports").where("payload IS NOT NULL").select(F.col("export_id").alias("file_id"), F.col("payload").alias("content")).distinct()


def _pages(spark, d) -> DataFrame:
    """The pages of pdf documents: their parts between blank lines, and as many images as a page number says."""
    p = read(spark, d, "documents").where("doc_kind = 'pdf'").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n\n")).alias("page_no", "text"))
    return p.withColumn("n_images", F.pmod("page_no", F.lit(2)).cast("int"))


def _edges(spark, d):
    p = _pages(spark, d).select("file", "page_no", F.split("text", "\n").alias("lines"))
    return layout.strip_page_edges(p).select("file", "page_no", F.array_join("lines", "\n").alias("text"))


def _page_stats(spark, d):
    return layout.page_stats(_pages(spark, d))


def _transcripts(spark, d):
    t = turns(spark, d).withColumn("timestamp", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    per = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "timestamp"))).alias("ts"))
    return per.select("conv_id", T.transcript("ts").alias("transcript"))


def _templates(spark, d):
    t = F.lit("Session {session_name} from {source_file} as {source_format}, {created}.")
    f = read(spark, d, "input_files").select("file_id", "input_file", "session_name", "arrived_at").distinct()
    vals = {"session_name": F.col("session_name"), "source_file": F.col("input_file"), "source_format": F.lit("auto"), "created": F.date_format("arrived_at", "yyyy-MM-dd")}
    return f.select("file_id", "arrived_at", T.fill_template(t, vals).alias("prompt")).drop("arrived_at").distinct()


def _times(spark, d):
    m = read(spark, d, "messages").select("chat_id", "node_id", F.col("create_time").cast("double").alias("s")).distinct()
    return m.select("chat_id", "node_id", T.iso_utc("s").alias("at")).where("at IS NOT NULL").distinct()


def _tables(spark, d):
    n = read(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("r"))
    rows = F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("a|b"))), F.transform("r", lambda x: F.array(x["c_custkey"].cast("string"), x["c_name"], x["c_mktsegment"])))
    return n.select("c_nationkey", T.markdown_table(rows).alias("table"))


def _stream(spark, d):
    """Distinct contents of the input files, taken in by a stream that runs to its end."""
    from quillspan.session import scratch_table

    path = f"{d}/input_files.parquet"
    schema = spark.read.parquet(path).schema
    target, mark = scratch_table(spark, "stream-manifest"), scratch_table(spark, "stream-checkpoint")
    streaming.ingest(streaming.stream(spark, path, schema), target, mark).awaitTermination()
    return spark.read.option("basePath", target).parquet(target).select("content_sha")


def queries() -> dict:
    return {
        "turns_normalized": _turns,
        "role_counts": lambda s, d: turns(s, d).groupBy("role").agg(F.count("*").alias("n")),
        "turn_tokens": _tokens,
        "conv_tokens": _conv_tokens,
        "chunk_costs": lambda s, d: turns(s, d).select("conv_id", "turn", T.turn_cost("content").alias("cost")),
        "chunk_plan": _plan,
        "chunk_members": lambda s, d: chunks.members(_plan(s, d)),
        "fenced_lines": _fenced,
        "contents_blocks": _contents_blocks,
        "low_signal_lines": _low_signal,
        "inline_noise": _inline,
        "normalized_text": _normal,
        "prose_paragraphs": _prose,
        "boilerplate_exact": _repeats_exact,
        "repeated_turns_exact": _repeated_exact,
        "nfc_titles": lambda s, d: read(s, d, "vault_notes").select("note_id", nfc("title").alias("title")).distinct(),
        "pass_boilerplate": _pass(passes.boilerplate),
        "pass_whitespace": _pass(passes.whitespace, True),
        "pass_low_signal": _pass(passes.low_signal),
        "pass_contents": _pass(passes.contents, True),
        "pass_quoted": _pass(passes.quoted),
        "pass_repeated_turns": _pass(passes.repeated_turns),
        "optimize_turns": _optimized,
        "optimize_report": _report,
        "optimize_batch": _batch,
        "speaker_turns": _text_turns("markdown"),
        "copilot_turns": _text_turns("copilot"),
        "plain_turns": _text_turns("plaintext"),
        "clean_markup": _markup,
        "detect_format": _formats,
        "parse_files": _parsed,
        "claude_turns": lambda s, d: chats.claude_turns(_exports(s, d)),
        "chatgpt_turns": lambda s, d: chats.chatgpt_turns(_exports(s, d)),
        "page_edges": _edges,
        "page_stats": _page_stats,
        "transcripts": _transcripts,
        "filled_templates": _templates,
        "iso_times": _times,
        "markdown_tables": _tables,
        "stream_ingest": _stream,
    }


# Trimming and blanks in RE2 are spelt out, as its \s knows ASCII only.
_B = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_T = f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(ingested_at, TIMESTAMPTZ '0001-01-01') DESC, role DESC) AS rn FROM turns WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
keyed AS (SELECT conv_id, turn, created_at, regexp_replace(lower(trim(role)), '\\.+$', '') AS k, regexp_replace(content, '^{_B}+|{_B}+$', '', 'g') AS content FROM ranked WHERE rn = 1),
t AS (SELECT conv_id, turn, created_at, content,
    CASE WHEN k IN ('human', 'user', 'ed', 'you', 'me', 'q', 'question') THEN 'human'
         WHEN k IN ('assistant', 'ai', 'claude', 'chatgpt', 'gpt', 'bot', 'model', 'a', 'answer', 'copilot', 'bing', 'gemini') THEN 'assistant' END AS role
  FROM keyed WHERE content <> '' AND role IS NOT NULL)
"""
_TOK = "greatest(1, length(content) // 4)"


def _norm(x: str) -> str:
    """SQL: trimmed, lower case, blanks made single."""
    return f"regexp_replace(lower(regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')), '{_B}+', ' ', 'g')"


_PLAN = _T.rstrip() + f""",
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, CAST(floor({_TOK} * CAST(1.15 AS DOUBLE)) AS BIGINT) + 8 AS cost FROM t),
pre AS (SELECT conv_id, pos, cost, sum(cost) OVER w AS post, sum(cost) OVER w - cost AS pre, count(*) OVER (PARTITION BY conv_id) AS n, sum(cost) OVER (PARTITION BY conv_id) AS total FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
nx AS (SELECT a.conv_id, a.pos, a.n, a.total, greatest(a.pos + 1, coalesce(max(b.pos + 1) FILTER (b.post <= a.pre + 1500), 0)) AS en
  FROM pre a JOIN pre b ON a.conv_id = b.conv_id AND b.pos >= a.pos GROUP BY a.conv_id, a.pos, a.n, a.total),
w AS (
  SELECT conv_id, 0 AS chunk_no, pos AS st, CASE WHEN total <= 4000 THEN n ELSE en END AS en, n FROM nx WHERE pos = 0
  UNION ALL
  SELECT w.conv_id, w.chunk_no + 1, x.pos, x.en, w.n FROM w JOIN nx x ON x.conv_id = w.conv_id AND x.pos = greatest(w.en - 2, w.st + 1) WHERE w.en < w.n)
"""
_PLAN = _PLAN.replace("WITH ranked", "WITH RECURSIVE ranked", 1)
_PAGES = r"""
WITH docs AS (SELECT doc_id AS file, string_split(text, E'\n\n') AS ps FROM documents WHERE doc_kind = 'pdf'),
pages AS (SELECT file, unnest(range(len(ps))) AS page_no, unnest(ps) AS text FROM docs)
"""
_LINES = "SELECT {key}, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT {key}, string_split({text}, E'\\n') AS ls FROM {table})"


def oracle_sql() -> dict[str, str]:
    fence = r"regexp_matches(line, '^\s*(```|~~~)')"
    toc = "list_aggregate(list_transform(range(1, 5 + CAST(doc_id % 2 AS INTEGER)), lambda i: 'Part ' || i || ' ..... ' || (i * 7)), 'string_agg', E'\\n')"
    edge = """
, l{i} AS (SELECT file, page_no, lines, list_filter(lines, lambda x: trim(x) <> '')[{which}] AS cand FROM {src}),
k{i} AS (SELECT *, trim(regexp_replace(regexp_replace(lower(cand), '\\s+', ' ', 'g'), '\\d+', '#', 'g')) AS key FROM l{i}),
c{i} AS (SELECT file, key FROM k{i} WHERE cand IS NOT NULL GROUP BY file, key HAVING count(*) > 0.5 * (SELECT count(*) FROM l1 x WHERE x.file = k{i}.file AND x.cand IS NOT NULL) AND (SELECT count(*) FROM l1 x WHERE x.file = k{i}.file AND x.cand IS NOT NULL) >= 3),
r{i} AS (SELECT k.file, k.page_no, CASE WHEN c.key IS NULL THEN k.lines ELSE list_concat(k.lines[1:list_position(k.lines, k.cand) - 1], k.lines[list_position(k.lines, k.cand) + 1:]) END AS lines
  FROM k{i} k LEFT JOIN c{i} c ON c.file = k.file AND c.key = k.key)"""
    return {
        "turns_normalized": _T + "SELECT conv_id, turn, role, content FROM t",
        "role_counts": _T + "SELECT role, count(*) AS n FROM t GROUP BY role",
        "turn_tokens": _T + f"SELECT conv_id, turn, {_TOK} AS tokens FROM t",
        "conv_tokens": _T + f"SELECT conv_id, count(*) AS n_turns, CAST(sum({_TOK}) AS BIGINT) AS tokens, sum({_TOK}) < 500 AS skipped FROM t GROUP BY conv_id",
        "chunk_costs": _T + f"SELECT conv_id, turn, CAST(floor({_TOK} * CAST(1.15 AS DOUBLE)) AS BIGINT) + 8 AS cost FROM t",
        "chunk_plan": _PLAN + "SELECT w.conv_id, w.chunk_no, CAST(w.st AS INTEGER) AS start_turn, CAST(w.en AS INTEGER) AS end_turn, CAST(w.en - w.st AS INTEGER) AS n_turns, CAST(sum(p.cost) AS BIGINT) AS cost FROM w JOIN p ON p.conv_id = w.conv_id AND p.pos >= w.st AND p.pos < w.en GROUP BY ALL",
        "chunk_members": _PLAN + "SELECT w.conv_id, w.chunk_no, CAST(p.pos AS INTEGER) AS pos FROM w JOIN p ON p.conv_id = w.conv_id AND p.pos >= w.st AND p.pos < w.en",
        "fenced_lines": f"WITH l AS ({_LINES.format(key='doc_id', text='text', table='documents')}), m AS (SELECT *, {fence} AS mark, sum(CAST({fence} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l) SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM m WHERE mark OR k % 2 = 1",
        "contents_blocks": f"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {toc} || E'\\n' || text ELSE text END AS text FROM documents),
l AS ({_LINES.format(key='doc_id', text='text', table='d')}),
f AS (SELECT doc_id, pos, regexp_matches(trim(line), '^.+?(\\.{{3,}}|\\t+|\\s{{3,}})\\s*\\d{{1,4}}\\s*$') AS hit FROM l),
g AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM f WHERE hit)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS first_pos, count(*) AS n_lines FROM g GROUP BY doc_id, island HAVING count(*) >= 5""",
        "low_signal_lines": f"""
WITH s AS (SELECT DISTINCT conv_id, turn, content FROM turns), l AS ({_LINES.format(key='conv_id, turn', text='content', table='s')})
SELECT line, count(*) AS n FROM l WHERE regexp_matches(line, '(?i)^\\s*-+\\s*forwarded message\\s*-+\\s*$') OR regexp_matches(line, '(?i)^\\s*(confidential|proprietary|do not distribute)[\\s:!.\\-]*$')
  OR regexp_matches(line, '(?i)^\\s*(sent from my \\w+|get outlook for \\w+)\\s*$') GROUP BY line""",
        "inline_noise": r"SELECT doc_id, length(regexp_replace(regexp_replace(text, '(?i)\bpage\s+\d+\s+of\s+\d+\b', '', 'g'), '(?i)\[(image|logo|signature|cid:[^\]]*)\]', '', 'g')) AS n_left FROM documents",
        "normalized_text": f"SELECT doc_id, md5({_norm('text')}) AS norm FROM documents",
        "prose_paragraphs": r"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) AS par FROM documents)
SELECT doc_id, count(*) AS n_prose FROM p WHERE len(list_filter(string_split(par, E'\n'), lambda x: contains(x, '|'))) < 2 AND (length(par) = 0 OR length(regexp_replace(par, '[^\d]', '', 'g')) / length(par) <= 0.3) GROUP BY doc_id""",
        "boilerplate_exact": f"""
WITH p AS (SELECT session_name, doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS par FROM (SELECT session_name, doc_id, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM documents WHERE session_name IS NOT NULL)),
q AS (SELECT session_name, doc_id, pos, {_norm('par')} AS norm FROM p WHERE len(list_filter(string_split(par, E'\\n'), lambda x: contains(x, '|'))) < 2 AND (length(par) = 0 OR length(regexp_replace(par, '[^\\d]', '', 'g')) / length(par) <= 0.3)),
g AS (SELECT session_name, norm, count(*) AS n, min(struct_pack(doc_id := doc_id, pos := pos)) AS f FROM q WHERE length(norm) >= 30 GROUP BY ALL)
SELECT session_name, md5(norm) AS norm, n, f.doc_id AS first_doc, CAST(f.pos AS INTEGER) AS first_pos FROM g WHERE n >= 3""",
        "repeated_turns_exact": _T + f", n AS (SELECT conv_id, turn, {_norm('content')} AS norm FROM t), l AS (SELECT *, lead(norm) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM n) SELECT conv_id, turn FROM l WHERE norm = nxt",
        "nfc_titles": "SELECT DISTINCT note_id, nfc_normalize(title) AS title FROM vault_notes",
        "detect_format": r"""
WITH f AS (SELECT DISTINCT file_id, input_file, content, lower(regexp_extract(input_file, '(\.[^./]+)$', 1)) AS sfx FROM input_files)
SELECT file_id, CASE WHEN sfx = '.pdf' THEN 'pdf' WHEN sfx = '.docx' THEN 'docx' WHEN sfx = '.json' AND NOT json_valid(content) THEN 'plaintext'
  WHEN sfx = '.json' THEN 'claude-json' WHEN len(list_filter(string_split(content, E'\n')[1:200], lambda x: regexp_matches(x, '(?i)^\s*(#{1,6}\s+)?[*_]{0,2}(copilot(\s+said)?|bing|microsoft 365 copilot|microsoft copilot)'))) > 0 THEN 'copilot'
  WHEN sfx = '.md' THEN 'markdown' ELSE 'plaintext' END AS format FROM f""",
        "page_edges": _PAGES.rstrip() + ", src AS (SELECT file, page_no, string_split(text, E'\\n') AS lines FROM pages)" + edge.format(i=1, which="1", src="src") + edge.format(i=2, which="-1", src="r1")
        + " SELECT file, CAST(page_no AS INTEGER) AS page_no, coalesce(array_to_string(lines, E'\\n'), '') AS text FROM r2",
        "page_stats": _PAGES + f"""
SELECT file, count(*) AS total_pages, CAST(count(*) FILTER (length(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g')) < 50 AND page_no % 2 > 0) AS BIGINT) AS image_only_pages,
  CAST(round_even(100.0 * count(*) FILTER (length(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g')) < 50 AND page_no % 2 > 0) / count(*), 0) AS INTEGER) AS image_only_pct,
  count(*) FILTER (length(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g')) < 50 AND page_no % 2 > 0) / count(*) > 0.5 AS image_heavy FROM pages GROUP BY file""",
        "transcripts": _T + """, n AS (SELECT conv_id, turn, role, content, coalesce(' timestamp=' || strftime(make_timestamp(epoch_us(created_at)), '%Y-%m-%dT%H:%M:%SZ'), '') AS stamp, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t)
SELECT conv_id, '<conversation>' || E'\\n' || string_agg('<turn n="' || i || '" role="' || upper(role) || '"' || stamp || '>' || E'\\n' || content || E'\\n</turn>', E'\\n' ORDER BY i) || E'\\n</conversation>' AS transcript FROM n GROUP BY conv_id""",
        "filled_templates": "SELECT DISTINCT file_id, 'Session ' || coalesce(session_name, '') || ' from ' || coalesce(input_file, '') || ' as auto, ' || coalesce(strftime(arrived_at, '%Y-%m-%d'), '') || '.' AS prompt FROM input_files",
        "iso_times": "SELECT DISTINCT chat_id, node_id, strftime(date_trunc('second', create_time), '%Y-%m-%dT%H:%M:%SZ') AS at FROM messages WHERE create_time IS NOT NULL AND epoch(create_time) <> 0",
        "markdown_tables": "SELECT c_nationkey, '| key | name | a\\|b |' || E'\\n| --- | --- | --- |\\n' || string_agg('| ' || c_custkey || ' | ' || trim(regexp_replace(c_name, '\\s+', ' ', 'g')) || ' | ' || trim(regexp_replace(c_mktsegment, '\\s+', ' ', 'g')) || ' |', E'\\n' ORDER BY c_custkey) AS \"table\" FROM customer GROUP BY c_nationkey",
        "stream_ingest": "SELECT DISTINCT sha256(content) AS content_sha FROM input_files",
    }
