"""Queries of the training-data problems and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import history, language, leaks, mail, mixing, setjoin, splitting, threads
from quillspan.session import read

Query = Callable[[SparkSession, str], DataFrame]


def _p2_pieces(spark, d):
    return splitting.split_turns(splitting.latest_turns(read(spark, d, "turns"), splitting.MAX_CHARS)).drop("piece")


def _p2_chunks(spark, d):
    return splitting.plan_chunks(splitting.latest_turns(read(spark, d, "turns"), splitting.MAX_CHARS)).drop("turns")


def _leaks(spark, d, **how):
    return leaks.leaks(read(spark, d, "documents"), read(spark, d, "eval_items"), **how)


def _mixture(spark, d):
    return mixing.Mixture(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def queries() -> dict[str, Query]:
    return {
        "p2_found": lambda spark, d: splitting.oversized(read(spark, d, "turns")),
        "p2_pieces": _p2_pieces,
        "p2_chunks": _p2_chunks,
        "p3_found": lambda spark, d: setjoin.note_pairs(read(spark, d, "vault_notes")),
        "p3_links": lambda spark, d: setjoin.note_links(read(spark, d, "vault_notes")),
        "p4_found": lambda spark, d: history.repeated_files(read(spark, d, "input_files"), read(spark, d, "manifest")),
        "p5_found": lambda spark, d: threads.conversations(read(spark, d, "chat_sessions"), read(spark, d, "messages")).drop("role"),
        "p5_verdicts": lambda spark, d: threads.verdicts(read(spark, d, "chat_sessions"), read(spark, d, "messages")),
        "p6_found": lambda spark, d: mail.new_lines(read(spark, d, "turns")),
        "p6_texts": lambda spark, d: mail.new_texts(read(spark, d, "turns")),
        "p7_found": lambda spark, d: _leaks(spark, d, coverage=None).select("doc_id", "item_id"),
        "p7_report": _leaks,
        "p8_found": lambda spark, d: _mixture(spark, d).report().where("short").select("source"),
        "p8_report": lambda spark, d: _mixture(spark, d).report(),
        "p8_rates": lambda spark, d: _mixture(spark, d).rates(),
        "p9_found": lambda spark, d: language.unlabelled_or_mixed(read(spark, d, "documents")),
        "p9_segments": lambda spark, d: language.segments(read(spark, d, "documents")).distinct(),
    }


_P2 = """
WITH latest AS (
  SELECT conv_id, turn, coalesce(arg_max(length(content), struct_pack(a := coalesce(ingested_at, TIMESTAMPTZ '0001-01-01'), b := coalesce(length(content), 0))), 0) AS n
  FROM turns GROUP BY conv_id, turn)
SELECT conv_id, turn FROM latest WHERE n > 4000
UNION ALL
SELECT conv_id, -1 AS turn FROM latest GROUP BY conv_id HAVING sum(n) > 24000
"""

_P3 = r"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY coalesce(indexed_at, TIMESTAMPTZ '0001-01-01') DESC) AS rn FROM vault_notes),
vals AS (
  SELECT DISTINCT field_name, note_id, val FROM (
    SELECT field_name, note_id,
      trim(regexp_replace(ltrim(lower(regexp_replace(nfc_normalize(x), '^[\s]+|[\s]+$', '', 'g')), '#'), '[\s_-]+', ' ', 'g')) AS val
    FROM (SELECT 'tags' AS field_name, note_id, unnest(tags) AS x FROM ranked WHERE rn = 1
          UNION ALL SELECT 'phrases', note_id, unnest(phrases) FROM ranked WHERE rn = 1))
  WHERE val IS NOT NULL AND val <> ''),
sized AS (SELECT field_name, note_id, count(*) AS n FROM vals GROUP BY ALL HAVING count(*) >= 3),
kept AS (SELECT v.*, s.n FROM vals v JOIN sized s USING (field_name, note_id)),
pairs AS (
  SELECT a.field_name, a.note_id AS note_a, b.note_id AS note_b, a.n AS na, b.n AS nb, count(*) AS k
  FROM kept a JOIN kept b ON a.field_name = b.field_name AND a.val = b.val AND a.note_id < b.note_id
  GROUP BY ALL)
"""
_P3_PAIRS = _P3 + "SELECT field_name, note_a, note_b FROM pairs WHERE k * 10 >= 6 * (na + nb - k)"
_P3_LINKS = _P3 + """,
links AS (SELECT field_name, note_a, note_b FROM pairs WHERE k * 10 >= 6 * (na + nb - k)),
counted AS (SELECT field_name, note_id, count(*) AS n FROM (SELECT field_name, note_a AS note_id FROM links UNION ALL SELECT field_name, note_b FROM links) GROUP BY ALL),
sets AS (SELECT field_name, note_id, list(val ORDER BY val) AS vs FROM kept GROUP BY ALL)
SELECT s.field_name, s.note_id, min(s.note_id) OVER (PARTITION BY s.field_name, s.vs) AS class_id, coalesce(c.n, 0) AS n_links
FROM sets s LEFT JOIN counted c USING (field_name, note_id)
"""


_P5 = r"""
WITH RECURSIVE
r AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, node_id ORDER BY coalesce(ingested_at, TIMESTAMPTZ '0001-01-01') DESC) AS rn FROM messages)
  WHERE rn = 1),
s AS (
  SELECT chat_id, current_node FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY coalesce(updated_at, TIMESTAMPTZ '0001-01-01') DESC) AS rn FROM chat_sessions)
  WHERE rn = 1),
up AS (SELECT s.chat_id, s.current_node AS node FROM s JOIN r ON r.chat_id = s.chat_id AND r.node_id = s.current_node),
roots AS (
  SELECT chat_id, min(node_id) AS node FROM r WHERE coalesce(parent, '') = '' GROUP BY chat_id HAVING count(*) = 1),
starts AS (
  SELECT chat_id, node, true AS is_up FROM up
  UNION ALL
  SELECT chat_id, node, false FROM roots WHERE chat_id IN (SELECT chat_id FROM s) AND chat_id NOT IN (SELECT chat_id FROM up)),
links AS (
  SELECT r.chat_id, r.node_id, st.is_up,
    CASE WHEN st.is_up THEN nullif(r.parent, '') WHEN len(r.children) > 0 THEN coalesce(r.children[-1], '') END AS nxt
  FROM r JOIN starts st USING (chat_id)),
walk AS (
  SELECT chat_id, node, 0 AS pos, [node] AS seen, false AS bad FROM starts
  UNION ALL
  SELECT w.chat_id, l.nxt, w.pos + 1, list_append(w.seen, l.nxt),
    list_contains(w.seen, l.nxt) OR NOT EXISTS (SELECT 1 FROM r WHERE r.chat_id = w.chat_id AND r.node_id = l.nxt)
  FROM walk w JOIN links l ON l.chat_id = w.chat_id AND l.node_id = w.node
  WHERE NOT w.bad AND l.nxt IS NOT NULL),
whole AS (SELECT * FROM walk WHERE chat_id NOT IN (SELECT chat_id FROM walk WHERE bad)),
turns AS (
  SELECT w.chat_id, w.node, CASE WHEN lower(trim(r.role)) IN ('user', 'human') THEN 'h' ELSE 'a' END AS who,
    row_number() OVER (PARTITION BY w.chat_id ORDER BY CASE WHEN st.is_up THEN -w.pos ELSE w.pos END) AS turn_pos
  FROM whole w JOIN starts st ON st.chat_id = w.chat_id JOIN r ON r.chat_id = w.chat_id AND r.node_id = w.node
  WHERE lower(trim(r.role)) IN ('user', 'human', 'assistant', 'ai') AND coalesce(r.is_hidden, false) = false
    AND r.content_type IN ('text', 'multimodal_text', 'code') AND regexp_matches(r.content, '\S')),
judged AS (
  SELECT *, lead(who) OVER (PARTITION BY chat_id ORDER BY turn_pos) AS then_who FROM turns),
kept AS (
  SELECT chat_id FROM judged GROUP BY chat_id
  HAVING count(*) FILTER (who = 'h') > 0 AND count(*) FILTER (who = 'h' AND then_who IS DISTINCT FROM 'a') = 0)
"""
_P5_TURNS = _P5 + "SELECT chat_id, CAST(turn_pos AS INTEGER) AS turn_pos, node AS node_id FROM turns WHERE chat_id IN (SELECT chat_id FROM kept)"
_P5_VERDICTS = _P5 + """,
sizes AS (SELECT chat_id, count(*) AS n, count(*) FILTER (who = 'h') AS n_human, count(*) FILTER (who = 'h' AND then_who IS DISTINCT FROM 'a') AS n_open FROM judged GROUP BY chat_id)
SELECT s.chat_id, coalesce(z.n, 0) AS n_turns,
  CASE WHEN s.chat_id NOT IN (SELECT chat_id FROM whole) THEN 'broken' WHEN z.n IS NULL THEN 'empty' WHEN z.n_human = 0 THEN 'no human turn' WHEN z.n_open > 0 THEN 'missing reply' ELSE 'kept' END AS verdict
FROM s LEFT JOIN sizes z USING (chat_id) WHERE s.chat_id IS NOT NULL
"""


_P7 = r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
eg AS (SELECT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e WHERE len(w) >= 12)
SELECT DISTINCT dg.id AS doc_id, eg.id AS item_id FROM dg JOIN eg USING (g)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p3_found": _P3_PAIRS, "p3_links": _P3_LINKS, "p5_found": _P5_TURNS, "p5_verdicts": _P5_VERDICTS, "p7_found": _P7}
