"""Oracle SQL over nested exports and transcripts."""

_CUT = r"regexp_replace({x}, '^[\x{FEFF}\s]+', '')"


def _unwrap(x: str) -> str:
    """SQL: the text inside a JSON string, else the text."""
    return f"CASE WHEN json_valid({x}) AND json_type({x}) = 'VARCHAR' THEN {_CUT.replace('{x}', x + ' ->> ' + chr(39) + '$' + chr(39))} ELSE {x} END"


def _docs(wrapped: bool) -> str:
    base = f"SELECT DISTINCT export_id, {_CUT.replace('{x}', 'payload')} AS p FROM raw_exports WHERE payload IS NOT NULL"
    more = f" UNION ALL SELECT export_id, {_unwrap('p')} AS p FROM u WHERE json_valid(p) AND json_type(p) = 'VARCHAR'" if wrapped else ""
    return (
        f"WITH RECURSIVE u AS ({base}{more})" + """,
docs AS (SELECT export_id, CAST(p AS JSON) AS d FROM u WHERE json_valid(p)),
cs AS (SELECT export_id, unnest(range(len(a))) AS conv_no, unnest(a) AS c FROM (SELECT export_id, CASE WHEN json_type(d) = 'ARRAY' THEN from_json(d, '["JSON"]') ELSE [d] END AS a FROM docs)),
co AS (SELECT export_id, CAST(conv_no AS INTEGER) AS conv_no, c, c -> 'mapping' AS mp,
    CASE WHEN json_type(c -> 'chat_messages') = 'ARRAY' AND json_array_length(c -> 'chat_messages') > 0 THEN c -> 'chat_messages' WHEN json_type(c -> 'messages') = 'ARRAY' THEN c -> 'messages' END AS ls
  FROM cs WHERE json_type(c) = 'OBJECT'),
nk AS (SELECT export_id, conv_no, mp, unnest(json_keys(mp)) AS node_key FROM co WHERE json_type(mp) = 'OBJECT'),
nd AS (SELECT export_id, conv_no, node_key, json_extract(mp, '$."' || node_key || '"') AS n FROM nk),
li AS (SELECT export_id, conv_no, unnest(range(len(a))) AS i, unnest(a) AS msg FROM (SELECT export_id, conv_no, from_json(ls, '["JSON"]') AS a FROM co WHERE ls IS NOT NULL AND coalesce(json_type(mp), '') <> 'OBJECT')),
ms AS (
  SELECT export_id, conv_no, node_key, coalesce(n ->> 'parent', '') AS parent_key, n -> 'message' AS msg FROM nd WHERE json_type(n -> 'message') = 'OBJECT'
  UNION ALL SELECT export_id, conv_no, CAST(i AS VARCHAR), '', msg FROM li WHERE json_type(msg) = 'OBJECT'),
mc AS (SELECT *, msg -> 'content' AS ct,
    CASE WHEN json_type(msg -> 'content') = 'ARRAY' AND json_array_length(msg -> 'content') > 0 THEN msg -> 'content'
         WHEN json_type(msg -> 'content' -> 'parts') = 'ARRAY' AND json_array_length(msg -> 'content' -> 'parts') > 0 THEN msg -> 'content' -> 'parts' END AS items FROM ms),
fl AS (
  SELECT export_id, conv_no, node_key, parent_key, CAST(i AS VARCHAR) AS path, e FROM (SELECT export_id, conv_no, node_key, parent_key, unnest(range(len(a))) AS i, unnest(a) AS e FROM (SELECT *, from_json(items, '["JSON"]') AS a FROM mc WHERE items IS NOT NULL))
  UNION ALL
  SELECT export_id, conv_no, node_key, parent_key, path || '.' || i, e FROM (SELECT export_id, conv_no, node_key, parent_key, path, unnest(range(len(a))) AS i, unnest(a) AS e
    FROM (SELECT *, from_json(e -> 'content', '["JSON"]') AS a FROM fl WHERE json_type(e) = 'OBJECT' AND json_type(e -> 'content') = 'ARRAY' AND json_array_length(e -> 'content') > 0))),
pc AS (
  SELECT export_id, conv_no, node_key, parent_key, path AS piece_path FROM fl WHERE NOT (json_type(e) = 'OBJECT' AND coalesce(json_type(e -> 'content'), '') = 'ARRAY' AND coalesce(json_array_length(e -> 'content'), 0) > 0)
  UNION ALL
  SELECT export_id, conv_no, node_key, parent_key, CASE WHEN json_type(ct) = 'VARCHAR' OR json_type(ct -> 'text') = 'VARCHAR'
      OR (coalesce(json_type(ct), 'NULL') = 'NULL' OR (json_type(ct) = 'ARRAY' AND json_array_length(ct) = 0)) AND json_type(msg -> 'text') = 'VARCHAR' THEN '0' ELSE '' END FROM mc WHERE items IS NULL)
"""
    )


_WRAPPED = _docs(True)
_B = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_HTML = (
    r"(?i)</?(?:div|span|p|br|hr|b|i|em|strong|u|img|a|ul|ol|li|table|tr|td|th|thead|tbody|h[1-6]|blockquote|pre|details|summary|sup|sub|small|section|article|header|footer|nav|figure|figcaption)\b[^>]*/?>"
)
_UI = r"(?i)^\s*(?:copy code|copied!?|copy|retry|regenerate(?: response)?|share|edited|thumbs up|thumbs down|stop generating|ai-generated content may be incorrect\.?)\s*$"
_ROLE = """CASE WHEN {x} IN ('human', 'user', 'ed', 'you', 'me', 'q', 'question') THEN 'human'
  WHEN {x} IN ('assistant', 'ai', 'claude', 'chatgpt', 'gpt', 'bot', 'model', 'a', 'answer', 'copilot', 'bing', 'gemini') THEN 'assistant' END"""
_KEY = "regexp_replace(lower(trim(regexp_extract(line, '{p}', 1))), '\\.+$', '')"
_HEAD = r"^\s*#{1,6}\s+([A-Za-z][A-Za-z .]{0,30}?)\s*:?\s*$"
_LINE = r"^\s*[*_]{0,2}([A-Za-z][A-Za-z .]{0,30}?)[*_]{0,2}\s*[:：]\s*(.*)$"

_SPLIT = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_FENCE = r"regexp_matches(line, '^\s*(```|~~~)')"
_NOISE = (
    r"(?i)^\s*(?:learn more:?|sources?:?|references?:?|ai-generated content may be incorrect\.?|copilot uses ai\. check for mistakes\.?|\d+\s+of\s+\d+\s+responses?)\s*$|^\s*\[\d+\][:.]?\s+\S+.*$"
)
_COPILOT = r"(?i)^\s*(?:#{1,6}\s+)?[*_]{0,2}(You said|You|Me|User said|User|Copilot said|Copilot|Bing said|Bing|Microsoft 365 Copilot|M365 Copilot|Microsoft Copilot)[*_]{0,2}\s*[:：]?\s*(.*)$"


def _lines(where: str) -> str:
    """Lines (doc_id, pos, line) by any line end, with the running count of fence lines."""
    return rf"""
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\n$', ''), {_SPLIT}) AS ls FROM documents WHERE text <> '' AND {where})),
m AS (SELECT *, {_FENCE} AS mark FROM l),
f AS (SELECT *, sum(CAST(mark AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM m)"""


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g')"


def _marked(name: str, source: str, by: str) -> str:
    """Content per ``by`` of body lines: window lines out, HTML off outside fences, blank lines collapsed, trimmed."""
    return f"""
{name}m AS (SELECT *, {_FENCE} AS mk FROM {source}),
{name}f AS (SELECT *, mk OR sum(CAST(mk AS INTEGER)) OVER (PARTITION BY {by} ORDER BY pos) % 2 = 1 AS fenced FROM {name}m),
{name}c AS (SELECT {by}, string_agg(CASE WHEN fenced THEN line ELSE regexp_replace(line, '{_HTML}', '', 'g') END, E'\\n' ORDER BY pos) AS content FROM {name}f WHERE fenced OR NOT regexp_matches(line, '{_UI}') GROUP BY {by}),
{name} AS (SELECT {by}, {_trim("regexp_replace(content, '\\n{3,}', E'\\n\\n', 'g')")} AS content FROM {name}c)"""


def _turns(where: str, copilot: bool = False) -> str:
    """CTEs up to ``tu`` (doc_id, turn, role, content): speaker turns, numbered from 0."""
    if copilot:
        label = f"lower(regexp_extract(line, '{_COPILOT}', 1))"
        role = f"CASE WHEN {label} = '' THEN NULL WHEN {label} IN ('you said', 'you', 'me', 'user said', 'user') THEN 'human' ELSE 'assistant' END"
        rest = _trim(f"regexp_extract(line, '{_COPILOT}', 2)")
        clean = r"""
bn AS (SELECT *, mk OR sum(CAST(mk AS INTEGER)) OVER (PARTITION BY doc_id, turn ORDER BY pos) % 2 = 1 AS fn FROM (SELECT *, """ + _FENCE + r""" AS mk FROM b)),
bb AS (SELECT doc_id, turn, pos, CASE WHEN fn THEN line ELSE regexp_replace(regexp_replace(line, '\s*[\[⁽]\d+[\]⁾]', '', 'g'), '[¹²³⁰⁴-⁹]+', '', 'g') END AS line FROM bn WHERE fn OR NOT regexp_matches(line, '""" + _NOISE + "')),"
    else:
        head, line = _ROLE.replace("{x}", _KEY.replace("{p}", _HEAD)), _ROLE.replace("{x}", _KEY.replace("{p}", _LINE))
        role, rest = f"coalesce({head}, {line})", f"CASE WHEN {head} IS NOT NULL THEN '' ELSE regexp_extract(line, '{_LINE}', 2) END"
        clean = "bb AS (SELECT * FROM b),"
    return (
        _lines(where)
        + f""",
r AS (SELECT *, CASE WHEN mark OR k % 2 = 1 THEN NULL ELSE {role} END AS role, {rest} AS rest FROM f),
t AS (SELECT *, sum(CASE WHEN role IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS turn FROM r),
b AS (SELECT doc_id, turn, pos, CASE WHEN role IS NULL THEN line ELSE rest END AS line FROM t WHERE role IS NULL OR rest <> ''),
{clean}"""
        + _marked("d", "bb", "doc_id, turn")
        + """,
w AS (SELECT doc_id, turn, any_value(role) AS role FROM t WHERE role IS NOT NULL GROUP BY doc_id, turn),
tu AS (SELECT d.doc_id, CAST(row_number() OVER (PARTITION BY d.doc_id ORDER BY d.turn) - 1 AS INTEGER) AS turn, coalesce(w.role, 'human') AS role, d.content FROM d LEFT JOIN w ON w.doc_id = d.doc_id AND w.turn = d.turn WHERE d.content <> '')"""
    )


_SPEAKERS = "WITH" + _turns("TRUE") + " SELECT doc_id AS file_id, turn, role, content FROM tu"
_COPILOT_TURNS = "WITH" + _turns("TRUE", True) + " SELECT doc_id AS file_id, turn, role, content FROM tu"
_MARKUP = "WITH" + _lines("true") + "," + _marked("x", "(SELECT doc_id, pos, line FROM l)", "doc_id") + " SELECT d.doc_id, coalesce(x.content, '') AS content FROM documents d LEFT JOIN x ON x.doc_id = d.doc_id"
_PLAIN = (
    "WITH" + _turns("true") + "," + _marked("x", "(SELECT doc_id, pos, line FROM l)", "doc_id")
    + """, n AS (SELECT doc_id, count(*) AS n FROM tu GROUP BY doc_id)
SELECT tu.doc_id AS file_id, tu.turn, tu.role, tu.content FROM tu JOIN n ON n.doc_id = tu.doc_id WHERE n.n >= 2
UNION ALL SELECT x.doc_id, 0, 'human', x.content FROM x LEFT JOIN n ON n.doc_id = x.doc_id WHERE coalesce(n.n, 0) < 2 AND x.content <> ''"""
)


def _passes(turns: str) -> dict[str, str]:
    """Line passes over turns: metadata and code lines stay, text goes by runs of lines between them."""
    lines = turns.rstrip() + rf""",
pl AS (SELECT conv_id, turn, unnest(range(len(ls))) AS pos, unnest(ls) AS line, {_trim('ls[1]')} = '---' AS y FROM (SELECT conv_id, turn, string_split(content, E'\n') AS ls FROM t)),
py AS (SELECT *, CASE WHEN y THEN min(CASE WHEN pos > 0 AND {_trim('line')} = '---' THEN pos END) OVER (PARTITION BY conv_id, turn) END AS ye FROM pl),
pm AS (SELECT *, coalesce(pos <= ye, false) AS meta, {_FENCE} AND NOT coalesce(pos <= ye, false) AS mark FROM py),
pf AS (SELECT *, mark OR sum(CAST(mark AS INTEGER)) OVER (PARTITION BY conv_id, turn ORDER BY pos) % 2 = 1 OR meta AS opaque FROM pm)"""
    toc = r"'^.+?(\.{3,}|\t+|\s{3,})\s*\d{1,4}\s*$'"
    listed = f"(NOT opaque AND {_trim('line')} <> '' AND regexp_matches({_trim('line')}, {toc}))"
    contents = lines + f""",
ph AS (SELECT *, {listed} AS hit FROM pf), pi AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, hit ORDER BY pos) AS isl FROM ph),
pn AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn, hit, isl) AS n FROM pi),
pj AS (SELECT conv_id, turn, {_trim("string_agg(line, E'\\n' ORDER BY pos)")} AS x FROM pn WHERE NOT (hit AND n >= 5) GROUP BY conv_id, turn)
SELECT conv_id, turn, length(x) AS n_chars FROM pj WHERE x <> ''"""
    cut = f"regexp_replace(line, '{_B}+$', '')"
    blanks = lines + f""",
pc AS (SELECT conv_id, turn, pos, opaque, CASE WHEN opaque THEN line WHEN contains(line, '|') THEN {cut} ELSE regexp_replace({cut}, ' {{3,}}', ' ', 'g') END AS line FROM pf WHERE opaque OR NOT regexp_full_match({_trim('line')}, '[-=_]{{11,}}')),
pg AS (SELECT *, pos - row_number() OVER (PARTITION BY conv_id, turn, opaque ORDER BY pos) AS g0 FROM pc),
pr AS (SELECT *, sum(ch) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS g FROM (SELECT *, CASE WHEN opaque = lag(opaque) OVER (PARTITION BY conv_id, turn ORDER BY pos) THEN 0 ELSE 1 END AS ch FROM pc)),
ps AS (SELECT conv_id, turn, g, min(pos) AS pos, CASE WHEN bool_or(opaque) THEN string_agg(line, E'\\n' ORDER BY pos) ELSE regexp_replace(string_agg(line, E'\\n' ORDER BY pos), '\\n{{3,}}', E'\\n\\n', 'g') END AS seg FROM pr GROUP BY conv_id, turn, g),
pj AS (SELECT conv_id, turn, {_trim("string_agg(seg, E'\\n' ORDER BY pos)")} AS x FROM ps GROUP BY conv_id, turn)
SELECT conv_id, turn, length(x) AS n_chars FROM pj WHERE x <> ''"""
    return {"pass_contents": contents, "pass_whitespace": blanks}


_TEXT = "CASE WHEN json_type({x}) = 'VARCHAR' THEN nullif({x} ->> '$', '') END"


def _t(x: str) -> str:
    return _TEXT.replace("{x}", f"({x})")


_CLAUDE = (
    _docs(False)
    + f""",
cm AS (SELECT export_id, conv_no, c, unnest(range(len(a))) AS pos, unnest(a) AS m FROM (SELECT export_id, conv_no, c, from_json(ls, '["JSON"]') AS a FROM co WHERE ls IS NOT NULL)),
ce AS (SELECT export_id, conv_no, pos, m, coalesce({_t("c -> 'name'")}, {_t("c -> 'title'")}) AS session, lower(trim(coalesce({_t("m -> 'sender'")}, {_t("m -> 'role'")}))) AS who,
    coalesce({_t("m -> 'created_at'")}, {_t("m -> 'updated_at'")}) AS ts,
    coalesce({_t("m -> 'text'")}, CASE WHEN json_type(m -> 'content') = 'VARCHAR' THEN m ->> 'content' END,
      CASE WHEN json_type(m -> 'content') = 'ARRAY' THEN array_to_string(list_filter(list_transform(from_json(m -> 'content', '["JSON"]'), lambda b: CASE WHEN json_type(b) = 'VARCHAR' THEN b ->> '$' WHEN json_type(b) = 'OBJECT' AND coalesce(b ->> 'type', 'text') = 'text' THEN {_t("b -> 'text'")} END), lambda b: b IS NOT NULL), E'\\n') END) AS content
  FROM cm WHERE json_type(m) = 'OBJECT'),
ck AS (SELECT *, CASE WHEN who IN ('human', 'user') THEN 'human' WHEN who IN ('assistant', 'ai') THEN 'assistant' END AS role, regexp_replace(content, '^{_B}+|{_B}+$', '', 'g') AS body FROM ce)
SELECT export_id AS file_id, conv_no, session, CAST(row_number() OVER (PARTITION BY export_id, conv_no ORDER BY pos) - 1 AS INTEGER) AS turn, role, body AS content, ts AS "timestamp" FROM ck WHERE role IS NOT NULL AND body <> ''"""
)


_BRANCHES = (
    _docs(False)
    + f""",
kx AS (SELECT export_id, conv_no, c, mp, unnest(range(len(ks))) AS i, unnest(ks) AS k FROM (SELECT *, json_keys(mp) AS ks FROM co WHERE json_type(mp) = 'OBJECT')),
nx AS (SELECT export_id, conv_no, i, k, json_extract(mp, '$."' || k || '"') AS n, c ->> 'current_node' AS cur, c ->> 'title' AS session FROM kx),
gu AS (SELECT export_id, conv_no, k, true AS u FROM nx WHERE k = cur),
gr AS (SELECT export_id, conv_no, arg_min(k, i) AS k, false AS u FROM nx WHERE coalesce(n ->> 'parent', '') = '' GROUP BY export_id, conv_no),
gs AS (SELECT * FROM gu UNION ALL SELECT gr.* FROM gr WHERE NOT EXISTS (SELECT 1 FROM gu WHERE gu.export_id = gr.export_id AND gu.conv_no = gr.conv_no)),
wk AS (
  SELECT export_id, conv_no, k, u, 0 AS p, [k] AS seen FROM gs
  UNION ALL
  SELECT w.export_id, w.conv_no, t.k, w.u, w.p + 1, list_append(w.seen, t.k) FROM wk w
  JOIN nx a ON a.export_id = w.export_id AND a.conv_no = w.conv_no AND a.k = w.k
  JOIN nx t ON t.export_id = w.export_id AND t.conv_no = w.conv_no AND t.k = CASE WHEN w.u THEN a.n ->> 'parent' ELSE json_extract_string(a.n, '$.children[#-1]') END
  WHERE NOT list_contains(w.seen, t.k)),
bm AS (SELECT w.export_id, w.conv_no, nx.session, CASE WHEN w.u THEN -w.p ELSE w.p END AS pos, nx.n -> 'message' AS m FROM wk w JOIN nx ON nx.export_id = w.export_id AND nx.conv_no = w.conv_no AND nx.k = w.k),
bt AS (SELECT *, CASE lower(m -> 'author' ->> 'role') WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' END AS role, m -> 'content' ->> 'content_type' AS kind, TRY_CAST(m ->> 'create_time' AS DOUBLE) AS ct FROM bm WHERE json_type(m) = 'OBJECT'),
bx AS (SELECT *, CASE WHEN kind IN ('text', 'multimodal_text') AND json_type(m -> 'content' -> 'parts') = 'ARRAY'
      THEN array_to_string(list_filter(list_transform(from_json(m -> 'content' -> 'parts', '["JSON"]'), lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN p ->> '$' END), lambda p: p IS NOT NULL), E'\\n')
    WHEN kind = 'code' THEN '```' || coalesce(m -> 'content' ->> 'language', '') || E'\\n' || nullif(m -> 'content' ->> 'text', '') || E'\\n```' END AS body FROM bt
  WHERE coalesce(m -> 'metadata' ->> 'is_visually_hidden_from_conversation', 'false') <> 'true'),
by_ AS (SELECT *, {_trim('body')} AS content FROM bx WHERE role IS NOT NULL)
SELECT export_id AS file_id, conv_no, session, CAST(row_number() OVER (PARTITION BY export_id, conv_no ORDER BY pos) - 1 AS INTEGER) AS turn, role, content,
  CASE WHEN ct <> 0 THEN strftime(to_timestamp(floor(ct)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp" FROM by_ WHERE content <> ''"""
)


def oracle_sql() -> dict[str, str]:
    from quillspan.plans.queries_text import _T

    return _passes(_T) | {
        "p1_found": _WRAPPED + "SELECT DISTINCT export_id, conv_no, node_key, parent_key, piece_path FROM pc",
        "p1_conversations": _WRAPPED + """, k AS (SELECT export_id, conv_no, count(*) AS n FROM ms GROUP BY ALL)
SELECT DISTINCT co.export_id, co.conv_no, CASE WHEN json_type(mp) = 'OBJECT' THEN 'mapping' WHEN json_type(c -> 'chat_messages') = 'ARRAY' THEN 'chat_messages' WHEN json_type(c -> 'messages') = 'ARRAY' THEN 'messages' ELSE '' END AS layout,
  coalesce(c ->> 'title', c ->> 'name') AS title, c ->> 'current_node' AS current_node, CAST(coalesce(k.n, 0) AS INTEGER) AS n_messages FROM co LEFT JOIN k ON k.export_id = co.export_id AND k.conv_no = co.conv_no""",
        "claude_turns": _CLAUDE,
        "chatgpt_turns": _BRANCHES,
        "speaker_turns": _SPEAKERS,
        "copilot_turns": _COPILOT_TURNS,
        "plain_turns": _PLAIN,
        "clean_markup": _MARKUP,
    }
