"""Chat exports (JSON) as turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from quillspan.functions.text import export_role, iso_utc, strip

_BOM = "regexp_replace(content, '^\\\\uFEFF', '')"


def _text(v: str) -> str:
    """SQL: the variant as text if it is a JSON string, else NULL."""
    return f"CASE WHEN left(to_json({v}), 1) = '\"' THEN cast({v} AS STRING) END"


def _conversations(files: DataFrame) -> DataFrame:
    """(file_id, conv_no, c): the outer array's entries, or the single object, as JSON text in the file's key order."""
    raw = files.select("file_id", F.expr(_BOM).alias("raw")).where("try_parse_json(raw) IS NOT NULL")
    return raw.select("file_id", F.expr("posexplode(CASE WHEN raw RLIKE '^\\\\s*\\\\[' THEN from_json(raw, 'ARRAY<STRING>') ELSE array(raw) END)").alias("conv_no", "c"))


def _finish(rows: DataFrame) -> DataFrame:
    """Turns with a role and some text, renumbered from 0 in their order ``pos``."""
    kept = rows.withColumn("content", strip("content")).where("role IS NOT NULL AND content <> ''")
    per = kept.groupBy("file_id", "conv_no", "session").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content", "timestamp"))).alias("ts"))
    return per.select("file_id", "conv_no", "session", F.posexplode("ts").alias("turn", "t")).select("file_id", "conv_no", "session", "turn", "t.role", "t.content", "t.timestamp")


def claude_turns(files: DataFrame) -> DataFrame:
    """Exports with a list of messages: text, else string content, else the text blocks of the content."""
    lists = "CASE WHEN size({a}) > 0 THEN {a} ELSE {b} END".format(
        a="try_variant_get(v, '$.chat_messages', 'array<variant>')", b="try_variant_get(v, '$.messages', 'array<variant>')"
    )
    get = lambda k, v="m": f"nullif({_text(f'try_variant_get({v}, {chr(39)}$.{k}{chr(39)}, {chr(39)}variant{chr(39)})')}, '')"
    convs = _conversations(files).withColumn("v", F.expr("try_parse_json(c)"))
    msgs = convs.select("file_id", "conv_no", F.expr(f"coalesce({get('name', 'v')}, {get('title', 'v')})").alias("session"), F.expr(f"posexplode({lists})").alias("pos", "m"))
    content = "try_variant_get(m, '$.content', 'variant')"
    blocks = f"transform(try_cast({content} AS ARRAY<VARIANT>), b -> coalesce({_text('b')}, CASE WHEN coalesce(try_variant_get(b, '$.type', 'string'), 'text') = 'text' THEN {get('text', 'b')} END))"
    text = f"coalesce({get('text')}, {_text(content)}, array_join(filter({blocks}, b -> b IS NOT NULL), '\n'))"
    rows = msgs.select(
        "file_id", "conv_no", "session", "pos", export_role(F.expr(f"coalesce({get('sender')}, {get('role')})")).alias("role"),
        F.expr(text).alias("content"), F.expr(f"coalesce({get('created_at')}, {get('updated_at')})").alias("timestamp"),
    )
    return _finish(rows)


@pandas_udf(ArrayType(IntegerType()))
def _walk(keys: pd.Series, parents: pd.Series, last: pd.Series, current: pd.Series) -> pd.Series:
    """The places of the nodes along the active branch, in time linear in the nodes."""

    def line(ks, ps, cs, at):
        place = {k: i for i, k in enumerate(ks)}
        up = at in place
        ahead = ps if up else cs
        if not up:
            at = next((k for k, p in zip(ks, ps) if not p), None)
        out: dict[int, None] = {}
        while at in place and place[at] not in out:
            out[place[at]] = None
            at = ahead[place[at]]
        return list(out)[::-1] if up else list(out)

    return pd.Series([line(*row) for row in zip(keys, parents, last, current)], dtype=object)


def active_line(files: DataFrame) -> DataFrame:
    """(file_id, conv_no, session, pos, message) along the active branch of each mapping: from ``current_node`` up by
    parents, or without it from the first root in the file's order down by last children. A tree lies in one row; only
    its keys and links go through Arrow for the walk, which stops at loops and at links to no node."""
    node = "STRUCT<message:STRING,parent:STRING,children:ARRAY<STRING>>"
    # from_json keeps the order of the mapping's keys, which decides the first root; variants sort them
    shape = f"STRUCT<title:STRING,current_node:STRING,mapping:MAP<STRING,{node}>>"
    one = _conversations(files).select("file_id", "conv_no", F.from_json("c", shape).alias("c")).where("size(c.mapping) > 0")
    nodes = one.select("file_id", "conv_no", F.col("c.title").alias("session"), "c.current_node", F.map_keys("c.mapping").alias("k"), F.map_values("c.mapping").alias("v"))
    child = F.transform("v", lambda x: F.when(F.size(x["children"]) > 0, F.element_at(x["children"], -1)))
    walked = nodes.withColumn("line", _walk("k", F.transform("v", lambda x: x["parent"]), child, "current_node"))
    return walked.select("file_id", "conv_no", "session", F.posexplode(F.transform("line", lambda i: F.get("v", i)["message"])).alias("pos", "message")).where("message IS NOT NULL")


def chatgpt_turns(files: DataFrame) -> DataFrame:
    """Exports with a mapping: visible user and assistant messages of the active branch; text parts joined, code fenced."""
    m = active_line(files).withColumn("m", F.expr("try_parse_json(message)")).where("m IS NOT NULL")
    get = lambda p, t="string": f"try_variant_get(m, '$.{p}', '{t}')"
    role = f"CASE lower({get('author.role')}) WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'assistant' END"
    hidden = f"coalesce({get('metadata.is_visually_hidden_from_conversation', 'boolean')}, false)"
    parts = f"array_join(filter(transform({get('content.parts', 'array<variant>')}, p -> {_text('p')}), p -> p IS NOT NULL), '\n')"
    code = f"concat('```', coalesce({get('content.language')}, ''), '\n', nullif({get('content.text')}, ''), '\n```')"
    kind = get("content.content_type")
    text = f"CASE WHEN {kind} IN ('text', 'multimodal_text') THEN {parts} WHEN {kind} = 'code' THEN {code} END"
    rows = m.where(F.expr(f"NOT {hidden}")).select(
        "file_id", "conv_no", "session", "pos", F.expr(role).alias("role"), F.expr(text).alias("content"), iso_utc(F.expr(get("create_time", "double"))).alias("timestamp")
    )
    return _finish(rows)
