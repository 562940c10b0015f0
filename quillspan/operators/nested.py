"""Nested chat exports to flat, keyed tables (conversations, messages, content pieces).

One projection does the work: nested ``transform`` calls attach the ancestor keys and positions, ``flatten``
joins the arrays, one ``inline`` per target table emits the rows. No shuffle is needed; Python runs only over payloads
that the built-in reader refuses although they are JSON (repeated keys, NaN, more than 1,000 levels).

Defined results: a NULL payload, damaged JSON, a JSON scalar and an empty array give no rows; the table ``refused`` lists
the payloads without JSON. A byte order mark and any number of layers of JSON-string wrapping (text that is a JSON string
holding JSON) are removed first. Of equal keys the last counts. A node without a message object gives no row. Where
``mapping`` is an object it is taken, even an empty one, else ``chat_messages`` if not empty, else ``messages``.
Repeated input rows give repeated output rows (callers apply ``distinct`` where rows are to count once).
Extra columns in the input are ignored.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANK = r"^[\\uFEFF\\s]+"
_KEYED = "array<struct<node_key:string,parent_key:string,msg:variant>>"
_PIECE = "array<struct<path:string,node:variant>>"
#: Key under which ``repair`` hands over pieces that it has flattened itself; read only in repaired documents.
_FLAT = "flattened pieces"


def _is_string(v: str) -> str:
    """SQL: is the variant ``v`` a JSON string (numbers and booleans also cast to string, so look at the JSON)."""
    return f"coalesce(left(to_json({v}), 1) = '\"', false)"


def _is_object(v: str) -> str:
    return f"(try_cast({v} AS MAP<STRING,VARIANT>) IS NOT NULL)"


def _unwrapped(x: str) -> str:
    """SQL: ``x`` without blanks in front and without any layers of JSON-string wrapping. Wrapping once more doubles
    the backslashes before an inner quote, so that the length of the text bounds the number of layers."""
    bare = lambda t: f"regexp_replace({t}, '{_BLANK}', '')"
    quoted = "left(t, 1) = '\"'"
    inner = bare("cast(try_parse_json(t) AS STRING)")
    layers = f"cast(log2(length({x}) + 1) AS INT) + 2"
    return f"aggregate(sequence(1, {layers}), {bare(x)}, (t, k) -> CASE WHEN {quoted} THEN {inner} ELSE t END)"


def _loaded(text: str):
    """The value inside ``text`` by the wider reader: the last of equal keys, NaN and infinities as null, any number of
    wrappings, several thousand levels. Raises where there is no JSON."""
    while True:
        value = json.loads(text.lstrip("\ufeff \t\r\n\x0b\x0c"), strict=False, parse_constant=lambda _: None)
        if not isinstance(value, str):
            return value
        text = value


def _flat_items(items: list) -> list[dict]:
    out, stack = [], [(str(i), x) for i, x in reversed(list(enumerate(items)))]
    while stack:
        path, x = stack.pop()
        inside = x.get("content") if isinstance(x, dict) else None
        if isinstance(inside, list) and inside:
            stack += [(f"{path}.{j}", y) for j, y in reversed(list(enumerate(inside)))]
        else:
            out.append({"path": path, "node": _shallow(x)})
    return out


def _shallow(x, keys: tuple[str, ...] = ("type", "content_type", "text")):
    """``x`` with only the fields that the tables read; containers become empty ones of their kind."""
    if isinstance(x, dict):
        return {k: _shallow(x[k], ()) for k in keys if k in x}
    return [] if isinstance(x, list) else x


def _shallow_message(m):
    if not isinstance(m, dict):
        return m if not isinstance(m, list) else []
    out = _shallow(m, ("sender", "role", "create_time", "created_at", "text"))
    if isinstance(m.get("author"), dict):
        out["author"] = _shallow(m["author"], ("role",))
    if "content" in m:
        c = m["content"]
        parts = c if isinstance(c, list) else c.get("parts") if isinstance(c, dict) else None
        out["content"] = {_FLAT: _flat_items(parts)} if isinstance(parts, list) and parts else _shallow(c)
    return out


def _shallow_conversation(c):
    if not isinstance(c, dict):
        return _shallow(c)
    out = _shallow(c, ("title", "name", "current_node"))
    if isinstance(c.get("mapping"), dict):
        out["mapping"] = {
            k: {"parent": _shallow(n.get("parent")), "message": _shallow_message(n.get("message"))} if isinstance(n, dict) else _shallow(n)
            for k, n in c["mapping"].items()
        }
    for name in ("chat_messages", "messages"):
        if isinstance(c.get(name), list):
            out[name] = [_shallow_message(m) for m in c[name]]
    return out


def _repaired(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = _loaded(text)
    except (ValueError, RecursionError):
        return None
    out = [_shallow_conversation(c) for c in value] if isinstance(value, list) else _shallow_conversation(value)
    return json.dumps(out)


@F.pandas_udf(StringType())
def repair(payload: pd.Series) -> pd.Series:
    """Payloads that the built-in reader refuses, reduced to what the tables read, in a form that it takes; NULL where
    there is no JSON."""
    return payload.map(_repaired, na_action="ignore") if payload.notna().any() else payload


def parse_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``doc`` (variant, NULL where there is no JSON) and ``repaired``. Python sees only the payloads that the
    built-in reader refuses; the others reach it as NULL."""
    out = df.withColumn("_first", F.expr(f"try_parse_json({_unwrapped(payload)})"))
    out = out.withColumn("_second", repair(F.when(F.col("_first").isNull(), F.col(payload))))
    return out.withColumn("doc", F.expr("coalesce(_first, try_parse_json(_second))")).withColumn(
        "repaired", F.expr("_first IS NULL AND _second IS NOT NULL")
    ).drop("_first", "_second")


#: The outer array, or the single object as an array of one.
_CONVS = "coalesce(try_cast(doc AS ARRAY<VARIANT>), array(doc))"


def _entries(c: str) -> str:
    """SQL: a conversation's message carriers, keyed; ``mapping`` first, then the two lists."""
    as_list = (
        "transform({src}, (x, i) -> named_struct('node_key', cast(i AS STRING), 'parent_key', '', 'msg', x))"
    )
    mapping = f"try_variant_get({c}, '$.mapping', 'map<string,variant>')"
    chat = f"try_variant_get({c}, '$.chat_messages', 'array<variant>')"
    msgs = f"try_variant_get({c}, '$.messages', 'array<variant>')"
    nodes = (
        f"transform(map_entries({mapping}), e -> named_struct('node_key', e.key, "
        "'parent_key', coalesce(try_variant_get(e.value, '$.parent', 'string'), ''), "
        "'msg', try_variant_get(e.value, '$.message', 'variant')))"
    )
    some = f"CASE WHEN size({chat}) > 0 THEN {chat} END"
    return (
        f"coalesce(cast({nodes} AS {_KEYED}), cast({as_list.format(src=some)} AS {_KEYED}), "
        f"cast({as_list.format(src=msgs)} AS {_KEYED}), cast(array() AS {_KEYED}))"
    )


def _pieces(m: str) -> str:
    """SQL: the content pieces of message ``m`` as array<struct<path, node>>, at any depth.

    The fold replaces one level of nesting per step; the number of opening brackets in the content bounds the
    depth, and a step without anything to replace returns its input.
    """
    content = f"try_variant_get({m}, '$.content', 'variant')"
    inner = "try_variant_get(e.node, '$.content', 'array<variant>')"
    direct = f"try_cast({content} AS ARRAY<VARIANT>)"
    parts = f"try_variant_get({content}, '$.parts', 'array<variant>')"
    items = f"CASE WHEN size({direct}) > 0 THEN {direct} WHEN size({parts}) > 0 THEN {parts} END"
    first = f"cast(transform({items}, (x, i) -> named_struct('path', cast(i AS STRING), 'node', x)) AS {_PIECE})"
    step = (
        f"IF(exists(a, e -> coalesce(size({inner}), 0) > 0), "
        f"cast(flatten(transform(a, e -> IF(coalesce(size({inner}), 0) > 0, "
        f"cast(transform({inner}, (y, j) -> named_struct('path', concat(e.path, '.', cast(j AS STRING)), 'node', y)) AS {_PIECE}), "
        f"cast(array(e) AS {_PIECE})))) AS {_PIECE}), a)"
    )
    depth = f"greatest(1, length(regexp_replace(to_json({content}), '[^\\\\[]', '')))"
    flat = f"try_variant_get({content}, '$[\\'{_FLAT}\\']', '{_PIECE}')"
    text = f"try_variant_get({content}, '$.text', 'variant')"
    own = f"try_variant_get({m}, '$.text', 'variant')"
    one = lambda path, node: f"cast(array(named_struct('path', '{path}', 'node', {node})) AS {_PIECE})"
    absent = f"({content} IS NULL OR is_variant_null({content}) OR coalesce(size({direct}), -1) = 0)"
    return (
        f"CASE WHEN repaired AND size({flat}) > 0 THEN {flat} WHEN size({items}) > 0 THEN aggregate(sequence(1, {depth}), {first}, (a, k) -> {step}) "
        f"WHEN {_is_string(content)} THEN {one('0', content)} "
        f"WHEN {_is_string(text)} THEN {one('0', text)} "
        f"WHEN {absent} AND {_is_string(own)} THEN {one('0', own)} "
        f"ELSE {one('', 'cast(NULL AS VARIANT)')} END"
    )


def flatten_exports(df: DataFrame, key: str = "export_id", payload: str = "payload") -> dict[str, DataFrame]:
    """Tables ``conversations``, ``messages`` and ``pieces``, each row with the key of its parent row, and ``refused``:
    the payloads that hold no JSON."""
    parsed = parse_payload(df.select(F.col(key).alias("export_id"), F.col(payload).alias("payload")))
    refused = parsed.where("doc IS NULL AND payload IS NOT NULL").select("export_id", F.length("payload").alias("n_chars"))
    base = parsed.where("doc IS NOT NULL").drop("payload")
    conv = (
        f"filter(transform({_CONVS}, (c, ci) -> named_struct('conv_no', ci, 'c', c)), z -> {_is_object('z.c')})"
    )
    conversations = base.select("export_id", F.expr(f"inline({conv})")).select(
        "export_id",
        "conv_no",
        F.expr("CASE WHEN try_variant_get(c, '$.mapping', 'map<string,variant>') IS NOT NULL THEN 'mapping' "
               "WHEN try_variant_get(c, '$.chat_messages', 'array<variant>') IS NOT NULL THEN 'chat_messages' "
               "WHEN try_variant_get(c, '$.messages', 'array<variant>') IS NOT NULL THEN 'messages' ELSE '' END").alias("layout"),
        F.expr("coalesce(try_variant_get(c, '$.title', 'string'), try_variant_get(c, '$.name', 'string'))").alias("title"),
        F.expr("try_variant_get(c, '$.current_node', 'string')").alias("current_node"),
        F.expr(f"size(filter({_entries('c')}, x -> {_is_object('x.msg')}))").alias("n_messages"),
    )
    msg_rows = (
        f"flatten(transform({conv}, z -> transform(filter({_entries('z.c')}, x -> {_is_object('x.msg')}), "
        "x -> named_struct('conv_no', z.conv_no, 'node_key', x.node_key, 'parent_key', x.parent_key, 'msg', x.msg))))"
    )
    messages = base.select("export_id", "repaired", F.expr(f"inline({msg_rows})")).select(
        "export_id", "conv_no", "node_key", "parent_key",
        F.expr("lower(trim(coalesce(try_variant_get(msg, '$.author.role', 'string'), try_variant_get(msg, '$.sender', 'string'), "
               "try_variant_get(msg, '$.role', 'string'))))").alias("role"),
        F.expr("coalesce(try_variant_get(msg, '$.create_time', 'string'), try_variant_get(msg, '$.created_at', 'string'))").alias("created"),
        F.expr(f"size(filter({_pieces('msg')}, p -> p.path != ''))").alias("n_pieces"),
    )
    piece_rows = (
        f"flatten(transform({msg_rows}, m -> transform({_pieces('m.msg')}, p -> named_struct("
        "'conv_no', m.conv_no, 'node_key', m.node_key, 'parent_key', m.parent_key, 'piece_path', p.path, 'node', p.node))))"
    )
    pieces = base.select("export_id", F.expr(f"inline({piece_rows})")).select(
        "export_id", "conv_no", "node_key", "parent_key", "piece_path",
        F.expr("CASE WHEN left(to_json(node), 1) = '\"' THEN 'text' ELSE coalesce(try_variant_get(node, '$.type', 'string'), "
               "try_variant_get(node, '$.content_type', 'string'), '') END").alias("piece_type"),
        F.expr("CASE WHEN left(to_json(node), 1) = '\"' THEN cast(node AS STRING) ELSE try_variant_get(node, '$.text', 'string') END").alias("text"),
    )
    return {"conversations": conversations, "messages": messages, "pieces": pieces, "refused": refused}


def piece_keys(df: DataFrame, key: str = "export_id", payload: str = "payload") -> DataFrame:
    """The distinct keys of all content pieces."""
    return (
        flatten_exports(df, key, payload)["pieces"]
        .select("export_id", "conv_no", "node_key", "parent_key", "piece_path")
        .distinct()
    )


