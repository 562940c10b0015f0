"""Payloads that only the wider reader takes, against a plain restatement."""

import json

from quillspan.operators.nested import flatten_exports, piece_keys

MESSAGE = '{"mapping":{"a":{"parent":"r","message":{"content":{"parts":["x",{"content":["p","q"]}]}}}}}'


def wrapped(text, layers):
    for _ in range(layers):
        text = json.dumps(text)
    return text


def keys(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "export_id bigint, payload string")
    return sorted(tuple(r) for r in piece_keys(df).collect())


def test_any_number_of_wrappings(spark):
    got = keys(spark, *[wrapped(MESSAGE, n) for n in range(9)])
    assert got == [(n, 0, "a", "r", path) for n in range(9) for path in ("0", "1.0", "1.1")]


def test_equal_keys_and_odd_numbers(spark):
    got = keys(
        spark, '{"title":"a","title":"b","messages":[{"text":"t"}]}', '{"mapping":{"a":{"message":null},"a":{"message":{"content":"u"}}}}',
        '{"v":NaN,"w":-Infinity,"chat_messages":[{"text":"t"},null,"s",{"content":[]}]}',
    )
    assert got == [(0, 0, "0", "", "0"), (1, 0, "a", "", "0"), (2, 0, "0", "", "0"), (2, 0, "3", "", "")]


def test_thousands_of_levels(spark):
    n = 3000
    got = keys(spark, '{"messages":[{"content":' + '[{"content":' * n + '["z","y"]' + "}]" * n + "}]}")
    stem = ".".join(["0"] * n)
    assert got == [(0, 0, "0", "", f"{stem}.0"), (0, 0, "0", "", f"{stem}.1")]


def test_empty_mapping_beside_a_list_and_no_conversation(spark):
    assert keys(spark, '{"mapping":{},"chat_messages":[{"text":"t"}]}', '[1,null,[{"messages":[{"text":"t"}]}]]', "[]", None) == []


def test_refused_payloads_are_listed(spark):
    df = spark.createDataFrame([(1, "oops"), (2, ""), (3, None), (4, '"word"'), (5, MESSAGE[:-3]), (6, MESSAGE), (7, '{"a":NaN}')], "export_id bigint, payload string")
    assert sorted(r.export_id for r in flatten_exports(df)["refused"].collect()) == [1, 2, 4, 5]


def test_repaired_messages_keep_their_fields(spark):
    text = '{"x":NaN,"title":"T","current_node":"n","mapping":{"n":{"parent":"p","message":{"author":{"role":"User"},"create_time":5,"content":{"parts":[{"type":"image","content":["deep",{"text":"in"}]}]}}}}}'
    tables = flatten_exports(spark.createDataFrame([(1, text)], "export_id bigint, payload string"))
    assert [tuple(r) for r in tables["conversations"].collect()] == [(1, 0, "mapping", "T", "n", 1)]
    assert [tuple(r) for r in tables["messages"].collect()] == [(1, 0, "n", "p", "user", "5", 2)]
    assert sorted(tuple(r) for r in tables["pieces"].collect()) == [(1, 0, "n", "p", "0.0", "text", "deep"), (1, 0, "n", "p", "0.1", "", "in")]
