"""Speaker turns and markup as column expressions."""

from pyspark.sql import functions as F

from quillspan.functions import speakers


def apply(spark, f, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [[tuple(t) for t in r.v] if isinstance(r.v, list) else r.v for r in df.select("i", f("x").alias("v")).orderBy("i").collect()]


def test_speakers(spark):
    t = "before\n**Human**: hi\nmore\n```\nAI: code\n```\n## Assistant\n<b>yes</b>\nCopy code\nNobody: z\nUser:\n"
    got = apply(spark, speakers.speaker_turns, t, "", None, "```\nYou: a\n```\nYou: b", "AI.: x\r\n# you \n\n  y  \x0bq： z", "Human: a\n~~~\nnever closed\nAI: b")
    assert got[0] == [("human", "before"), ("human", "hi\nmore\n```\nAI: code\n```"), ("assistant", "yes\nNobody: z")]
    assert got[1] == got[2] == []
    assert got[3] == [("human", "```\nYou: a\n```"), ("human", "b")]
    assert got[4] == [("assistant", "x"), ("human", "y"), ("human", "z")]
    assert got[5] == [("human", "a\n~~~\nnever closed\nAI: b")]


def test_plain_text(spark):
    assert apply(spark, speakers.plain_turns, "only text", "You: a", " ", "You: a\nAI: b") == [[("human", "only text")], [("human", "You: a")], [], [("human", "a"), ("assistant", "b")]]


def test_copilot(spark):
    t = "You said:\nwhat [1]\nCopilot said:\nthis²\n[1]: http://x\nLearn more\n"
    assert apply(spark, lambda c: speakers.speaker_turns(c, True), t) == [[("human", "what"), ("assistant", "this")]]
    late = "\n" * 200 + "Copilot"
    assert apply(spark, speakers.looks_copilot, t, "a\nb", " ## **bing", late, late[1:], None) == [True, False, True, False, True, False]


def test_markup(spark):
    t = "<div class='x'>a</div>\n\n\n\n```\n<b>kept</b>\nCopy code\n```<p>\n<p>gone\nRetry\na < b > c <br\n>"
    assert apply(spark, speakers.clean_markup, t, None) == ["a\n\n```\n<b>kept</b>\nCopy code\n```<p>\ngone\na < b > c <br\n>", ""]


def test_long_texts(spark):
    t = "You: " + "word " * 200_000 + "\nAI: " + "line\n" * 50_000
    got = spark.createDataFrame([(t,)], "x string").select(F.transform(speakers.speaker_turns("x"), lambda t: F.length(t["content"])).alias("n")).first().n
    assert got == [5 * 200_000 - 1, 5 * 50_000 - 1]
