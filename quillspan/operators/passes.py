"""The six cleaning passes over conversations and the plan that runs them in order.

A pass takes and gives (conv_id, turn, role, content, ...); ``turn`` orders a conversation. What one text decides runs
next to its row; what needs the conversation (repeated paragraphs, repeated header blocks, quotes of earlier turns,
adjacent repeats) is an aggregate or an equi-join on (conversation, key), so a conversation of any size spreads over
all tasks. Turns emptied by a pass are dropped. NULL contents count as empty; extra columns pass through.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.functions import scan
from quillspan.functions.text import count_tokens, normalize
from quillspan.functions.unicode import ratio_at_least, ratio_bound
from quillspan.operators.similar import similar_pairs
from quillspan.plans.blocks import rank_in_groups
from quillspan.plans.leaders import leaders
from quillspan.session import cut

MIN_TOKENS, SMALL_TOKENS = 500, 100
CLUSTER, SIMILARITY, LENGTH_GATE, MIN_PARAGRAPH = 3, 0.90, 0.10, 30
QUOTE_SHARE, TURN_SIMILARITY = 0.85, 0.90
PASSES = ("boilerplate", "whitespace", "low_signal", "contents", "quoted", "repeated_turns")


def _each(f):
    @pandas_udf("string")
    def g(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x or ""))

    return g


def prune(df: DataFrame) -> DataFrame:
    return df.where(F.col("content").rlike(r"(?U)\S"))


def clean_blanks(df: DataFrame) -> DataFrame:
    return df.withColumn("content", _each(scan.clean_blanks)("content"))


def whitespace(df: DataFrame) -> DataFrame:
    return prune(clean_blanks(df))


def clean_contents(df: DataFrame) -> DataFrame:
    return df.withColumn("content", _each(scan.clean_contents)("content"))


def contents(df: DataFrame) -> DataFrame:
    return prune(clean_contents(df))


# --- boilerplate -------------------------------------------------------------------------------------------------


def _prose(x: str) -> bool:
    rows = [y for y in x.split("\n") if y.strip() and "|" in y]
    return len(rows) < 2 and not (x and sum(map(str.isdigit, x)) / len(x) > 0.3)


def _paragraphs(text: str):
    """(place, paragraph) over all text segments; places count every paragraph."""
    place = 0
    for kind, x in scan.segments(text):
        if kind == "text":
            for p in re.split(r"\n\s*\n", x):
                yield place, p
                place += 1


def _drop_paragraphs(text: str, places: set[int]) -> str:
    place, out = 0, []
    for kind, x in scan.segments(text):
        if kind == "text":
            ps = re.split(r"\n\s*\n", x)
            out.append("\n\n".join(p for k, p in enumerate(ps, place) if k not in places))
            place += len(ps)
        else:
            out.append(x)
    return "\n".join(out).strip()


def paragraphs(df: DataFrame) -> DataFrame:
    """(conv_id, turn, place, norm) of the paragraphs that may be boilerplate."""

    def go(batches):
        for pdf in batches:
            rows = [
                (c, t, k, n)
                for c, t, x in zip(pdf.conv_id, pdf.turn, pdf.content)
                for k, p in _paragraphs(x or "")
                for n in (scan.plain(p),)
                if len(n) >= MIN_PARAGRAPH and _prose(p)
            ]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "place", "norm"])

    return df.select("conv_id", "turn", "content").mapInPandas(go, f"conv_id {dict(df.dtypes)['conv_id']}, turn int, place int, norm string")


def boilerplate_places(df: DataFrame) -> DataFrame:
    """(conv_id, turn, places): paragraphs that repeat an earlier one, in clusters of at least CLUSTER."""
    entries = cut(paragraphs(df))
    order = (F.shiftleft(F.col("turn").cast("bigint"), 31) + F.col("place")).alias("item")
    entries = entries.withColumn("item", order)
    # a later copy of a text lands where its first copy landed, so only distinct texts are compared
    items = entries.groupBy("conv_id", "norm").agg(F.min("item").alias("item"), F.count("*").alias("copies"))
    pairs = similar_pairs(items.select("conv_id", "item", F.col("norm").alias("text")), "conv_id", SIMILARITY, LENGTH_GATE)
    lead = leaders(pairs, ["conv_id"])
    placed = items.join(lead, ["conv_id", "item"], "left").withColumn("leader", F.coalesce("leader", "item"))
    big = placed.groupBy("conv_id", "leader").agg(F.sum("copies").alias("n")).where(F.col("n") >= CLUSTER).select("conv_id", "leader")
    texts = placed.join(big, ["conv_id", "leader"]).select("conv_id", "norm", "leader")
    gone = entries.join(texts, ["conv_id", "norm"]).where(F.col("item") != F.col("leader"))
    return gone.groupBy("conv_id", "turn").agg(F.collect_set("place").alias("places"))  # at most the paragraphs of one turn


def boilerplate(df: DataFrame) -> DataFrame:
    @pandas_udf("string")
    def drop(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([x if p is None else _drop_paragraphs(x or "", set(p)) for x, p in zip(text, places)])

    joined = df.join(boilerplate_places(df), ["conv_id", "turn"], "left")
    return prune(joined.withColumn("content", drop("content", "places")).drop("places"))


# --- low-signal lines ----------------------------------------------------------------------------------------------


def repeated_headers(df: DataFrame) -> DataFrame:
    """(conv_id, turn, repeats): places of header blocks whose text an earlier block of the conversation has."""

    @pandas_udf("array<string>")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(lambda x: scan.header_keys(x or ""))

    blocks = df.select("conv_id", "turn", F.posexplode(keys("content")).alias("place", "key"))
    at = F.struct("turn", "place")
    first = blocks.groupBy("conv_id", "key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select("conv_id", "key", "first")
    again = blocks.join(first, ["conv_id", "key"]).where(at != F.col("first"))
    return again.groupBy("conv_id", "turn").agg(F.collect_set("place").alias("repeats"))  # at most the blocks of one turn


def low_signal(df: DataFrame) -> DataFrame:
    @pandas_udf("string")
    def clean(text: pd.Series, repeats: pd.Series) -> pd.Series:
        return pd.Series([scan.clean_low_signal(x or "", set() if r is None else set(r)) for x, r in zip(text, repeats)])

    joined = df.join(repeated_headers(df), ["conv_id", "turn"], "left")
    return prune(joined.withColumn("content", clean("content", "repeats")).drop("repeats"))


# --- quoted replies ------------------------------------------------------------------------------------------------


def _quotes(text: str):
    """(segment, block, line) of the lines of quote blocks."""
    for s, (kind, x) in enumerate(scan.segments(text)):
        if kind == "text":
            for b, (quote, run) in enumerate(scan.quote_blocks(x)):
                if quote:
                    for y in scan.quoted_lines(run):
                        yield s, b, y


_WORDS = re.compile(r"[^\W_]+")


def _anchor(line: str) -> str:
    """The longest word inside the line that is whole wherever the line is found; '' if there is none."""
    inner = [m[0] for m in _WORDS.finditer(line) if m.start() > 0 and m.end() < len(line)]
    return max(inner, key=lambda w: (len(w), w), default="")


def held_quotes(df: DataFrame) -> DataFrame:
    """(conv_id, turn, held): (segment, block) pairs of quote blocks of which enough lines stand in earlier segments.

    A line is looked up by its longest inner word among the segments before it and then compared; a line may run
    over the border of two neighbouring segments. Lines without an inner word are compared with all segments of
    the conversation that hold one of their few distinct texts.
    """

    def quotes(batches):
        for pdf in batches:
            rows = [(c, t, s, b, y, _anchor(y)) for c, t, x in zip(pdf.conv_id, pdf.turn, pdf.content) for s, b, y in _quotes(x or "")]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "seg", "block", "line", "word"])

    def corpus(batches):
        for pdf in batches:
            rows = [(c, t, s, scan.plain(x)) for c, t, y in zip(pdf.conv_id, pdf.turn, pdf.content) for s, (_, x) in enumerate(scan.segments(y or ""))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "seg", "norm"])

    conv = dict(df.dtypes)["conv_id"]
    base = df.select("conv_id", "turn", "content")
    asked = cut(base.where(F.col("content").rlike(r"(?m)^\s*(>|On .+ wrote:\s*$)")).mapInPandas(quotes, f"conv_id {conv}, turn int, seg int, block int, line string, word string"))
    lines = asked.groupBy("conv_id", "line", "word").agg(F.max(F.struct("turn", "seg")).alias("last"))
    held = base.join(asked.select("conv_id").distinct(), "conv_id", "left_semi").mapInPandas(corpus, f"conv_id {conv}, turn int, seg int, norm string")
    ordered = rank_in_groups(held.withColumn("at", F.shiftleft(F.col("turn").cast("bigint"), 31) + F.col("seg")), ["conv_id"], "at", "pos")
    ordered = ordered.withColumn("at2", F.struct("turn", "seg"))
    # a line over a border is held once both neighbours are, so the later one dates it
    longest = asked.groupBy("conv_id").agg(F.max(F.length("line")).alias("n"))
    reach = ordered.join(longest, "conv_id")  # as much on each side as the longest quoted line of the conversation
    head = reach.select("conv_id", F.col("pos"), "at2", F.left("norm", "n").alias("head"))
    tail = reach.select("conv_id", (F.col("pos") + 1).alias("pos"), F.right("norm", "n").alias("tail"))
    border = head.join(tail, ["conv_id", "pos"]).select("conv_id", "at2", F.concat("tail", F.lit(" "), "head").alias("norm"))
    pieces = ordered.select("conv_id", "at2", "norm").unionByName(border)
    words = F.array_distinct(F.regexp_extract_all("norm", F.lit(r"(?U)[\p{L}\p{N}]+"), F.lit(0)))
    text = pieces.select("conv_id", "at2", "norm", F.explode(F.array_append(words, F.lit(""))).alias("word"))
    found = (
        lines.join(text, ["conv_id", "word"]).where((F.col("at2") < F.col("last")) & F.col("norm").contains(F.col("line")))
        .groupBy("conv_id", "line").agg(F.min("at2").alias("first"))
    )
    judged = asked.join(found, ["conv_id", "line"], "left").withColumn("hit", F.coalesce(F.col("first") < F.struct("turn", "seg"), F.lit(False)).cast("int"))
    blocks = judged.groupBy("conv_id", "turn", "seg", "block").agg(F.avg("hit").alias("share")).where(F.col("share") >= QUOTE_SHARE)
    return blocks.groupBy("conv_id", "turn").agg(F.collect_list(F.concat_ws(":", "seg", "block")).alias("held"))


def _replace_quotes(text: str, held: set[str]) -> str:
    out = []
    for s, (kind, x) in enumerate(scan.segments(text)):
        if kind == "text":
            x = "\n".join(z for b, (_, run) in enumerate(scan.quote_blocks(x)) for z in ([scan.QUOTED] if f"{s}:{b}" in held else run))
        out.append(x)
    return "\n".join(out).strip()


def quoted(df: DataFrame) -> DataFrame:
    @pandas_udf("string")
    def replace(text: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([(x or "").strip() if h is None else _replace_quotes(x or "", set(h)) for x, h in zip(text, held)])

    joined = df.join(held_quotes(df), ["conv_id", "turn"], "left")
    return prune(joined.withColumn("content", replace("content", "held")).drop("held"))


# --- adjacent repeats ----------------------------------------------------------------------------------------------


def repeated_turns(df: DataFrame, least: float = TURN_SIMILARITY) -> DataFrame:
    """Turns nearly equal to the next one are dropped, whatever the roles; the later one stays."""
    ranked = rank_in_groups(df, ["conv_id"], "turn", "pos").withColumn("norm", normalize("content"))
    after = ranked.select("conv_id", (F.col("pos") - 1).alias("pos"), F.col("norm").alias("next"))
    both = ranked.join(after, ["conv_id", "pos"], "left")
    close = F.when((F.col("norm") != "") & (F.col("next") != "") & (ratio_bound("norm", "next") >= least), ratio_at_least("norm", "next", least))
    return both.withColumn("near", close).where("near IS NULL").drop("near", "norm", "next", "pos")


# --- all passes ----------------------------------------------------------------------------------------------------


def optimize(turns: DataFrame, clean=None, least_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The cleaned turns and one report row per conversation: tokens before, after each pass and at the end.

    Conversations under ``least_tokens`` stay as they are (``skipped``). ``clean`` is an optional function text ->
    text for a last pass; if it fails or gives nothing for one turn, its whole conversation keeps the rules' result.
    """
    sized = turns.withColumn("raw", count_tokens("content"))
    total = sized.groupBy("conv_id").agg(F.sum("raw").alias("raw_tokens"), F.count("*").alias("raw_turns"))
    total = cut(total.withColumn("skipped", F.col("raw_tokens") < least_tokens))
    marked = turns.join(total.select("conv_id", "skipped"), "conv_id")
    work = marked.where("NOT skipped").drop("skipped")
    # a pass that looks at more than its row is written once, together with the row-wise pass behind it
    steps, sizes, names = ((boilerplate, clean_blanks), (low_signal, clean_contents), (quoted, None), (repeated_turns, None)), [], iter(PASSES)
    for step, row_wise in steps:
        done = step(work).withColumn("_tokens", count_tokens("content"))
        done = cut(row_wise(done) if row_wise else done)
        sizes.append(done.groupBy("conv_id").agg(F.sum("_tokens").alias(f"after_{next(names)}")))
        work = done.drop("_tokens")
        if row_wise:
            work = prune(work)
            sizes.append(work.groupBy("conv_id").agg(F.sum(count_tokens("content")).alias(f"after_{next(names)}")))
    if clean is not None:
        work = cut(cleaned(work, clean))
    final = work.groupBy("conv_id").agg(F.sum(count_tokens("content")).alias("left_tokens"), F.count("*").alias("left_turns"))
    report = total
    for s in [*sizes, final]:
        report = report.join(s, "conv_id", "left")
    kept = F.when(F.col("skipped"), F.col("raw_tokens")).otherwise(F.coalesce("left_tokens", F.lit(0)))
    report = report.select(
        "conv_id", "skipped", "raw_tokens",
        *[F.when(~F.col("skipped"), F.coalesce(f"after_{p}", F.lit(0))).alias(f"after_{p}") for p in PASSES],
        kept.alias("final_tokens"),
        F.when(F.col("skipped"), 0).otherwise(F.col("raw_turns") - F.coalesce("left_turns", F.lit(0))).cast("bigint").alias("turns_dropped"),
        ((kept > 0) & (kept < SMALL_TOKENS) & ~F.col("skipped")).alias("small"),
        F.when(F.col("raw_tokens") > 0, 100.0 * (F.col("raw_tokens") - kept) / F.col("raw_tokens")).otherwise(0.0).alias("reduction_pct"),
    )
    return marked.where("skipped").drop("skipped").unionByName(work), report


def cleaned(turns: DataFrame, clean) -> DataFrame:
    """The outside cleaner over every turn, with the fallback per conversation."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                y = clean(x)
            except Exception:
                return None
            return y.strip() if y and y.strip() else None

        return s.map(one)

    tried = cut(turns.withColumn("_new", run("content")))
    failed = tried.where("_new IS NULL").select("conv_id").distinct().withColumn("_failed", F.lit(True))
    return tried.join(failed, "conv_id", "left").withColumn("content", F.when(F.col("_failed"), F.col("content")).otherwise(F.col("_new"))).drop("_new", "_failed")


def batch_totals(report: DataFrame) -> DataFrame:
    """One row over all conversations that were not skipped."""
    raw, final = F.sum("raw_tokens"), F.sum("final_tokens")
    return report.where("NOT skipped").agg(
        F.count("*").alias("conversations"), F.coalesce(raw, F.lit(0)).alias("raw_tokens"), F.coalesce(final, F.lit(0)).alias("final_tokens"),
        F.when(raw > 0, 100.0 * (raw - final) / raw).otherwise(0.0).alias("saved_pct"),
    )
