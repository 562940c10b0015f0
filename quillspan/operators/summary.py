"""Aggregates over a run and the report lines made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import strip


def first_value(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value): the first value by ``order`` that is not blank; groups without one are left out."""
    full = rows.where(F.coalesce(strip(value), F.lit("")) != "")
    return full.groupBy(group).agg(F.min_by(strip(value), order).alias(value))


def last_row(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """(group, columns): the last row by ``order``, ties by the greatest values."""
    r = rows.groupBy(group).agg(F.max(F.struct(order, *columns)).alias("r"))
    return r.select(group, *[F.col(f"r.{c}").alias(c) for c in columns])


def ordered_distinct(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, values): distinct values by first occurrence. Equal values are merged before they meet, so a group's
    list is as long as its distinct values."""
    first = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.min(order).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    return first.groupBy(group).agg(F.transform(listed, lambda x: x["v"]).alias("values"))


def link_stats(forward: DataFrame, back: DataFrame) -> DataFrame:
    """One row: forward links and the notes they start from, back links and the notes they reach; ``forward`` holds
    (src, tgt), ``back`` (tgt, links)."""
    f = forward.agg(F.count("*").alias("forward"), F.countDistinct("src").alias("forward_notes"))
    b = back.agg(F.coalesce(F.sum(F.size("links")), F.lit(0)).alias("backlinks"), F.count("*").alias("backlink_notes"))
    both = f.select("*", F.lit(1).alias("k")).join(b.select("*", F.lit(1).alias("k")), "k")  # one row each
    return both.drop("k")


def merge_stats(stats: DataFrame) -> DataFrame:
    """One row over the stats of many runs: any enabled, sums of the counters."""
    numbers = ("forward", "forward_notes", "backlinks", "backlink_notes", "failures", "backups")
    return stats.agg(F.coalesce(F.bool_or("enabled"), F.lit(False)).alias("enabled"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in numbers])


def preview(forward: DataFrame, titles: DataFrame) -> DataFrame:
    """(src, lines): what would be linked from each note, best first; ``forward`` holds (src, tgt_title, reason, rank)."""
    per = forward.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "tgt_title", "reason"))).alias("l"))
    named = per.hint("merge").join(titles.select(F.col("id").alias("src"), "title").hint("merge"), "src")
    to = F.transform("l", lambda x: F.concat(F.lit("  → would link to: [["), x["tgt_title"], F.lit("]] ("), x["reason"], F.lit(")")))
    back = F.concat(F.lit("  ← would backlink into: "), F.array_join(F.transform("l", lambda x: F.concat(F.lit("[["), x["tgt_title"], F.lit("]]"))), ", "))
    return named.select("src", F.array_join(F.concat(F.array(F.concat(F.lit('NEW: "'), F.col("title"), F.lit('"'))), to, F.array(back)), "\n").alias("lines"))


def report_lines(report: DataFrame) -> DataFrame:
    """(conv_id, lines): the optimizer's report of each conversation as text."""
    number = lambda c: F.format_number(c, 0)
    passes = [c for c in report.columns if c.startswith("after_")]
    before = ["raw_tokens", *passes[:-1]]
    steps = [F.concat(F.lit(f"    {p.removeprefix('after_').replace('_', ' '):<22}"), F.lpad(number(p), 8, " "), F.lit("  (-"), number(F.col(b) - F.col(p)), F.lit(")")) for b, p in zip(before, passes)]
    lines = F.array(
        F.concat(F.lit("  Raw:                "), number("raw_tokens"), F.lit(" tokens")), *steps,
        F.concat(F.lit("  Final:              "), number("final_tokens"), F.lit(" tokens ("), F.format_number("reduction_pct", 1), F.lit("% reduction)")),
    )
    skipped = F.concat(F.lit("Token optimization:   skipped (below threshold, "), number("raw_tokens"), F.lit(" tokens)"))
    return report.select("conv_id", F.when(F.col("skipped"), skipped).otherwise(F.concat(F.lit("Token optimization:\n"), F.array_join(lines, "\n"))).alias("lines"))


def stamp(extra, values: dict[str, Column]) -> Column:
    """The extra fields of a note (map of JSON values) with more fields; NULL values are left out, old ones replaced."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    x = F.coalesce(F.col(extra) if isinstance(extra, str) else extra, none)
    for k, v in values.items():
        kept = F.map_filter(x, _other_than(k))
        quoted = F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"'))
        x = F.when(v.isNotNull(), F.map_concat(kept, F.create_map(F.lit(k), quoted))).otherwise(x)
    return x


def _other_than(name: str):
    return lambda key, _: key != name
