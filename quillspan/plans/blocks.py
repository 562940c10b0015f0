"""Ranks and prefix sums within groups of any size: no task ever holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def rank_in_groups(df: DataFrame, group: list[str], position: str, out: str, block: int = BLOCK, first: int = 1) -> DataFrame:
    """Adds ``out``: the dense rank from ``first`` of each row in its group by the whole number ``position``, which must
    be unique in the group. Ranks are taken per block of positions and shifted by the sizes of the blocks before;
    only the block sizes of a group come together in one task."""
    rough = df.withColumn("_block", F.floor(F.col(position) / block))
    counts = rough.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*group, "_block").orderBy(position))
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*group, "_block"]]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    joined = rough.withColumn("_rn", inside).alias("a").join(counts.alias("b"), cond)
    return joined.select("a.*", (F.col("b._base") + F.col("a._rn") - 1 + first).alias(out)).drop("_block", "_rn")


def latest(df: DataFrame, keys: list[str], at: Column, columns: list[str]) -> DataFrame:
    """One row per key: the greatest ``at`` (NULL first), ties by the greatest values of ``columns`` in order."""
    when = F.coalesce(at.cast("double"), F.lit(float("-inf"))).alias("_at")
    r = df.groupBy(*keys).agg(F.max(F.struct(when, *[F.col(c) for c in columns])).alias("_r"))
    return r.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns])
