"""Archive names: taxonomy lookup, majority, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip

UNKNOWN = "UNK"


def lookup(values: DataFrame, value: str, table: list[tuple[str, str]], out: str, default: str = UNKNOWN) -> DataFrame:
    """Adds the code of ``value`` from a small ordered table (key, code): the exact key (trimmed, lower case; the last of
    equal keys), else the longest key that holds the value or is held by it (the first of equal length), else
    ``default``. The table is a setting, so it is folded into the expression."""
    keys: dict[str, str] = {}
    for k, c in table:
        keys[k.strip().lower()] = c
    x = F.lower(strip(value))
    exact = F.create_map(*[F.lit(y) for kv in keys.items() for y in kv])[x] if keys else F.lit(None).cast("string")
    partial = [(k, c) for k, c in keys.items() if k]
    partial.sort(key=lambda kc: -len(kc[0]))  # stable: equal lengths stay in table order
    near: Column = F.lit(default)
    for k, c in reversed(partial):
        near = F.when(x.contains(F.lit(k)) | F.lit(k).contains(x), c).otherwise(near)
    return values.withColumn(out, F.when(x.isNull() | (x == ""), default).otherwise(F.coalesce(exact, near)))


def majority(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value) with the most rows; of equal counts the one seen first by ``order``."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("first")).alias("early"))).alias(value))


def sequences(rows: DataFrame, day: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """Adds ``seq``: numbers of a day from one above the highest taken, in ``order``.

    ``taken`` holds (day, seq). Numbers are dense, so a day is ranked as a whole."""
    rank = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    if taken is None:
        return rows.withColumn("seq", rank)
    high = taken.groupBy(F.col(day)).agg(F.max("seq").alias("high"))
    return rows.withColumn("seq", rank).join(high, day, "left").withColumn("seq", F.col("seq") + F.coalesce("high", F.lit(0))).drop("high")


def archive_name(day: Column, seq: Column, domain: Column, client: Column, kind: Column, topic: Column, suffix: Column) -> Column:
    number = F.when(seq < 1000, F.lpad(seq.cast("string"), 3, "0")).otherwise(seq.cast("string"))
    return F.concat(day, F.lit("_"), number, F.lit("_"), domain, F.lit("-"), client, F.lit("-"), kind, F.lit("_"), topic, F.lower(suffix))
