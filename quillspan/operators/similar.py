"""Pairs of similar texts inside groups by Ratcliff-Obershelp ratio.

Equal texts are one item. Items of a group meet by length bucket: lengths that differ by at most the allowed share
fall into the same or the next bucket. Buckets are cut into blocks of bounded size and a task compares two blocks, so
neither a group nor a bucket has to fit into one task; only verified pairs leave it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.bounds import Matcher, letter_counts

BLOCK = 256


def _bounds(threshold: float, gate: float | None) -> float:
    """The least share that the shorter of two matching lengths can be of the longer."""
    by_ratio = threshold / (2.0 - threshold)
    return max(by_ratio, 1.0 - gate) if gate is not None else by_ratio


def similar_pairs(items: DataFrame, group: str, threshold: float, gate: float | None = None, block: int = BLOCK) -> DataFrame:
    """(group, item, earlier) with ratio(text of item, text of earlier) >= ``threshold`` and ``earlier`` < ``item``, of
    items (group, item, text); with ``gate`` lengths may differ by that share of the longer at most."""
    least = _bounds(threshold, gate)
    width = math.log(1.0 / least) + 1e-9
    n = F.greatest(F.length("text"), F.lit(1))
    rows = items.select(F.col(group).alias("g"), "item", "text").withColumn("bucket", F.floor(F.log(n) / width).cast("int"))
    # blocks by hash: their number follows from the bucket's count, each holds about ``block`` items
    counts = rows.groupBy("g", "bucket").agg(F.count("*").alias("c"))
    parts = F.ceil(F.col("c") / block).cast("int")
    here = counts.select("g", "bucket", parts.alias("parts"))
    above = counts.select("g", (F.col("bucket") - 1).alias("bucket"), parts.alias("parts_above"))
    below = counts.select("g", (F.col("bucket") + 1).alias("bucket"), parts.alias("parts_below"))
    sized = rows.join(here, ["g", "bucket"]).join(above, ["g", "bucket"], "left").join(below, ["g", "bucket"], "left")
    p = F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")
    none = F.array().cast("array<struct<low:int,a:int,b:int,same:boolean>>")

    def tasks(count, build):
        return F.when(count >= 1, F.transform(F.sequence(F.lit(0), count - 1), build)).otherwise(none)

    def key(low, a, b, same):
        return F.struct(low.cast("int").alias("low"), a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(same).alias("same"))

    own = tasks(F.col("parts"), lambda k: key(F.col("bucket"), F.least(p, k), F.greatest(p, k), True))
    up = tasks(F.coalesce("parts_above", F.lit(0)), lambda k: key(F.col("bucket"), p, k, False))
    down = tasks(F.coalesce("parts_below", F.lit(0)), lambda k: key(F.col("bucket") - 1, k, p, False))
    met = sized.withColumn("p", p).withColumn("task", F.explode(F.concat(own, up, down))).select("g", "item", "text", "bucket", "p", "task")

    def compare(g, low, a, b, same, rows):
        """The pairs of one task; ``rows`` are (item, text, bucket, part) by item."""
        size = np.array([len(r[1]) for r in rows])
        side = np.array([r[3] if same else r[2] for r in rows])
        letters = letter_counts([r[1] for r in rows])
        matcher = Matcher(threshold)
        for i, (early, text, _, _) in enumerate(rows[:-1]):
            other = size[i + 1 :]
            may = 2.0 * np.minimum(letters[i], letters[i + 1 :]).sum(axis=1) >= threshold * (other + size[i])
            if gate is not None:
                may &= np.abs(other - size[i]) <= gate * np.maximum(other, size[i])
            if not same or a != b:  # the two blocks against each other only
                may &= side[i + 1 :] != side[i]
            near = np.nonzero(may)[0]
            if len(near):
                matcher.set(text)
                for k in near.tolist():
                    if matcher.ratio(rows[i + 1 + k][1]) is not None:
                        yield g, rows[i + 1 + k][0], early

    def go(batches):
        """Tasks lie one after the other in a partition; only the rows of one are held."""
        key, rows = None, []
        for pdf in batches:
            out = []
            for g, low, a, b, same, item, text, bucket, part in pdf.itertuples(index=False, name=None):
                if (g, low, a, b, same) != key:
                    if len(rows) > 1:
                        out += compare(*key, rows)
                    key, rows = (g, low, a, b, same), []
                rows.append((item, text, bucket, part))
            yield pd.DataFrame(out, columns=["g", "item", "earlier"])
        yield pd.DataFrame(list(compare(*key, rows)) if len(rows) > 1 else [], columns=["g", "item", "earlier"])

    kind = dict(items.dtypes)[group]
    order = ["g", "low", "a", "b", "same"]
    laid = met.select("g", "task.*", "item", "text", "bucket", "p").repartition(*order).sortWithinPartitions(*order, "item")
    found = laid.mapInPandas(go, f"g {kind}, item bigint, earlier bigint")
    return found.withColumnRenamed("g", group).distinct()
