"""Windows of whole turns for a bounded context, as a plan of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import turn_cost

CONTEXT, SHARE, SHARED, RESERVED, LEAST_BUDGET = 200_000, 0.8, 10, 24_000, 10_000


def spans(costs: list[int], limit: int, budget: int, shared: int) -> list[tuple[int, int]]:
    """[start, end) of each window: one if all fits into ``limit``, else as many turns as fit into ``budget`` (at
    least one), each window starting ``shared`` turns before the end of the one before, but one turn further at least."""
    n = len(costs)
    pre = np.concatenate(([0], np.cumsum(costs)))
    if not n or pre[n] <= limit:
        return [(0, n)] if n else []
    out, start = [], 0
    while True:
        end = max(start + 1, int(np.searchsorted(pre, pre[start] + budget, "right")) - 1)
        out.append((start, min(end, n)))
        if end >= n:
            return out
        start = max(end - shared, start + 1)


def plan(turns: DataFrame, context: int = CONTEXT, share: float = SHARE, shared: int = SHARED, reserved: int = RESERVED, least: int = LEAST_BUDGET) -> DataFrame:
    """(conv_id, chunk_no, start_turn, end_turn, n_turns, cost); turns are counted from 0 by order.

    Only (turn, cost) pairs of the conversations over the limit come together, 16 bytes a turn; the walk over them
    is sequential by definition. No rows for a conversation without turns."""
    limit = int(context * share)
    budget = max(limit - reserved, least)
    costs = turns.select("conv_id", "turn", turn_cost("content").alias("cost"))
    total = costs.groupBy("conv_id").agg(F.sum("cost").alias("total"), F.count("*").alias("n"))
    whole = total.where(F.col("total") <= limit).select(
        "conv_id", F.lit(0).alias("chunk_no"), F.lit(0).alias("start_turn"), F.col("n").cast("int").alias("end_turn"), F.col("n").cast("int").alias("n_turns"), F.col("total").alias("cost")
    )
    long = costs.join(total.where(F.col("total") > limit).select("conv_id"), "conv_id", "left_semi")

    def walk(pdf):
        c = pdf.sort_values("turn").cost.tolist()
        rows = [(pdf.conv_id.iloc[0], k, s, e, e - s, int(sum(c[s:e]))) for k, (s, e) in enumerate(spans(c, limit, budget, shared))]
        return pd.DataFrame(rows, columns=["conv_id", "chunk_no", "start_turn", "end_turn", "n_turns", "cost"])

    kind = dict(turns.dtypes)["conv_id"]
    return whole.unionByName(long.groupBy("conv_id").applyInPandas(walk, f"conv_id {kind}, chunk_no int, start_turn int, end_turn int, n_turns int, cost bigint"))


def members(chunks: DataFrame) -> DataFrame:
    """(conv_id, chunk_no, pos): the turns of each window; the range join as an equi-join on exploded positions."""
    return chunks.select("conv_id", "chunk_no", F.explode(F.sequence("start_turn", F.col("end_turn") - 1)).alias("pos"))
