"""Greedy leader clustering, distributed: rows in a fixed order join the first leader that they match, else lead."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.session import stored

#: Open matches that one task decides in a row; while there are more, rounds decide all items that can be decided at once.
FEW = 300_000


def leaders(edges: DataFrame, group: list[str], few: int = FEW) -> DataFrame:
    """(group..., item, leader) of every item with an earlier match in ``edges`` (group..., item, earlier[, old]); items
    and matches are whole numbers in the order of the clustering, ``earlier`` < ``item``. A match marked ``old`` leads
    for certain, whatever its number. ``leader`` is the least match that leads, NULL where the item leads itself. Items
    without edges lead.

    A round decides the items that have a leading match or none that is open. Once the matches of open items are
    ``few``, one task decides the rest in order, so that long chains of matches cost no rounds; the result is the same.
    """
    keys = [*group, "item"]
    old = F.col("old") if "old" in edges.columns else F.lit(False)
    edges = stored(edges.groupBy(*keys, "earlier").agg(F.max(old).alias("old")), "leader-edges")
    if edges.count() <= few:
        alone = edges.withColumn("their", F.when(F.col("old"), F.lit(True))).drop("old")
        return stored(_in_a_row(alone, keys, group).drop("leads"), "leader-found")
    state = edges.groupBy(*keys).agg(F.when(F.max("old"), F.lit(False)).alias("leads"))
    while True:
        state = stored(state, "leader-state")
        open_ = _open(edges, state, group)
        n = open_.count()
        if n <= few:  # also where nothing is open any more
            break
        seen = open_.groupBy(*keys).agg(F.max(F.coalesce("their", F.lit(False))).alias("hit"), F.max(F.col("their").isNull()).alias("wait"))
        # an item without any edge left has no match that leads
        decided = F.when(F.col("hit"), F.lit(False)).when(~F.coalesce("wait", F.lit(False)), F.lit(True))
        state = state.join(seen, _same(state, seen, keys), "left").select(*[state[k] for k in keys], F.coalesce("leads", decided).alias("leads"))
    if n:
        rest = stored(_in_a_row(open_, keys, group).drop("leader"), "leader-rest")
        state = stored(
            state.join(rest.withColumnRenamed("leads", "late"), _same(state, rest, keys), "left").select(*[state[k] for k in keys], F.coalesce("leads", "late").alias("leads")),
            "leader-state",
        )
    told = _told(edges, state.withColumn("leads", F.coalesce("leads", F.lit(True))), group)
    return stored(told.groupBy(*keys).agg(F.min(F.when(F.col("their"), F.col("earlier"))).alias("leader")), "leader-found")


def _same(a: DataFrame, b: DataFrame, keys: list[str]):
    """Equal keys, NULL like any other value."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _told(edges: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """The edges with ``their``: does the earlier match lead, NULL while that is open; one without edges leads."""
    known = state.select(*[F.col(k).alias(f"_{k}") for k in group], F.col("item").alias("_item"), F.col("leads").alias("_leads"), F.lit(True).alias("_listed"))
    on = F.col("earlier") == F.col("_item")
    for k in group:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    their = F.when(F.col("old") | F.col("_listed").isNull(), F.lit(True)).otherwise(F.col("_leads"))
    return edges.join(known, on, "left").select(*group, "item", "earlier", their.alias("their"))


def _open(edges: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """The told edges of items that are not decided, without those to matches that do not lead."""
    waiting = state.where("leads IS NULL").drop("leads")
    return _told(edges.join(waiting, _same(edges, waiting, [*group, "item"]), "left_semi"), state, group).where("coalesce(their, true)")


def _in_a_row(open_: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """(group..., item, leads, leader) of the open items, by one walk in the order of items; ``leader`` among their open
    matches."""
    types = ", ".join(f"{n} {t}" for n, t in open_.select(*keys).dtypes)
    names = [*keys, "earlier", "their"]

    def walk(batches):
        joined, item, leader, last = set(), None, None, None  # ``joined``: the open items that join a leader
        for batch in batches:
            out, last = [], batch
            for *g, i, e, their in zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in names]):
                here = (*g, i)
                if here != item:
                    if item is not None:
                        out.append((*item, leader is None, leader))
                        if leader is not None:
                            joined.add(item)
                    item, leader = here, None
                if leader is None and (their is True or (*g, e) not in joined):
                    leader = e  # matches come in order
            yield _rows(out, batch)
        if item is not None:
            yield _rows([(*item, leader is None, leader)], last)

    def _rows(out, like):
        columns = [pa.array([r[n] for r in out], like.schema.field(k).type) for n, k in enumerate(keys)]
        columns += [pa.array([r[-2] for r in out], pa.bool_()), pa.array([r[-1] for r in out], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "leads", "leader"])

    one = open_.withColumn("earlier", F.col("earlier").cast("bigint")).repartition(1).sortWithinPartitions("item", *group, "earlier")
    return one.mapInArrow(walk, f"{types}, leads boolean, leader bigint")
