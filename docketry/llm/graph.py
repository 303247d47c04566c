"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.plans.tables import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rows_a_task: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u, v``); root is the smallest node reachable.

    Alternating large-star and small-star steps: every node's links are moved to the
    smallest neighbour until only stars are left. A step is one partial minimum per
    node and one join with the stored minima, so adaptive execution can split a hub.
    No links give no rows; a link of a node with itself gives that node. ``rows_a_task``
    writes the steps in as many files as their counted rows need, rather than one a partition.
    """

    def kept(rows: DataFrame, name: str, most: int) -> DataFrame:
        return stored(rows if rows_a_task is None else rows.coalesce(max(1, -(-most // rows_a_task))), name)

    loops = edges.where("u = v").select("u", "v")
    now = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(loops).distinct(),
        "links",
    )
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "links-low", 2 * state[0])
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = kept(large.where("u >= v").distinct(), "links-large", 2 * state[0])
        low = kept(large.groupBy("u").agg(F.min("v").alias("low")), "links-low", 2 * state[0])
        moved = large.join(low, "u")
        small = moved.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(
            low.select("u", F.col("low").alias("v"))).distinct()
        now = kept(small, "links", 2 * state[0])
        before, state = state, _state(now)
        if before == state:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))
