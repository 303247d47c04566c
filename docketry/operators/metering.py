"""Request metering: rate limits, request metrics, latency summary, audit tail."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import facets as A
from docketry.plans.hot import join_by_key
from docketry.plans.ordinal import pinned

AUDIT_ROWS = 3_000
TOP_PATHS = 20


def request_metrics(log: DataFrame, top_paths: int = TOP_PATHS) -> DataFrame:
    """``dimension, value, requests, avg_ms, max_ms``: the total, each method, each status
    class and the busiest path templates, from one pass with grouping sets."""
    facts = log.select(
        "method", F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")).alias("status_class"),
        A.path_template("path").alias("path_key"), "duration_ms",
    )
    groups = facts.groupingSets(
        [[], ["method"], ["status_class"], ["path_key"]], "method", "status_class", "path_key"
    ).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("requests"),
        F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
    )
    named = groups.select(
        F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "method").when(F.col("g") == 5, "status_class")
        .otherwise("path").alias("dimension"),
        F.coalesce("method", "status_class", "path_key", F.lit("")).alias("value"),
        "requests", F.round("avg_ms", 2).alias("avg_ms"), F.round("max_ms", 2).alias("max_ms"),
    )
    # Rows other than paths are groups of their own. The plain rank limit is then applied in
    # each task before the exchange, however many path templates there are.
    alone = F.when(F.col("dimension") != "path", F.col("value"))
    w = Window.partitionBy("dimension", alone).orderBy(F.desc("requests"), "value")
    return named.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= top_paths).drop("__n")


def exact_quantiles(rows: DataFrame, column: str, shares: Sequence[float], keep: int = 10_000) -> list:
    """Nearest-rank quantiles of all non-null values, None where there are none.

    Every pass is one partial aggregate over the rows: a sketch proposes a narrow range around each
    rank, and the next pass counts what lies below and inside of it, which proves the range. A range
    shrinks some thousandfold a pass; values of at most ``keep`` rows are then counted one by one.
    """
    v = F.col(column)
    n = rows.agg(F.count(v)).first()[0]
    if not n:
        return [None] * len(shares)
    ranks = [max(1, math.ceil(round(n * share, 9))) for share in shares]
    first = rows.agg(F.min(v), F.max(v)).first()
    # Per share: bounds of the value, and how many rows lie below and inside
    ranges = [(first[0], first[1], 0, n)] * len(shares)
    while any(low != high and inside > keep for low, high, _, inside in ranges):
        within = [v.between(F.lit(low), F.lit(high)) for low, high, _, _ in ranges]
        share_of = [[min(1.0, max(0.0, (rank - below) / inside + side * 2e-4)) for side in (-1, 1)]
                    for rank, (_, _, below, inside) in zip(ranks, ranges, strict=True)]
        proposed = rows.agg(*[F.percentile_approx(F.when(w, v), s, 10_000).alias(f"p{i}")
                              for i, (w, s) in enumerate(zip(within, share_of, strict=True))]).first()
        counted = rows.agg(*[c for i in range(len(ranges)) for c in (
            F.count(F.when(v < F.lit(proposed[i][0]), 1)).alias(f"b{i}"),
            F.count(F.when(v.between(F.lit(proposed[i][0]), F.lit(proposed[i][1])), 1)).alias(f"i{i}"))]).first()
        narrowed = []
        for i, (old, rank) in enumerate(zip(ranges, ranks, strict=True)):
            new = (*proposed[i], counted[f"b{i}"], counted[f"i{i}"])
            narrowed.append(new if new[2] < rank <= new[2] + new[3] else old)
        if narrowed == ranges:
            break
        ranges = narrowed
    found = []
    for (low, high, below, _), rank in zip(ranges, ranks, strict=True):
        if low == high:
            found.append(low)
            continue
        values = rows.where(v.between(F.lit(low), F.lit(high))).groupBy(v.alias("v")).agg(F.count("*").alias("c")).orderBy("v")
        for value, count in values.toLocalIterator():
            below += count
            if below >= rank:
                found.append(value)
                break
    return found


def latency_summary(log: DataFrame, column: str = "duration_ms", share: float = 0.95,
                    approximate: bool = False) -> DataFrame:
    """Average, nearest-rank percentile and maximum.

    The exact percentile comes from counting passes (see ``exact_quantiles``);
    ``approximate`` uses a sketch alone.
    """
    if approximate:
        p = F.percentile_approx(column, share, 10_000)
    else:
        p = F.lit(exact_quantiles(log, column, [share])[0]).cast(log.schema[column].dataType)
    return log.agg(F.avg(column).alias("avg"), p.alias("p95"), F.max(column).alias("max"))


def latency_quantiles(log: DataFrame, shares: Sequence[float], column: str = "duration_ms") -> DataFrame:
    """``share, value`` of several nearest-rank quantiles, found in the same passes."""
    kind = log.schema[column].dataType.simpleString()
    found = list(zip([float(s) for s in shares], exact_quantiles(log, column, shares), strict=True))
    return log.sparkSession.createDataFrame(found, f"share double, value {kind}")


def audit_tail(events: DataFrame, n: int = AUDIT_ROWS, ts: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``n`` audit rows."""
    return events.orderBy(F.desc(ts), F.desc(tie)).limit(n)


# ---- rate limits ---------------------------------------------------------------
def window_starts(times: DataFrame, window_ms: int) -> DataFrame:
    """``client, t``: the instants at which a new limiter window opens.

    A window opens at the first request at or after the end of the previous one, which is
    sequential per client. It is solved without gathering a client:

    * Time is cut into slices of one window length, so a client's slice holds at most one
      opening, and every step works on (client, slice) groups. A busy client is as many
      groups as it has slices.
    * ``step``: from each instant to the opening that would follow it, looked up in the
      next slice, or else the next slice that is not empty.
    * An instant with no request in the window before it always opens a window. From those
      anchors the chains are followed by pointer doubling: after r rounds, openings up to
      2^r steps away are known. Chains that have reached the next anchor are dropped, so
      quiet clients are finished after a round or two.
    """
    w = F.lit(window_ms)
    t = times.select("client", "t").distinct().withColumn("slice", F.floor(F.col("t") / w))
    slices = t.groupBy("client", "slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by_client = Window.partitionBy("client").orderBy("slice")
    slices = slices.select(
        "client", "slice",
        F.lag("hi").over(by_client).alias("prev_hi"),
        F.lead("slice").over(by_client).alias("next_slice"), F.lead("lo").over(by_client).alias("next_lo"),
        F.lead("lo", 2).over(by_client).alias("next_lo2"),
    )
    inside = Window.partitionBy("client", "slice").orderBy("t")
    known = pinned(t.join(slices, ["client", "slice"]).withColumn("prev", F.coalesce(F.lag("t").over(inside), "prev_hi")))
    anchors = known.filter(F.col("prev").isNull() | (F.col("t") - F.col("prev") >= w)).select("client", "t")
    # First instant at or after t + w inside the following slice, where that is not empty.
    asks = known.filter(F.col("next_slice") == F.col("slice") + 1).select(
        "client", F.col("next_slice").alias("slice"), (F.col("t") + w).alias("at"), F.lit(0).alias("kind"), "t"
    )
    offers = known.select("client", "slice", F.col("t").alias("at"), F.lit(1).alias("kind"), "t")
    # Backwards in time, so that the running minimum is incremental.
    ahead = Window.partitionBy("client", "slice").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    found = (
        asks.unionByName(offers)
        .withColumn("hit", F.min(F.when(F.col("kind") == 1, F.col("t"))).over(ahead))
        .filter(F.col("kind") == 0).select("client", "t", "hit")
    )
    adjacent = F.col("next_slice") == F.col("slice") + 1
    step = known.join(found, ["client", "t"], "left").select(
        "client", "t",
        F.when(adjacent, F.coalesce("hit", "next_lo2")).otherwise(F.col("next_lo")).alias("to"),
    ).filter(F.col("to").isNotNull())
    is_anchor = anchors.select("client", F.col("t").alias("to"))
    jump = pinned(step.join(is_anchor, ["client", "to"], "left_anti").select("client", "t", "to"))
    starts = anchors
    while not jump.isEmpty():
        reached = starts.join(jump, ["client", "t"]).select("client", F.col("to").alias("t"))
        starts = pinned(starts.unionByName(reached).distinct())
        second = jump.select("client", F.col("t").alias("to"), F.col("to").alias("to2"))
        jump = pinned(jump.join(second, ["client", "to"]).select("client", "t", F.col("to2").alias("to")))
    return starts


def rate_limit(events: DataFrame, max_requests: int, window_ms: int) -> DataFrame:
    """``client, id, ts`` to ``allowed, retry_after_ms`` with windows that open at the first
    request after expiry. Requests at one instant count in id order."""
    timed = events.select("client", "id", "ts", D.millis(events, "ts").alias("t"))
    starts = window_starts(timed, window_ms).select(
        "client", F.col("t").alias("start"), F.floor(F.col("t") / F.lit(window_ms)).alias("slice")
    )
    here = starts.withColumnRenamed("start", "here")
    before = starts.select("client", F.col("start").alias("before"), (F.col("slice") + 1).alias("slice"))
    opened = (
        timed.withColumn("slice", F.floor(F.col("t") / F.lit(window_ms)))
        .join(here, ["client", "slice"], "left").join(before, ["client", "slice"], "left")
        .withColumn("start", F.when(F.col("here") <= F.col("t"), F.col("here")).otherwise(F.col("before")))
    )
    # The last allowed request of each window. The rank limit is applied in every task
    # before the exchange, so a flooded window sends ``max_requests`` rows per task; the
    # flood itself is only compared with that one row.
    w = Window.partitionBy("client", "start").orderBy("t", "id")
    last = (
        opened.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_requests)
        .groupBy("client", "start").agg(F.max(F.struct("t", "id")).alias("last"))
    )
    sizes = opened.groupBy("client", "start").agg(F.count(F.lit(1)).alias("rows"))
    allowed = F.struct("t", "id") <= F.col("last")
    return join_by_key(opened, last.join(sizes, ["client", "start"]), ["client", "start"], "rows").select(
        "client", "id", "ts", allowed.alias("allowed"),
        F.when(allowed, F.lit(0).cast("bigint")).otherwise(
            F.greatest(F.lit(1).cast("bigint"), F.col("start") + F.lit(window_ms) - F.col("t"))
        ).alias("retry_after_ms"),
    )
