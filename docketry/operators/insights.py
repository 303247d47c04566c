"""Dashboard rollups over cases and activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import facets as A
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.plans.ordinal import ranked_within, with_ordinal
from docketry.plans.tables import stored

RANGES = ["90-100%", "80-89%", "70-79%", "60-69%", "50-59%", "<50%"]
EDGE_MIN, EDGE_NEIGHBOURS = 70, 12


def _spine(spark: SparkSession, names: Sequence[str], column: str) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{column} STRING, no INT")


def similarity_histogram(cases: DataFrame) -> DataFrame:
    """Six fixed ranges, empty ones included."""
    counts = cases.groupBy(A.similarity_range("similarity").alias("range")).agg(F.count(F.lit(1)).alias("cases"))
    return _spine(cases.sparkSession, RANGES, "range").join(counts, "range", "left").select(
        "no", "range", F.coalesce("cases", F.lit(0)).alias("cases")
    )


def case_clusters(cases: DataFrame, k: int = 5) -> DataFrame:
    kind = F.coalesce(F.nullif(X.blank("type"), F.lit("")), F.lit("General"))
    return cases.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("cases")).orderBy(F.desc("cases"), "type").limit(k)


def top_topics(cases: DataFrame, k: int = 6) -> DataFrame:
    return X.exploded(cases, F.col("tags"), ["topic"]).groupBy("topic").agg(
        F.count(F.lit(1)).alias("cases")
    ).orderBy(F.desc("cases"), "topic").limit(k)


def monthly_searches(events: DataFrame, as_of, months: int = 6) -> DataFrame:
    """Searches per calendar month up to ``as_of``, months without any included."""
    last = F.date_trunc("month", F.lit(as_of).cast("timestamp")).cast("date")
    first = F.add_months(last, 1 - months)
    spine = events.sparkSession.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month")
    )
    counts = (
        events.filter((F.col("type") == "search") & (F.col("event_ts") >= first) & (F.col("event_ts") < F.add_months(last, 1)))
        .groupBy(F.date_trunc("month", "event_ts").cast("date").alias("month"))
        .agg(F.count(F.lit(1)).alias("searches"))
    )
    return spine.join(counts, "month", "left").select("month", F.coalesce("searches", F.lit(0)).alias("searches"))


def trending_topics(events: DataFrame, k: int = 5, feed: int | None = None) -> DataFrame:
    """Most searched topics and their growth from the older to the newer half of the feed.

    ``feed`` limits the input to the latest rows first; None takes all events.
    """
    searches = latest(events, feed) if feed else events
    searches = searches.filter((F.col("type") == "search") & (X.blank("title") != ""))
    placed = with_ordinal(
        searches.select("event_ts", "id", F.lower(X.trim_wide("title")).alias("topic")),
        [F.desc("event_ts"), F.desc("id")], "at",
    )
    halves = placed.withColumn("newer", F.col("at") < F.floor(placed.select(F.count(F.lit(1)).alias("n")).scalar() / 2))
    counts = halves.filter(F.col("topic") != "").groupBy("topic").agg(
        F.count(F.lit(1)).alias("searches"),
        F.count_if("newer").alias("now"), F.count_if(~F.col("newer")).alias("before"),
    )
    now = F.when(F.col("now") > 0, F.col("now")).otherwise(F.col("searches"))
    growth = F.when(F.col("before") == 0, F.lit(100)).otherwise(
        F.greatest(F.lit(0), X.round_half_up((now - F.col("before")) / F.col("before") * 100))
    )
    return counts.select(
        F.concat(F.upper(F.substring("topic", 1, 1)), F.substr("topic", F.lit(2))).alias("topic"),
        "searches", growth.cast("int").alias("growth"),
    ).orderBy(F.desc("searches"), "topic").limit(k)


def result_tiers(events: DataFrame) -> DataFrame:
    """Result counts of searches summed by tier; 5 and more is the top tier."""
    r = F.col("results")
    tier = F.when(r >= 5, RANGES[0]).when(r == 4, RANGES[1]).when(r == 3, RANGES[2]).when(r == 2, RANGES[3]).otherwise(RANGES[4])
    sums = events.filter((F.col("type") == "search") & (r > 0)).groupBy(tier.alias("range")).agg(
        F.sum(r.cast("bigint")).alias("results")
    )
    return _spine(events.sparkSession, RANGES, "range").join(sums, "range", "left").select(
        "no", "range", F.coalesce("results", F.lit(0)).alias("results")
    )


def priority_matrix(cases: DataFrame) -> DataFrame:
    """Cases per band with label, threshold and share; all bands present."""
    band = F.coalesce("priority_band", F.lit("P3"))
    labels = cases.sparkSession.createDataFrame(L.BAND_LABELS, "band STRING, label STRING, threshold INT")
    counts = cases.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("cases"))
    total = cases.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.coalesce("cases", F.lit(0))
    return labels.join(counts, "band", "left").select(
        "band", "label", "threshold", n.alias("cases"),
        F.when(total > 0, X.round_half_up(n / total * 100)).otherwise(0).alias("percent"),
    )


def severity_signals(cases: DataFrame, signals: dict[str, str] = L.SEVERITY_SIGNALS) -> DataFrame:
    """One pass over title and summary, one count per signal."""
    text = F.lower(F.concat(X.blank("title"), X.blank("summary")))
    return cases.agg(*[F.count_if(text.rlike(p)).alias(name) for name, p in signals.items()])


def group_cases(cases: DataFrame, key: Column) -> DataFrame:
    """Group sizes, largest first; ``key`` is a derived facet column."""
    return cases.groupBy(key.alias("group")).agg(F.count(F.lit(1)).alias("cases")).orderBy(F.desc("cases"), "group")


def activity_by_day(events: DataFrame) -> DataFrame:
    """Events per calendar day."""
    return events.groupBy(F.to_date("event_ts").alias("day")).agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("day"))


def activity_timeline(events: DataFrame) -> DataFrame:
    """Rows with their place in the day, newest first. Days of any size."""
    return ranked_within(
        events.withColumn("day", F.to_date("event_ts")), ["day"], [F.desc("event_ts"), F.desc("id")], "place"
    )


def valid_events(events: DataFrame) -> DataFrame:
    return events.dropna(subset=["id", "type", "title", "event_ts"]).orderBy(F.desc("event_ts"), "id")


def latest(df: DataFrame, n: int = 100, ts: str = "event_ts", tie: str = "id") -> DataFrame:
    """Newest ``n`` rows: each task keeps ``n``, one merge."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def insight_kpis(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Totals, leading topic and largest type in one row."""
    topic = trending_topics(events, 1)
    cluster = case_clusters(cases, 1)
    base = cases.agg(F.count(F.lit(1)).alias("cases_indexed"))
    searches = events.agg(F.count_if(F.col("type") == "search").alias("n")).scalar()
    return base.select(
        "cases_indexed", searches.alias("search_volume"),
        topic.select("topic").scalar().alias("top_topic"),
        cluster.select("type").scalar().alias("largest_cluster"),
        cluster.select("cases").scalar().alias("largest_cluster_cases"),
    )


def similarity_edges(cases: DataFrame, minimum: int = EDGE_MIN, k: int = EDGE_NEIGHBOURS) -> DataFrame:
    """``source, target, weight``: the ``k`` strongest neighbours of every case whose similarity reaches ``minimum``.

    The weight of an edge is the smaller similarity, equal weights go to the lower ordinal.
    A case's neighbours depend on its similarity alone, a whole number up to 100: the
    first ``k + 1`` cases of each value give the list of every value, and each case takes
    its value's list without itself. No pair of cases is formed beyond the result.
    """
    shown = cases.filter(F.col("similarity") >= minimum).select("ord", "id", "similarity")
    by_value = Window.partitionBy("similarity").orderBy("ord")
    first = shown.withColumn("__n", F.row_number().over(by_value)).filter(F.col("__n") <= k + 1).drop("__n")
    first = stored(first, "edge-heads")
    # At most 101 values, with k + 1 cases each.
    values = first.select(F.col("similarity").alias("value")).distinct()
    met = first.select("ord", "id", "similarity").join(F.broadcast(values), F.lit(True)).withColumn(
        "weight", F.least("similarity", "value"))
    best = Window.partitionBy("value").orderBy(F.desc("weight"), "ord")
    lists = met.withColumn("__n", F.row_number().over(best)).filter(F.col("__n") <= k + 1).groupBy("value").agg(
        F.array_sort(F.collect_list(F.struct("__n", "id", "weight"))).alias("near"))
    joined = shown.join(F.broadcast(lists), shown["similarity"] == lists["value"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return joined.select(F.col("id").alias("source"), F.explode(others).alias("e")).select(
        "source", F.col("e.id").alias("target"), F.col("e.weight").alias("weight"))
