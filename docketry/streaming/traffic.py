"""Streaming request metrics, activity ingest and the bounded audit buffer.

Late data: rows more than ``LATENESS`` behind the newest event time are dropped; Spark
counts them as ``numRowsDroppedByWatermark`` in the progress of the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import facets as A
from docketry.functions import text as X
from docketry.operators.metering import AUDIT_ROWS

LATENESS = "10 minutes"


def metrics_stream(log: DataFrame, length: str = "1 minute", slide: str | None = None,
                   session_gap: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Requests, mean and maximum latency per event-time window, method, status class and
    path template. Tumbling by default; sliding or session windows by parameter."""
    if session_gap:
        window = F.session_window("ts", session_gap)
    else:
        window = F.window("ts", length, slide) if slide else F.window("ts", length)
    status: Column = F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))
    return (
        log.withWatermark("ts", lateness)
        .groupBy(window.alias("w"), "method", status.alias("status_class"), A.path_template("path").alias("path_key"))
        .agg(F.count(F.lit(1)).alias("requests"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
        .select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "method", "status_class",
            "path_key", "requests", "avg_ms", "max_ms",
        )
    )


def late_sink(path: str, length: str = "1 minute", lateness: str = LATENESS, ts: str = "ts") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that counts the rows a watermark drops, as data.

    ``path/late/version=<batch>`` gets ``window_start, late`` of the rows that are further than
    ``lateness`` behind the newest event time of the batches before, as Spark's watermark sees it;
    ``path/newest/version=<batch>`` keeps that time. A batch that runs twice writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in versions_of(spark, f"{path}/newest") if v < batch_id]
        newest = spark.read.parquet(f"{path}/newest/version={before[-1]}").first()["newest"] if before else None
        if newest is not None:
            behind = batch.where(F.col(ts) < F.lit(newest) - F.expr(f"INTERVAL {lateness}"))
            behind.groupBy(F.window(ts, length).start.alias("window_start")).agg(F.count(F.lit(1)).alias("late")).write.mode(
                "overwrite").parquet(f"{path}/late/version={batch_id}")
        batch.agg(F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(
            f"{path}/newest/version={batch_id}")

    return write


def versions_of(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the ``version=`` folders under a path of any file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(x.split("=")[1]) for x in names if x.startswith("version="))


def activity_stream(source: DataFrame, lateness: str = LATENESS, title_chars: int | None = None) -> DataFrame:
    """Search, upload and view notices (``id, kind, ts, payload``) to one event schema, each
    id once within the lateness."""
    p = F.col("payload")
    text = lambda key, other: F.coalesce(F.nullif(p[key], F.lit("")), F.lit(other))
    count = lambda key: F.coalesce(
        F.regexp_extract(F.coalesce(p[key], F.lit("")), r"^\s*(-?\d+)", 1).try_cast("int"), F.lit(0)
    )
    title = (
        F.when(F.col("kind") == "search", text("query", "Search"))
        .when(F.col("kind") == "upload", text("filename", "Uploaded Document"))
        .otherwise(text("caseTitle", "Case View"))
    )
    results = F.when(F.col("kind") == "search", count("results")).when(F.col("kind") == "upload", count("matchesFound"))
    return (
        source.filter(F.col("kind").isin("search", "upload", "view") & F.col("id").isNotNull())
        .withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["id"])
        .select(
            "id", F.col("kind").alias("type"), (X.blank(title) if title_chars is None else F.substring(X.blank(title), 1, title_chars)).alias("title"),
            F.col("ts").alias("event_ts"), results.alias("results"), F.col("payload").alias("metadata"),
        )
    )


def audit_sink(path: str, n: int = AUDIT_ROWS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function keeping the newest ``n`` rows under ``path/version=<batch>``.

    A batch builds on the newest version before it, whichever that is, and then removes
    older ones; that version itself stays, so a batch that runs twice gives the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = [v for v in versions_of(spark, path) if v < batch_id]
        rows = batch
        if before:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/version={before[-1]}").unionByName(batch)
        rows.orderBy(F.desc("ts"), F.desc("id")).limit(n).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        for version in before[:-1]:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={version}"), True)

    return write
