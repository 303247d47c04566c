"""The chunk index as three tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators import chunks as C
from docketry.operators import pruned


def save_index(chunks: DataFrame, path: str, filtered: bool = True, blocks: bool = False) -> None:
    """Write ``chunks``, ``token_df`` and ``index_stats`` under ``path``, with ``blocks`` for pruned retrieval too.

    Frequencies and mean length describe the index as built; the chunk table itself
    goes through the save filter. The chunk table is written first and read back, so
    the build runs once.
    """
    chunks.write.parquet(f"{path}/built")
    built = chunks.sparkSession.read.schema(chunks.schema).parquet(f"{path}/built")
    kept = C.saved_filter(built) if filtered else built
    (pruned.with_blocks(kept) if blocks else kept).write.parquet(f"{path}/chunks")
    C.token_df(built).write.parquet(f"{path}/token_df")
    C.index_stats(built).withColumn("built_at", F.current_timestamp()).write.parquet(f"{path}/index_stats")
    if blocks:
        spark = chunks.sparkSession
        saved, stats = complete(spark.read.parquet(f"{path}/chunks")), spark.read.parquet(f"{path}/index_stats")
        pruned.block_summaries(saved, stats).write.parquet(f"{path}/blocks")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(chunks, token_df, stats)``. The number of chunks is that of the stored table."""
    chunks = complete(spark.read.parquet(f"{path}/chunks"))
    df = spark.read.parquet(f"{path}/token_df")
    stats = spark.read.parquet(f"{path}/index_stats")
    counted = chunks.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    return chunks, df, stats.withColumn("n_chunks", counted.scalar())


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Block summaries of an index that was saved with them."""
    return spark.read.parquet(f"{path}/blocks")


def complete(chunks: DataFrame, stop: tuple = tuple(L.STOP_WORDS)) -> DataFrame:
    """Recompute feature columns that are absent, or null in a row."""
    have = set(chunks.columns)

    def filled(name: str, value: Column) -> Column:
        return (F.coalesce(F.col(name), value) if name in have else value).alias(name)

    freq = X.frequencies(X.without(X.words("text"), list(stop)))
    titled = X.tokens(F.concat_ws(" ", X.blank("title"), X.blank("text")), list(stop))
    sparse = X.let(
        titled,
        lambda t: F.struct(H.buckets(t, H.SEED_A).alias("first"), H.buckets(t, H.SEED_B).alias("second")),
    )
    features = ["tokens", "token_freq", "sparse", "length", "norm"]
    rest = [c for c in chunks.columns if c not in features]
    out = chunks.select(
        *rest, *[c for c in ("length", "norm") if c in have],
        filled("tokens", X.tokens("text", list(stop))), filled("token_freq", freq), filled("sparse", sparse),
    )
    total = F.aggregate(F.map_values("token_freq"), F.lit(0), lambda s, n: s + n)
    norm = F.sqrt(H.squared_norm(F.col("sparse.first"), F.col("sparse.second"), C.SECOND_WEIGHT))
    kept_length = F.when(F.col("length") > 0, F.col("length")) if "length" in have else F.lit(None)
    return out.select(
        *rest, "tokens", "token_freq", "sparse",
        F.coalesce(kept_length, total).cast("int").alias("length"),
        (F.coalesce(F.col("norm"), norm) if "norm" in have else norm).alias("norm"),
    )


def dense_vectors(chunks: DataFrame) -> DataFrame:
    """``id, vector ARRAY<FLOAT>, norm`` for exchange with other tools."""
    return chunks.select(
        "id", H.dense(F.col("sparse.first"), F.col("sparse.second"), C.SECOND_WEIGHT).alias("vector"), "norm"
    )
