"""BM25 of many queries over a chunk index: the best chunks per query, or every pair by joins and grouping."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators import chunks as C
from docketry.plans import blocks as P

# fixed values: BM25 constants
K1 = 1.4
B = 0.75
# Query tokens that may be broadcast at once
MAX_TOKENS = 500_000


def term_weight(tf: Column, df: Column, length: Column, n_chunks: Column, mean_length: Column) -> Column:
    rarity = F.log(F.lit(1.0) + (n_chunks - df + F.lit(0.5)) / (df + F.lit(0.5)))
    relative = F.greatest(F.lit(1), length) / F.greatest(F.lit(1.0), mean_length)
    damped = tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * relative)
    return rarity * (tf * F.lit(K1 + 1)) / damped


def bm25(query_tokens: DataFrame, chunks: DataFrame, df: DataFrame, stats: DataFrame,
         max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``query_id, ord, bm25`` for every pair with a common token.

    ``query_tokens`` has one row per query and distinct token. The document
    frequencies are joined to the query tokens, not to the postings, so postings meet
    one small hash table and tokens nobody asked for end there. Chunks are placed by
    ordinal once, as compact rows; the sum per (query, chunk) then needs no second shuffle
    and a token that sits in a third of all chunks never gathers in one task.

    The query side is counted first. Beyond ``max_tokens`` rows it is cut into blocks of
    whole queries, each of them broadcast, rather than joined on the token, where one
    common token would bring a third of the chunks together with all who ask for it.
    """
    weighted = query_tokens.join(df, "token", "left").select(
        "query_id", "token", F.coalesce("df", F.lit(0)).alias("df")
    )
    # One-row statistics are scalar subqueries on the query side, not a join.
    weighted = weighted.select(
        "*",
        stats.select("n_chunks").scalar().alias("n_chunks"),
        stats.select("avg_chunk_length").scalar().alias("avg_chunk_length"),
    )
    located = chunks.select("ord", "length", "token_freq").repartition("ord")
    weight = term_weight(F.col("tf"), F.col("df"), F.col("length"), F.col("n_chunks"), F.col("avg_chunk_length"))

    def scored(part: DataFrame) -> DataFrame:
        return (
            C.postings(located).join(F.broadcast(part), "token").groupBy("query_id", "ord").agg(F.sum(weight).alias("bm25"))
        )

    blocks = math.ceil(max(1, query_tokens.count()) / max_tokens)
    if blocks == 1:
        return scored(weighted)
    # A query lies in one block as a whole, so the blocks only need to be put together.
    in_block = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))
    return reduce(DataFrame.unionAll, [scored(weighted.filter(in_block == b)) for b in range(2 * blocks)])


def top_chunks(scores: DataFrame, chunks: DataFrame, k: int, score: str = "bm25") -> DataFrame:
    """Best ``k`` per query with chunk ids, equal scores by ingest order.

    The rank limit is applied in each task before the exchange; only the winners are
    joined back to the chunk table.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 9)), F.asc("ord"))
    top = scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(chunks.select("ord", "id"), "ord")


# ---- scores in the tasks -------------------------------------------------------
def token_features(query_tokens: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per query: its tokens, their document frequencies and the index statistics."""
    pairs = F.sort_array(F.collect_list(F.struct("token", F.coalesce("df", F.lit(0)).alias("df"))))
    return query_tokens.join(df, "token", "left").groupBy("query_id").agg(pairs.alias("pairs")).select(
        "query_id", F.col("pairs.token").alias("expanded"), F.col("pairs.df").alias("expanded_df"),
        stats.select("n_chunks").scalar().alias("n_chunks"), stats.select("avg_chunk_length").scalar().alias("mean_length"))


def scored_rows(chunks: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    return chunks.select("ord", "id", "length", F.map_keys("token_freq").alias("terms"),
                         F.map_values("token_freq").alias("tfs"), *more)


def prepare_tokens(q: pd.DataFrame) -> dict:
    rarity: dict = {}
    for tokens, counts in zip(q["expanded"], q["expanded_df"], strict=True):
        rarity.update(zip(tokens, counts, strict=True))
    n_chunks = float(q["n_chunks"].iloc[0]) if len(q) else 1.0
    words, owners = P.vocabulary(q["expanded"])
    counts = np.array([rarity[t] for t in words], float)
    return {"n": len(q), "expanded": pa.array(list(words), pa.string()), "expanded_of": owners,
            "idf": np.log(1 + (n_chunks - counts + 0.5) / (counts + 0.5)),
            "mean_length": float(max(1.0, q["mean_length"].iloc[0])) if len(q) else 1.0}


def token_hits(rows: P.Rows, words: pa.Array, owners: list) -> tuple:
    """Hits of row tokens in a query vocabulary: ``(row, query, vocabulary id, tf)``."""
    owner, terms = rows.lists("terms")
    ids = pc.fill_null(pc.index_in(terms, value_set=words), -1).to_numpy(zero_copy_only=False)
    hit = ids >= 0
    tf = rows.lists("tfs")[1].to_numpy(zero_copy_only=False)[hit].astype(float)
    owner, ids = owner[hit], ids[hit]
    at, query = P.expand(ids, owners) if len(ids) else (np.empty(0, int), np.empty(0, int))
    return owner[at], query, ids[at], tf[at]


def impacts(state: dict, rows: P.Rows) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What a term frequency counts in a row, before the rarity of the token."""
    length = np.maximum(1.0, rows["length"].to_numpy(float))
    damping = K1 * (1 - B + B * length / state["mean_length"])
    return lambda row, tf: tf * (K1 + 1) / (tf + damping[row])


def lexical_sums(state: dict, rows: P.Rows, impact: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows x queries: the sum over common tokens, and their number."""
    shape = (len(rows), state["n"])
    row, query, token, value = token_hits(rows, state["expanded"], state["expanded_of"])
    return P.add_up(row, query, shape, state["idf"][token] * impact(row, value)), P.add_up(row, query, shape)


def score_rows(state: dict, rows: P.Rows, floors: np.ndarray | None = None) -> np.ndarray:
    total, found = lexical_sums(state, rows, impacts(state, rows))
    return np.where(found > 0, total, -np.inf)


def best_chunks(query_tokens: DataFrame, chunks: DataFrame, df: DataFrame, stats: DataFrame, k: int,
                max_queries: int = P.MAX_QUERIES) -> DataFrame:
    """Best ``k`` chunks per query, equal scores by ingest order: ``query_id, ord, id, score, rank``.

    Token maps are scored where they lie; only the winners of a task are exchanged.
    """
    features = token_features(query_tokens, df, stats)
    return P.top_rows(scored_rows(chunks), features, prepare_tokens, score_rows, k, ["ord", "id"], floor=-1e9,
                      max_queries=max_queries)
