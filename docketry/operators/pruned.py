"""Retrieval from a stored index that scores only the blocks of chunks a query can need.

``save_index(..., blocks=True)`` files the chunks in blocks of neighbours (by type, then ingest
order) and writes one summary row per block: its tokens with the largest BM25 impact any chunk gives
them, the largest share any chunk's unit vector has in each dimension, and the largest section weight.
A summary bounds the score of every chunk of its block from above.

1. Summaries are scored in their tasks, and the best few blocks of every query are its seeds.
2. The chunks of the seeds are scored; a query's k-th best score is its floor.
3. Only blocks whose bound reaches the floor are scored besides. The chunk table meets a bit per query
   and block, so token maps stay where they are as long as these bits can be broadcast.

The result equals that of scoring every chunk. Queries are packed in parts of ``max_queries``, each a
run of its own. ``report`` tells how many blocks each query scored and skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import hashing as H
from docketry.operators import bm25 as M
from docketry.operators import chunks as C
from docketry.operators import retrieve as R
from docketry.plans import blocks as P
from docketry.plans.tables import stored

# Chunks of a block as a power of two, blocks scored first
BLOCK_BITS = 6
SEED_BLOCKS = 3
# Pairs of row and query scored per pair that is asked for, before blocks are scored one by one; bytes of lists that are broadcast
IN_VAIN, LISTS_BYTES = 4, 64 << 20


@dataclass(frozen=True)
class Pruned:
    hits: DataFrame
    report: DataFrame


def with_blocks(chunks: DataFrame, order: Sequence[str] = ("type", "ord"), bits: int = BLOCK_BITS) -> DataFrame:
    """Sort the table and number runs of ``2 ** bits`` rows. Write the result before it is read twice."""
    keys = [F.col(c) for c in order if c in chunks.columns]
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = chunks.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return placed.withColumn("block", F.shiftright(F.monotonically_increasing_id(), bits))


def block_summaries(chunks: DataFrame, stats: DataFrame) -> DataFrame:
    """``block, rows, tokens, tops, peaks, weight`` of a chunk table with a ``block`` column.

    A group is a block, so it has a bounded number of chunks.
    """
    weights = F.lit(R.OTHER_SECTION)
    if "section" in chunks.columns:
        for name, weight in R.SECTION_WEIGHTS.items():
            weights = F.when(F.col("section") == name, weight).otherwise(weights)
    rows = chunks.select(
        "block", "length", F.map_keys("token_freq").alias("terms"), F.map_values("token_freq").alias("tfs"),
        F.col("sparse.first").alias("first"), F.col("sparse.second").alias("second"), weights.alias("weight"),
        stats.select("avg_chunk_length").scalar().alias("mean"))
    schema = ("block bigint, rows int, tokens array<string>, tops array<double>, peaks array<double>, weight double")

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["terms"].map(len).to_numpy()
        tf = np.concatenate([*group["tfs"], np.empty(0)]).astype(float)
        length = np.repeat(np.maximum(1.0, group["length"].to_numpy(float)), sizes)
        impact = tf * (M.K1 + 1) / (tf + M.K1 * (1 - M.B + M.B * length / max(1.0, float(group["mean"].iloc[0]))))
        codes, tokens = pd.factorize(np.concatenate([*group["terms"], np.empty(0, object)]))
        tops = np.zeros(len(tokens))
        np.maximum.at(tops, codes, impact)
        vectors = P.hashed_matrix(list(group["first"]), list(group["second"]), C.SECOND_WEIGHT, H.DIMS)
        norms = np.sqrt((vectors * vectors).sum(1))[:, None]
        units = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
        return pd.DataFrame([{
            "block": group["block"].iloc[0], "rows": len(group), "tokens": list(tokens), "tops": tops,
            "peaks": units.max(0), "weight": float(group["weight"].max())}])

    return rows.groupBy("block").applyInPandas(summary, schema)


# ---- scores and their bounds ---------------------------------------------------
def bm25_bounds(state: dict, blocks: P.Rows, floors: np.ndarray | None = None) -> np.ndarray:
    total, found = M.lexical_sums(state, blocks, lambda row, top: top)
    return np.where(found > 0, total, -np.inf)


def hybrid_bounds(state: dict, blocks: P.Rows, floors: np.ndarray | None = None) -> np.ndarray:
    """Upper bound of ``retrieve.score_rows``: phrases, references and titles count as found."""
    lexical, found = M.lexical_sums(state, blocks, lambda row, top: top)
    shape = lexical.shape
    row, query, _, _ = M.token_hits(blocks, state["exact"], state["exact_of"])
    exact = P.add_up(row, query, shape) / state["n_tokens"]
    norms = np.sqrt((state["vectors"] ** 2).sum(1))[:, None]
    units = np.divide(state["vectors"], norms, out=np.zeros_like(state["vectors"]), where=norms > 0)
    cosine = np.minimum(1.0, np.stack(list(blocks["peaks"])) @ units.T) if len(blocks) else np.zeros(shape)
    titled = (state["n_tokens"] > 0).astype(float)
    core = R.W_COSINE * cosine + R.W_BM25 * lexical / (lexical + R.BM25_HALF)
    core += R.W_KEYWORD * found / state["n_expanded"] + R.W_TITLE * titled
    raw = 1 - np.exp(-R.SHARPNESS * core) + R.W_EXACT * exact + R.most_boost(state)
    bound = np.minimum(R.SCORE_CAP, raw * blocks["weight"].to_numpy(float)[:, None])
    return np.where(bound + R.SLACK < state["min_score"], -np.inf, bound)


# Chunks and more of their columns to rows that are scored
Shaped = Callable[[DataFrame, Sequence[str]], DataFrame]


# ---- search --------------------------------------------------------------------
def _places(queries: pd.DataFrame) -> dict:
    """Place of each query in a packed frame; of equal ids the last counts."""
    return {q: i for i, q in enumerate(queries["query_id"])}


def _asked(bits: bytes, n: int) -> np.ndarray:
    """The queries of a block's list, a bit per packed query."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))


def _needed(blocks: DataFrame, packed, seeds: dict[int, list], prepare: P.Prepare, bound: P.Score) -> DataFrame:
    """``block, asked`` of every block that some query needs: its bound reaches the query's floor, and it is no seed of it."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("asked", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = packed.value
        state, floors = prepare(queries), queries["floor"].to_numpy(float)
        place = _places(queries)
        single = np.zeros(len(queries), bool)
        single[list(place.values())] = True
        step = max(1, P.SCORE_CELLS // max(1, len(queries)))
        for batch in map(P.Rows, batches):
            for part in batch.parts(step):
                bounds = bound(state, part, None)
                mask = (bounds + R.SLACK >= floors[None, :]) & np.isfinite(bounds) & single
                numbers = part["block"].to_numpy()
                for row, block in enumerate(numbers.tolist()):
                    if block in seeds:
                        mask[row, [place[q] for q in seeds[block]]] = False
                some = np.flatnonzero(mask.any(axis=1))
                bits = [row.tobytes() for row in np.packbits(mask[some], axis=1)]
                yield from P.as_batches(pd.DataFrame({"block": numbers[some], "asked": bits}), schema)

    return blocks.mapInArrow(run, schema)


def _counted(lists: DataFrame, packed, query_type: T.DataType) -> DataFrame:
    """``query_id, n``: the blocks that ask for each query, as sums of a task."""
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = packed.value
        total = np.zeros(len(queries), np.int64)
        for batch in batches:
            for bits in batch.column(0).to_pylist():
                total[_asked(bits, len(queries))] += 1
        yield from P.as_batches(pd.DataFrame({"query_id": queries["query_id"], "n": total})[total > 0], schema)

    return lists.select("asked").mapInArrow(run, schema)


def score_asked(batches: Iterator[P.Rows], queries: pd.DataFrame, prepare: P.Prepare, score: P.Score, k: int,
                carry: Sequence[str]) -> pd.DataFrame:
    """Best ``k`` rows per query among the rows whose block's list ``asked`` holds the query.

    Queries are packed for all blocks of a part together, unless most pairs of its rows and queries would be in vain.
    """
    best = P.BestRows(queries["query_id"].to_numpy(), k, carry, -1e9)
    if "floor" in queries:
        best.floor = queries["floor"].to_numpy(float).copy()
    step = max(1, P.SCORE_CELLS // max(1, len(queries)))
    known: tuple[bytes | None, dict] = (None, {})

    def scored(part: P.Rows, columns: np.ndarray) -> np.ndarray:
        nonlocal known
        if known[0] != columns.tobytes():
            known = columns.tobytes(), prepare(queries.iloc[columns].reset_index(drop=True))
        return np.round(score(known[1], part, best.floor[columns]), 9)

    for batch in batches:
        for part in batch.parts(step):
            scores = np.full((len(part), len(queries)), -np.inf)
            lists = [(members, _asked(part.arrow("asked")[int(members[0])].as_py(), len(queries))) for members in
                     pd.Series(part["block"].to_numpy()).groupby(part["block"].to_numpy(), sort=False).indices.values()]
            wanted = np.zeros(scores.shape, bool)
            for members, columns in lists:
                wanted[np.ix_(members, columns)] = True
            every = np.flatnonzero(wanted.any(axis=0))
            if len(part) * len(every) <= IN_VAIN * np.count_nonzero(wanted):
                scores[:, every] = scored(part, every)
                scores[~wanted] = -np.inf
            else:
                for members, columns in lists:
                    scores[np.ix_(members, columns)] = scored(part.take(members), columns)
            best.offer(part, scores)
    return best.result()


def _score_blocks(chunks: DataFrame, shaped: Shaped, lists: DataFrame, n_lists: int, packed, prepare: P.Prepare, score: P.Score, k: int,
                  carry: Sequence[str], query_type: T.DataType) -> DataFrame:
    """Best ``k`` rows per query and task among the rows of the blocks that the query asks for."""
    schema = T.StructType([T.StructField("query_id", query_type), *[chunks.schema[c] for c in carry],
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from P.as_batches(score_asked(map(P.Rows, batches), packed.value, prepare, score, k, carry), schema)

    # A bit per query keeps the lists short, so the rows stay where they are.
    short = n_lists * (64 + len(packed.value) // 8) <= LISTS_BYTES
    # Only chunks of asked blocks get the columns that scores read.
    return shaped(chunks.join(F.broadcast(lists) if short else lists, "block"), ["block", "asked"]).mapInArrow(run, schema)


def _top(scored: DataFrame, limits: DataFrame) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("ord"))
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked.join(F.broadcast(limits), "query_id").where("rank <= limit")


def search(features: DataFrame, chunks: DataFrame, shaped: Shaped, blocks: DataFrame, prepare: P.Prepare, score: P.Score, bound: P.Score,
           k: int, carry: Sequence[str], max_queries: int = P.MAX_QUERIES, seeds: int = SEED_BLOCKS) -> Pruned:
    """Best ``limit`` rows per query (a column of ``features``, at most ``k``): ``query_id, *carry, score, rank, limit``.

    ``shaped`` gives chunks the columns that ``score`` reads, ``blocks`` has ``block`` and what ``bound`` reads.
    """
    features = stored(features, "asked")
    parts = math.ceil(max(1, features.count()) / max_queries)
    if parts > 1:
        in_part = F.pmod(F.xxhash64("query_id"), F.lit(2 * parts))
        found = [search(features.where(in_part == p), chunks, shaped, blocks, prepare, score, bound, k, carry, max_queries, seeds)
                 for p in range(2 * parts)]
        return Pruned(reduce(DataFrame.unionAll, [f.hits for f in found]), reduce(DataFrame.unionAll, [f.report for f in found]))
    context = chunks.sparkSession.sparkContext
    query_type = features.schema["query_id"].dataType
    limits = features.select("query_id", "limit")
    first = P.top_rows(blocks.withColumn("ord", F.col("block")), features, prepare, bound, seeds, ["ord"], floor=-1e9,
                       max_queries=2 * max_queries)
    first = stored(first.select(F.col("ord").alias("block"), "query_id"), "seeds")
    packed = context.broadcast(features.toPandas())
    place = _places(packed.value)
    seeded: dict[int, list] = {}
    # At most ``seeds`` blocks per query.
    for block, query in first.select("block", "query_id").toPandas().itertuples(index=False):
        seeded.setdefault(int(block), []).append(query)
    lists = []
    for block, asking in seeded.items():
        mask = np.zeros(len(packed.value), bool)
        mask[[place[q] for q in asking]] = True
        lists.append((block, bytearray(np.packbits(mask).tobytes())))
    asked = chunks.sparkSession.createDataFrame(lists, "block bigint, asked binary")
    scored = stored(_score_blocks(chunks, shaped, asked, len(lists), packed, prepare, score, k, carry, query_type), "seed-scores")
    floors = _top(scored, limits).where(F.col("rank") == F.col("limit")).select("query_id", F.col("score").alias("floor"))
    limited = features.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-1e9)))
    raised = context.broadcast(limited.toPandas())
    needed = stored(_needed(blocks, raised, seeded, prepare, bound), "needed")
    rest = _score_blocks(chunks, shaped, needed, needed.count(), raised, prepare, score, k, carry, query_type)
    hits = _top(scored.unionByName(rest), limits)
    counted = first.select("query_id", F.lit(1).cast("bigint").alias("n")).unionByName(
        _counted(needed, raised, query_type)).groupBy("query_id").agg(F.sum("n").alias("scored"))
    report = limits.join(F.broadcast(counted), "query_id", "left").select(
        "query_id", F.coalesce("scored", F.lit(0)).alias("scored"),
        (blocks.agg(F.count("*").alias("n")).scalar() - F.coalesce("scored", F.lit(0))).alias("skipped"))
    return Pruned(hits, report)


def bm25_top(query_tokens: DataFrame, chunks: DataFrame, df: DataFrame, stats: DataFrame, blocks: DataFrame, k: int,
             max_queries: int = P.MAX_QUERIES) -> Pruned:
    """Best ``k`` chunks of every query by BM25, equal scores by ingest order: ``query_id, ord, id, score, rank``.

    ``query_tokens`` has one row per query and distinct token.
    """
    features = M.token_features(query_tokens, df, stats).withColumn("limit", F.lit(k))
    return search(features, chunks, M.scored_rows, _as_rows(blocks), M.prepare_tokens, M.score_rows, bm25_bounds, k, ["ord", "id"], max_queries)


def candidate_pool(queries: DataFrame, chunks: DataFrame, df: DataFrame, stats: DataFrame, blocks: DataFrame,
                   rules: R.QueryRules = R.QueryRules(), default_k: int = 4, default_min: float = 0.22,
                   max_queries: int = P.MAX_QUERIES) -> Pruned:
    """``retrieve.candidate_pool`` by blocks: the same rows and columns."""
    features = R.with_rarity(R.query_features(queries, rules, default_k, default_min), df, stats).withColumn(
        "limit", F.greatest(F.col("top_k") * 6, F.lit(24)))
    found = search(features, chunks, R.scored_rows, _as_rows(blocks), R.prepare_queries, R.score_rows, hybrid_bounds, R.POOL_MAX, ["ord"],
                   max_queries)
    pool = found.hits.join(F.broadcast(features.select("query_id", "top_k")), "query_id")
    return Pruned(R.with_chunks(pool, chunks), found.report)


def _as_rows(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({"tokens": "terms", "tops": "tfs"})
