"""Nearest neighbours by largest inner product with one vantage-point tree per shard.

Inner product is turned into distance by one more coordinate: with ``top`` the largest
squared norm, ``x' = (x, sqrt(top - |x|^2))`` and ``q' = (q, 0)`` have
``|q' - x'|^2 = |q|^2 + top - 2 q.x``, so nearest by distance is largest by inner product.

Rows are dealt to shards by id hash. A shard keeps each different vector once, with its
smallest ids, and a vantage-point tree over them. A block of queries first walks to its
nearest leaf, then down the whole tree; a subtree is left out when the triangle
inequality, relaxed by ``factor``, shows that nothing nearer is in it. Factor 1 is exact
whatever the norms. Smaller ones prune more, but where norms differ the added coordinate
puts all queries far from all rows, and then they lose most neighbours.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors
of different length don't meet. Rows that repeat an id count once per different vector.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.plans.tables import stored


# Pairs scored again at once; an id behind all others.
PAIRS = 100_000
LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class VantagePoint:
    k: int = 20
    factor: float = 1.0
    leaf: int = 256
    shard_rows: int = 16_384
    query_rows: int = 2_048    # queries that meet a shard at once


def usable(vectors: DataFrame) -> DataFrame:
    """``id, vector`` (doubles) of the rows that take part, with their length ``dim``."""
    v = vectors.toDF("id", "vector").select(
        F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & fine
                   & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


class Tree:
    """A vantage-point tree over the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, top: float, leaf: int, keep: int):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = (vectors + 0.0).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
        _, first, back = np.unique(raw, return_index=True, return_inverse=True)
        back = back.ravel()
        by = np.argsort(back, kind="stable")
        edges = np.searchsorted(back[by], np.arange(len(first) + 1))
        # A vector's ids beyond the ``keep`` smallest can't be among the k nearest.
        self.ids = [np.unique(ids[by[x:y]])[:keep] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        self.single = np.array([x[0] for x in self.ids])
        self.many = np.array([len(x) > 1 for x in self.ids])
        self.vectors = vectors[first]
        lifted = np.sqrt(np.maximum(top - (self.vectors ** 2).sum(axis=1), 0))
        self.points = np.concatenate([self.vectors, lifted[:, None]], axis=1)
        self.top, self.leaf = top, leaf
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(self.points)), np.random.default_rng(len(self.points)))

    def _grow(self, rows: np.ndarray, rng) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= self.leaf:
            self.nodes[at] = ("leaf", rows)
            return at
        # Of a few candidates, the vantage point with the widest spread of distances.
        tried = rng.choice(rows, min(5, len(rows)), replace=False)
        probe = rng.choice(rows, min(200, len(rows)), replace=False)
        spread = [np.linalg.norm(self.points[probe] - self.points[t], axis=1).std() for t in tried]
        vantage = int(tried[int(np.argmax(spread))])
        distance = np.linalg.norm(self.points[rows] - self.points[vantage], axis=1)
        order = np.argsort(distance, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        bounds = tuple(float(f(distance[x])) for x in (near, far) for f in (np.min, np.max))
        inner = self._grow(rows[near], rng)
        outer = self._grow(rows[far], rng)
        self.nodes[at] = ("split", vantage, bounds, inner, outer)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Vector numbers (-1: none) and inner products of the nearest distinct vectors of every query; of
        equally near ones those with the smallest ids."""
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        square = (queries ** 2).sum(axis=1) + self.top
        found = np.full((len(queries), k), -1)
        score = np.full((len(queries), k), -np.inf)
        seen: dict[int, np.ndarray] = {}

        def scan(at: int, active: np.ndarray) -> None:
            done = seen.get(at)
            if done is not None:
                active = active[~done[active]]
            if not len(active):
                return
            seen.setdefault(at, np.zeros(len(queries), bool))[active] = True
            rows = self.nodes[at][1]
            values = queries[active] @ self.vectors[rows].T
            # All that reach the k-th score but for rounding are scored again in one fixed order of
            # summation, so that ties are decided by id and not by the shape of a matrix product.
            least = score[active].min(axis=1)
            if len(rows) > k:
                least = np.maximum(least, np.partition(values, len(rows) - k, axis=1)[:, len(rows) - k])
            q, v = np.nonzero(values >= (least - 1e-12 * square[active])[:, None])
            exact = np.empty(len(q))
            for start in range(0, len(q), PAIRS):
                part = slice(start, start + PAIRS)
                exact[part] = (self.vectors[rows[v[part]]] * queries[active[q[part]]]).sum(axis=1)
            some = np.unique(q)
            owner = np.concatenate([np.repeat(np.arange(len(some)), k), np.searchsorted(some, q)])
            number = np.concatenate([found[active[some]].ravel(), rows[v]])
            value = np.concatenate([score[active[some]].ravel(), exact])
            order = np.lexsort((np.where(number < 0, LAST, self.single[number]), -value, owner))
            place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
            kept = order[place < k]
            found[active[some]] = number[kept].reshape(-1, k)
            score[active[some]] = value[kept].reshape(-1, k)

        def descend(at: int, active: np.ndarray) -> None:
            if self.nodes[at][0] == "leaf":
                return scan(at, active)
            _, vantage, bounds, inner, outer = self.nodes[at]
            d = np.linalg.norm(lifted[active] - self.points[vantage], axis=1)
            near = d < (bounds[1] + bounds[2]) / 2
            if near.any():
                descend(inner, active[near])
            if not near.all():
                descend(outer, active[~near])

        def visit(at: int, active: np.ndarray) -> None:
            if self.nodes[at][0] == "leaf":
                return scan(at, active)
            _, vantage, (a, b, c, e), inner, outer = self.nodes[at]
            d = np.linalg.norm(lifted[active] - self.points[vantage], axis=1)
            for child, low, high in sorted(((inner, a, b), (outer, c, e)), key=lambda x: np.maximum(
                    0, np.maximum(x[1] - d, d - x[2])).sum()):
                # Slack for rounding, relative to the lifted lengths too, so that factor 1 stays exact.
                reach = np.sqrt(np.maximum(square[active] - 2 * score[active].min(axis=1), 0) + 1e-12 * square[active])
                gap = np.maximum(low - d, d - high)
                keep = gap <= factor * reach * (1 + 1e-9) + 1e-9
                if keep.any():
                    visit(child, active[keep])

        everyone = np.arange(len(queries))
        if len(self.points):
            descend(0, everyone)
            visit(0, everyone)
        return found, score

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        """``query id, id, score`` of the k nearest other rows of this shard, exact on ties."""
        # One more, as a query's own row doesn't count.
        numbers, _ = self.search(queries, k + 1, factor)
        out_q, out_id, out_s = [], [], []
        for q, vector, own in zip(query_ids, queries, numbers, strict=True):
            own = own[own >= 0]
            # One fixed order of summation: equal vectors get equal scores in every shard.
            exact = (self.vectors[own] * vector).sum(axis=1)
            if self.many[own].any():
                groups = [self.ids[x] for x in own]
                ids, exact = np.concatenate(groups), np.repeat(exact, [len(g) for g in groups])
            else:
                ids = self.single[own]
            other = ids != q
            ids, exact = ids[other], exact[other]
            order = np.lexsort((ids, -exact))[:k]
            out_q.append(np.full(len(order), q))
            out_id.append(ids[order])
            out_s.append(exact[order])
        return [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, int), (out_id, int), (out_s, float))]


def build_index(vectors: DataFrame, p: VantagePoint = VantagePoint()) -> DataFrame:
    """``dim, shard, tree``: every usable row of ``vectors`` (two columns: id, vector) is in one tree."""
    rows = usable(vectors)
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    sizes = {r.dim: (r.n, r.top) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(squares).alias("top")).collect()}
    if not sizes:
        return rows.select("dim", F.lit(0).alias("shard"), F.lit(b"").alias("tree")).limit(0)
    shards = F.create_map(*[F.lit(x) for d, (n, _) in sizes.items() for x in (d, -(-n // p.shard_rows))])
    top = F.create_map(*[F.lit(x) for d, (_, t) in sizes.items() for x in (d, float(t))])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), shards[F.col("dim")]).cast("int")).withColumn(
        "top", top[F.col("dim")])

    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        values = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        tree = Tree(table.column("id").to_numpy(), values, table.column("top")[0].as_py(), p.leaf, p.k + 1)
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": table.column("shard")[:1],
                         "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return dealt.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, tree binary")


def search(queries: DataFrame, index: DataFrame, p: VantagePoint = VantagePoint()) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest rows found for every query, without itself.

    Queries are packed into blocks; a block meets every shard of its dimension. A shard
    returns k rows per query, of which the best k by score, then id, stay.
    """
    q = usable(queries).distinct()
    counts = {r.dim: r.n for r in q.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = F.create_map(*[F.lit(x) for d, n in (counts or {0: 1}).items() for x in (d, -(-n // p.query_rows))])
    block = F.pmod(F.xxhash64("id"), blocks[F.col("dim")]).cast("int")
    packed = q.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("q"))
    shards = {r.dim: r.n for r in index.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    last = F.create_map(*[F.lit(x) for d, n in (shards or {0: 0}).items() for x in (d, n - 1)])
    # Every block goes to every shard; the trees stay where their key puts them.
    sent = packed.where(last[F.col("dim")].isNotNull()).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), last[F.col("dim")])))
    cells = sent.join(index, ["dim", "shard"]).select("tree", "q")

    def run(batches):
        last, loaded = None, None
        for batch in batches:
            for tree, own in zip(batch.column(0), batch.column(1), strict=True):
                packed_tree = tree.as_py()
                if packed_tree != last:
                    last, loaded = packed_tree, pickle.loads(packed_tree)
                ids = own.values.field(0).to_numpy()
                vectors = own.values.field(1).flatten().to_numpy().reshape(len(ids), -1)
                a, b, s = loaded.nearest(ids, vectors, p.k, p.factor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())],
                    names=["query_id", "id", "score"])

    found = cells.mapInArrow(run, "query_id bigint, id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select(
        "query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, p: VantagePoint = VantagePoint()) -> DataFrame:
    return search(queries, stored(build_index(vectors, p), "vp-trees"), p)
