"""Repeated passages by a sparse suffix array.

1. A passage of ``least`` words samples an anchor, the ``anchor`` words in it whose hash is
   smallest. The choice depends on the passage alone, so equal passages sample equal anchors.
2. Whole copies form a class, of which only the smallest id goes on, and only anchors
   met in two documents keep their suffixes.
3. The suffixes at which a passage with a kept anchor starts are grouped by their first
   ``least`` words (the anchor and a 64-bit hash of all of them). A group with two ids is
   a repeated passage; its smallest id goes back to all its rows. Neighbouring and
   overlapping passages are joined, so their union is the whole repeated passage, however
   many documents share the anchor and whatever lies around it.
4. Passages of at least ``least`` words in different documents are spans. Spans that a
   smaller document has too can be cut: one copy of every passage stays.

No task holds an anchor's or a passage's group: smallest ids are combined in every task, and
the passages of very many documents are joined by broadcast. Texts below ``least`` words, null
and empty ones have no spans. Rows without id take no part; rows that repeat an id are one
document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.names import unused
from docketry.plans.hot import join_by_key
from docketry.plans.tables import stored


# Rows of one Arrow batch of suffixes.
_ROWS = 100_000


@dataclass(frozen=True)
class SuffixDedup:
    least: int = 50            # words of the shortest passage
    anchor: int = 20
    reach: int = 8             # of no effect: all suffixes of an anchor are compared

    @property
    def window(self) -> int:
        return self.least - self.anchor + 1


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """Minimum or maximum of every ``size`` neighbouring values."""
    have, done = values, 1
    while done < size:
        step = min(done, size - done)
        have = best(have[:-step], have[step:])
        done += step
    return have


def _grams(hashes: np.ndarray, p: SuffixDedup) -> np.ndarray:
    """Hashes of every ``anchor`` neighbouring words."""
    total = len(hashes) - p.anchor + 1
    factors = W.keys(p.anchor, 31) | np.uint64(1)
    grams = np.zeros(total, np.uint64)
    for j in range(p.anchor):
        grams += hashes[j:j + total] * factors[j]
    return W.mix(grams)


def anchors(hashes: np.ndarray, p: SuffixDedup) -> np.ndarray:
    """Distinct anchors that the passages of ``least`` words of one document sample."""
    if len(hashes) < p.least:
        return np.zeros(0, np.uint64)
    return np.unique(_sliding(_grams(hashes, p), p.window, np.minimum))


def _documents(column: pa.Array):
    """Word hashes of every text."""
    data, offsets = W.text_buffers(column)
    for first, last in W.slices(offsets):
        part = offsets[first:last + 1]
        hashes, bounds, _ = W.word_hashes(data[part[0]:part[-1]], part - part[0])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield hashes[a:b]


def sampled(docs: DataFrame, p: SuffixDedup) -> DataFrame:
    """``id, hi, lo, n_words, keys``: digest of the word sequence and the distinct anchors."""

    def run(batches):
        for batch in batches:
            his, los, sizes, found = [], [], [], []
            for hashes in _documents(batch.column(1)):
                place = W._positions(len(hashes))[:len(hashes)]
                his.append(int((hashes * place).sum(dtype=np.uint64).astype(np.int64)))
                los.append(int(W.mix(hashes ^ place).sum(dtype=np.uint64).astype(np.int64)))
                sizes.append(len(hashes))
                found.append(anchors(hashes, p).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int64()))], names=["id", "hi", "lo", "n_words", "keys"])

    return docs.mapInArrow(run, "id bigint, hi bigint, lo bigint, n_words bigint, keys array<bigint>")


def windows(docs: DataFrame, p: SuffixDedup) -> DataFrame:
    """``key, window, id, at``: the suffixes of ``docs`` (id, text, keys) whose first ``least`` words hold a wanted anchor.

    ``key`` is the anchor that the first ``least`` words sample, ``window`` a hash of all of
    them; both depend on those words alone, so equal passages have equal pairs.
    """
    # Anchor-sized pieces that cover the window, the last one flush with its end.
    pieces = [*range(0, p.least - p.anchor, p.anchor), p.least - p.anchor]
    factors = W.keys(len(pieces), 37) | np.uint64(1)

    def run(batches):
        for batch in batches:
            found, held = [], 0
            for key, hashes, wanted in zip(batch.column(0).to_pylist(), _documents(batch.column(1)),
                                           batch.column(2).to_pylist(), strict=True):
                if len(hashes) < p.least:
                    continue
                grams = _grams(hashes, p)
                lowest = _sliding(grams, p.window, np.minimum)
                at = np.flatnonzero(np.isin(lowest, np.array(wanted, np.int64).astype(np.uint64)))
                value = np.zeros(len(at), np.uint64)
                for piece, factor in zip(pieces, factors, strict=True):
                    value += grams[at + piece] * factor
                found.append((lowest[at].astype(np.int64), W.mix(value).astype(np.int64),
                              np.full(len(at), key, np.int64), at.astype(np.int32)))
                held += len(at)
                if held >= _ROWS:
                    yield from told(found)
                    found, held = [], 0
            if held:
                yield from told(found)

    def told(found):
        whole = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)],
                                           names=["key", "window", "id", "at"])
        for first in range(0, whole.num_rows, _ROWS):
            yield whole.slice(first, _ROWS)

    return docs.mapInArrow(run, "key bigint, window bigint, id bigint, at int")


def _runs(places: DataFrame, p: SuffixDedup) -> DataFrame:
    """``id, spans, cuts`` from ``id, at, cut_at``: windows' first words as merged (start, end) spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def merged(column):
        out = []
        for at in column:
            at = np.unique(at.values.to_numpy(zero_copy_only=False))
            first = np.flatnonzero(np.diff(at, prepend=-p.least - 1) > p.least)
            last = np.append(first[1:], len(at)) - 1
            out.append([{"start": a, "end": b} for a, b in zip(
                at[first].tolist(), (at[last] + p.least).tolist(), strict=True)] if len(at) else [])
        return pa.array(out, kind)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), merged(batch.column(1)), merged(batch.column(2))],
                                             names=["id", "spans", "cuts"])

    spans = "array<struct<start:int,end:int>>"
    return places.select("id", "at", "cut_at").mapInArrow(run, f"id bigint, spans {spans}, cuts {spans}")


def _merged(spans: Column) -> Column:
    """Sorted non-overlapping (start, end) spans; touching ones are joined."""
    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (x["start"] <= F.try_element_at(done, F.lit(-1))["end"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    start = F.lit(None).cast("array<struct<start:int,end:int>>")
    return F.aggregate(F.array_sort(spans), F.coalesce(start, F.array().cast("array<struct<start:int,end:int>>")), step)


def repeated_passages(docs: DataFrame, p: SuffixDedup = SuffixDedup()) -> DataFrame:
    """``id, twin, spans, cuts`` for every document of ``docs`` (two columns: id, text) with a repeated passage.

    ``spans`` are (start, end) word positions of all passages that another document has
    too, ``cuts`` those that a smaller id has; ``twin`` is the smallest id found to share one.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text").where("id is not null")
    marked = stored(sampled(docs, p).where(f"n_words >= {p.least}"), "suffix-sampled")
    copies = stored(marked.groupBy("hi", "lo").agg(
        F.min("id").alias("first"), F.max("id").alias("last")).where("first < last"), "suffix-copies")
    copied = marked.select("id", "hi", "lo", "n_words").join(copies, ["hi", "lo"]).select(
        "id", F.when(F.col("id") == F.col("first"), F.col("last")).otherwise(F.col("first")).alias("twin"),
        F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"), (F.col("id") > F.col("first")).alias("cut"))
    heads = marked.join(copies, ["hi", "lo"], "left").where("first is null or id = first")
    keys = heads.select(F.explode("keys").alias("key"), "id")
    twice = stored(keys.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key"),
                   "suffix-anchors")
    wanted = keys.join(twice, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))
    rows = stored(windows(docs.join(wanted, "id").select("id", "text", "keys"), p), "suffix-windows")
    shared = rows.groupBy("key", "window").agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    matches = stored(join_by_key(rows, shared, ["key", "window"], "n").select("id", "at", "first"), "suffix-matches")
    later = matches.where("id <> first")
    twins = later.select("id", F.col("first").alias("twin")).union(later.select("first", "id"))
    span, place = F.struct("start", "end"), F.when(F.col("id") > F.col("first"), F.col("at"))
    places = matches.groupBy("id").agg(F.collect_list("at").alias("at"), F.collect_list(place).alias("cut_at"))
    whole = copied.groupBy("id").agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("cut"), span)).alias("cuts"))
    grouped = _runs(places, p).unionByName(whole).groupBy("id").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("cuts")).alias("cuts"))
    least = twins.unionByName(copied.select("id", "twin")).groupBy("id").agg(F.min("twin").alias("twin"))
    return grouped.join(least, "id").select("id", "twin", _merged(F.col("spans")).alias("spans"), _merged(F.col("cuts")).alias("cuts"))


def cut_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the cut spans taken out of the texts; all other rows and columns as they are.

    From the first word of a span up to the next word after it is removed. A text of
    which nothing but white space is left goes with its row.
    """
    key, spans = unused(docs.columns, "__id"), unused(docs.columns, "__cuts")
    cuts = found.where(F.size("cuts") > 0).select(F.col("id").alias(key), F.col("cuts").alias(spans))
    joined = docs.join(cuts, F.col(id_col) == F.col(key), "left").drop(key)
    names = docs.columns
    at = names.index(text_col)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def without(text: str, cut: list[dict]) -> str:
        data, offsets = W.text_buffers(pa.array([text], pa.large_string()))
        _, _, starts = W.word_hashes(data, offsets)
        bounds = np.append(starts, len(data))
        left, done = [], 0
        for span in cut:
            left.append(data[done:bounds[min(span["start"], len(starts))]].tobytes())
            done = bounds[min(span["end"], len(starts))]
        return b"".join([*left, data[done:].tobytes()]).decode()

    def run(batches):
        for batch in batches:
            cuts = batch.column(len(names)).to_pylist()
            columns, keep = list(batch.columns[:-1]), [True] * batch.num_rows
            if any(cuts):
                texts = columns[at].to_pylist()
                for row, cut in enumerate(cuts):
                    if cut:
                        texts[row] = without(texts[row] or "", cut)
                        keep[row] = bool(texts[row].encode().strip())
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, fields)
