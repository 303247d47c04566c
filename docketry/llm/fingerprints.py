"""Document fingerprints: MinHash over word shingles, with banded near-pair search.

A fingerprint is the 16 low bits of the minima of ``permutations`` universal hash
permutations, as hex. Likeness of two fingerprints is the share of equal fields. Equal
texts have equal fingerprints; null and empty texts have that of the empty set (all
``f``), which is like itself.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.graph import components
from docketry.llm.near_dedup import NearDedup, pack, star_pairs
from docketry.llm.near_dedup import _late_links as late_links
from docketry.llm.near_dedup import _likely as likely
from docketry.llm.near_dedup import _open as open_members
from docketry.plans.hot import join_by_key
from docketry.plans.sizing import fits
from docketry.plans.tables import stored

# Id ranges of one sort; each gives one short row to the driver and to the tasks.
MOST_RANGES = 20_000
# Ids that may be broadcast.
FEW = 500_000
# Links that one task takes in a step of the components.
ROWS_A_TASK = 200_000


@dataclass(frozen=True)
class Fingerprints:
    shingle: int = 5
    permutations: int = 128
    rows: int = 4              # permutations in a band
    percent: int = 80          # near pairs have 100 * intersection >= percent * union
    salts: int = 64


def fields(minima: np.ndarray) -> bytes:
    """The 16 low bits of every minimum, big-endian."""
    return (minima & np.uint32(0xFFFF)).astype(">u2").tobytes()


def fingerprint(minima: np.ndarray) -> str:
    return fields(minima).hex()


def likeness(left: str | bytes, right: str | bytes) -> float:
    """Share of equal 16-bit fields of two fingerprints."""
    a, b = (np.frombuffer(bytes.fromhex(x) if isinstance(x, str) else x, ">u2") for x in (left, right))
    return float((a == b).mean())


def _minima(texts: list[str], p: Fingerprints, permute: W.Permutations) -> list[np.ndarray]:
    return [permute.minima(s) for s in W.text_shingles(pa.array(texts, pa.large_string()), p.shingle)]


def _prints(docs: DataFrame, p: Fingerprints) -> DataFrame:
    """``id, low, digest, full``: the fields and the digest of the shingle set, as bytes, and whether it has any."""

    def run(batches):
        permute = W.Permutations(p.permutations)
        for batch in batches:
            low, digests, full = [], [], []
            for shingles in W.text_shingles(batch.column(1), p.shingle):
                low.append(fields(permute.minima(shingles)))
                digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                full.append(len(shingles) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(low, pa.binary()), pa.array(digests, pa.binary()), pa.array(full, pa.bool_())],
                names=["id", "low", "digest", "full"])

    return docs.mapInArrow(run, "id bigint, low binary, digest binary, full boolean")


def fingerprint_documents(docs: DataFrame, p: Fingerprints = Fingerprints()) -> DataFrame:
    """``id, fingerprint, digest`` for every row of ``docs`` (two columns: id, text).

    ``digest`` identifies the shingle set. Both are lower-case hex.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text")
    return _prints(docs, p).select("id", F.lower(F.hex("low")).alias("fingerprint"), F.lower(F.hex("digest")).alias("digest"))


def _members(heads: DataFrame, p: Fingerprints) -> DataFrame:
    """``key, id``: the bands of every fingerprint, taken from its fields when they are needed."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for key, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                minima = np.frombuffer(low, ">u2").astype(np.uint32)
                keys.append(W.band_keys(minima, p.permutations // p.rows, p.rows).astype(np.int64))
                ids.append(key)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, p.permutations // p.rows), pa.int64())], names=["key", "id"])

    return heads.select("id", "low").mapInArrow(run, "key bigint, id bigint")


def _signatures(heads: DataFrame, p: NearDedup) -> DataFrame:
    """``id, sig``: the low bits of fingerprints, packed."""

    def run(batches):
        for batch in batches:
            minima = (np.frombuffer(x, ">u2").astype(np.uint32) for x in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([pack(x, p.bits) for x in minima], pa.binary())], names=["id", "sig"])

    return heads.select("id", "low").mapInArrow(run, "id bigint, sig binary")


def _of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given distinct ids; the others stay where they are while the ids are few."""
    return rows.join(F.broadcast(ids) if fits(ids, FEW) else ids, "id", "left_semi")


def near_pairs(docs: DataFrame, p: Fingerprints = Fingerprints()) -> DataFrame:
    """``a, b, likeness, jaccard`` (a < b) of near-duplicate texts found by signature bands.

    Texts with equal shingle sets are one node, its smallest id (``memberships`` gives
    the others). In a band bucket every node meets the leader of its salted part and
    these leaders meet each other's smallest, so a bucket of n nodes gives less than 2n
    pairs; all are verified on the full sets. Buckets that still hold several components
    are then compared completely in cells (``near_dedup``), and links between components
    are added. Near nodes that share a bucket are thus always connected by links, though not
    each by a link of its own.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text")
    return _near_pairs(docs, stored(_prints(docs, p), "fingerprints"), p)


def _near_pairs(docs: DataFrame, prints: DataFrame, p: Fingerprints) -> DataFrame:
    nodes = _nodes(prints)
    # Repeated rows of a node are alike.
    heads = prints.where("full").join(nodes.select("digest", F.col("node").alias("id")), ["digest", "id"], "left_semi").select(
        "id", "low").distinct()
    heads = stored(heads, "fingerprint-heads")
    rest = NearDedup(shingle=p.shingle, percent=p.percent, bands=p.permutations // p.rows, rows=p.rows, salts=p.salts)
    sigs = stored(_signatures(heads, rest), "fingerprint-signatures")
    members = _members(heads, p)
    # Bands that one document has alone lead nowhere.
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "fingerprint-shared")
    members = stored(members.join(shared, "key", "left_semi"), "fingerprint-members")
    pairs = stored(likely(star_pairs(members, p.salts), sigs, rest), "fingerprint-likely")
    found = stored(_verified(pairs, docs, heads, p), "fingerprint-pairs")
    roots = stored(components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), ROWS_A_TASK), "fingerprint-roots")
    near = stored(open_members(members, roots, sigs, rest), "fingerprint-alike")
    alike = stored(near.select("id").distinct(), "fingerprint-open")
    late = stored(late_links(near, _of_ids(docs.where("id is not null"), alike), sigs, rest).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "fingerprint-late")
    return found.unionByName(_verified(late, docs, heads, p)).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, heads: DataFrame, p: Fingerprints) -> DataFrame:
    """Pairs ``a, b`` whose full sets are near, with their likenesses."""
    ids = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "fingerprint-ids")
    full = _of_ids(docs, ids).join(_of_ids(heads, ids), "id").select("id", "text", "low")
    joined = pairs.join(full.toDF("a", "ta", "fa"), "a").join(full.toDF("b", "tb", "fb"), "b").select(
        "a", "b", "ta", "tb", "fa", "fb")

    def run(batches):
        for batch in batches:
            like, exact = [], []
            sets = zip(W.text_shingles(batch.column(2), p.shingle), W.text_shingles(batch.column(3), p.shingle),
                       batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            for left, right, fa, fb in sets:
                both, either = W.jaccard_counts(left, right)
                like.append(likeness(fa, fb))
                exact.append(both / either if 100 * both >= p.percent * either else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(like, pa.float64()), pa.array(exact, pa.float64())],
                names=["a", "b", "likeness", "jaccard"])

    return joined.mapInArrow(run, "a bigint, b bigint, likeness double, jaccard double").where("jaccard is not null")


def _nodes(prints: DataFrame) -> DataFrame:
    """``digest, node, n``: the smallest id of every shingle set, and how many ids have it."""
    known = prints.where("id is not null").select("id", "digest").distinct()
    return stored(known.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("n")), "fingerprint-nodes")


def memberships(prints: DataFrame) -> DataFrame:
    """``id, node``: node is the smallest id with the same shingle set. Rows without id take no part."""
    known = prints.where("id is not null").select("id", "digest").distinct()
    return join_by_key(known, _nodes(prints), ["digest"], "n").select("id", "node")


def near_classes(docs: DataFrame, p: Fingerprints = Fingerprints()) -> DataFrame:
    """``id, class_id, n_links`` for every id with a text of ``docs`` (two columns: id, text).

    ``class_id`` is the smallest id reachable by equal shingle sets and near pairs,
    ``n_links`` the number of near pairs that the id's nodes have.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text")
    prints = stored(_prints(docs, p), "fingerprints")
    pairs = stored(_near_pairs(docs, prints, p), "fingerprint-links").select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = prints.where("id is not null and full").select("id", "digest").distinct()
    nodes = _nodes(prints.where("full"))
    # An id with several shingle sets connects their nodes.
    twice = known.groupBy("id").agg(F.count("*").alias("sets")).where("sets > 1").select("id")
    own = known.join(twice, "id", "left_semi").join(nodes, "digest").where("id <> node").select("id", "node")
    roots = components(pairs.union(own), ROWS_A_TASK).withColumnRenamed("root", "class_id")
    links = pairs.union(pairs.select("v", "u")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_links"))
    told = nodes.join(roots, "node", "left").join(links, "node", "left").select(
        "digest", "n", F.coalesce("class_id", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return join_by_key(known, told, ["digest"], "n").groupBy("id").agg(
        F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def _compressed(batches):
    """The rows, and their text as bytes of a Zstandard frame."""
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [zstd.compress(x.encode()) for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], [*batch.schema.names, "packed"])


HEXED = ("edited_sha256", "fingerprint", "edited_fingerprint")


def hexed(edits: DataFrame) -> DataFrame:
    """The digests and fingerprints of ``edit_next`` as lower-case hex."""
    return edits.withColumns({c: F.lower(F.hex(c)) for c in HEXED})


def edit_next(docs: DataFrame, p: Fingerprints = Fingerprints(), rows_a_range: int = 4000, raw: bool = False) -> DataFrame:
    """Every text (two columns: id, text), and the text edited with its next document's start.

    Next is the following row in descending id, and the first row after the last; rows
    that repeat an id follow each other by text hash, rows without id come last. The last
    third (rounded down) of the code points is replaced by as many, or all, first code
    points of the next text.

    Ids are cut into ranges at quantiles, so that a range is about ``rows_a_range`` rows.
    Every range is sorted in one task as a stream, with one added row: the first of the
    range after it. Only one row per range passes the driver, without its text; there are
    at most ``MOST_RANGES``, and a longer range sorts on disk. ``raw`` leaves the digests and
    fingerprints as bytes, half as long, for a join (see ``hexed``).
    """
    docs = docs.toDF("id", "text").select(
        F.col("id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    ranges = min(max(1, -(-docs.count() // rows_a_range)), MOST_RANGES)
    cuts = docs.where("id is not null").approxQuantile(
        "id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    # Range 0 has the largest ids; rows without id are in the last.
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    placed = docs.select("id", "text", F.xxhash64("text").alias("tie"),
                         F.coalesce(F.col("id").cast("double"), F.lit(-math.inf)).alias("value"))
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="value", outputCol="bucket").transform(placed)
    else:
        placed = placed.withColumn("bucket", F.lit(0.0))
    placed = placed.select("id", "text", "tie", (F.lit(len(splits) - 2) - F.col("bucket")).cast("int").alias("range"))
    order = [F.col("range"), F.col("ahead"), F.col("id").desc_nulls_last(), F.col("tie"), F.col("packed")]
    first = placed.groupBy("range").agg(
        F.min(F.struct(F.coalesce(-F.col("id"), F.lit(2**63 - 1)).alias("down"), "tie")).alias("x")).collect()
    firsts = sorted((r.range, None if r.x.down == 2**63 - 1 else -r.x.down, r.x.tie) for r in first)
    # The first row of a range is looked up again by its id and tie and sent to the range before it.
    ahead = [(firsts[i - 1][0], *firsts[i][1:]) for i in range(len(firsts))]
    sought = spark.createDataFrame(ahead, "to int, sought bigint, mark bigint")
    heads = docs.withColumn("tie", F.xxhash64("text")).join(
        F.broadcast(sought), F.col("sought").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("tie")))
    heads = heads.groupBy("to").agg(F.min("text").alias("text"), F.first("id").alias("id"), F.first("tie").alias("tie"))
    both = placed.select("range", F.lit(False).alias("ahead"), "id", "text", "tie").unionByName(
        heads.select(F.col("to").alias("range"), F.lit(True).alias("ahead"), "id", "text", "tie"))
    # Texts travel compressed, about half as long. Equal texts stay equal.
    ranged = both.mapInArrow(_compressed, "range int, ahead boolean, id bigint, text string, tie bigint, packed binary").drop("text").repartition(
        max(ranges, 1), "range").sortWithinPartitions(*order).select("range", "ahead", "id", "packed")

    def run(batches):
        permute, unpack = W.Permutations(p.permutations), zstandard.ZstdDecompressor()
        held = None      # the row whose next is not known yet: range, id, text, minima
        for batch in batches:
            where, _, ids, packed = (c.to_pylist() for c in batch.columns)
            texts = [unpack.decompress(x).decode() for x in packed]
            minima = _minima(texts, p, permute)
            done = []
            for row in zip(where, ids, texts, minima, strict=True):
                if held is not None and held[0] == row[0]:
                    done.append((held, row))
                held = row
            if done:
                yield edited(done, permute)

    def edited(done, permute):
        out = {k: [] for k in ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                               "near_edited", "near_next")}
        changed = []
        for (_, _, text, _), (_, _, after, _) in done:
            n = len(text) // 3
            changed.append(text[:len(text) - n] + after[:n])
        for ((_, key, text, own), (_, _, _, next_own)), new, low in zip(
                done, changed, _minima(changed, p, permute), strict=True):
            own, low, next_own = (x & np.uint32(0xFFFF) for x in (own, low, next_own))
            out["id"].append(key)
            out["n_chars"].append(len(text))
            out["edited_sha256"].append(hashlib.sha256(new.encode()).digest())
            out["fingerprint"].append(fields(own))
            out["edited_fingerprint"].append(fields(low))
            out["near_edited"].append(float((own == low).mean()))
            out["near_next"].append(float((own == next_own).mean()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    edits = ranged.mapInArrow(
        run, "id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
             "near_edited double, near_next double")
    return edits if raw else hexed(edits)
