"""MinHash near-dedup with b-bit signatures.

1. Every text gives its shingle set once: a 128-bit set digest, MinHash minima, the
   low ``bits`` of each minimum packed into a signature, and one key per band.
2. Texts with equal sets form a class; only its smallest id goes on.
3. Candidates: in every band bucket each member meets a leader. Buckets are split by a
   salt, so a bucket of any size is many small ones plus one row per salt.
4. Packed signatures give a collision-corrected similarity by bit counts. Pairs whose
   estimate is more than ``slack`` deviations below the threshold go; the others are
   confirmed on the full sets.
5. Buckets that still hold several components are compared completely by signature, in
   blocks of members, which tells the components that look alike. Their members meet
   with their texts, in blocks again; exact distances to pivots and the triangle
   inequality rule out most pairs, the others are counted. Only links leave a task, and a
   bucket whose members already hang together makes no pair.

Nothing caps candidates: the only loss is a pair that shares no band, which for the
default 32 bands of 4 rows happens to one link in ten million at the threshold.

Null and empty texts have the empty set and no links. A null id has no links. Rows that
repeat an id are one node with the links of all its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.llm.graph import components
from docketry.llm.names import unused
from docketry.plans.tables import stored

# Links that one task writes in a step of the components
ROWS_A_TASK = 200_000
_SIGNED = "id bigint, hi bigint, lo bigint, n_shingles bigint, sig binary, bands array<bigint>"


@dataclass(frozen=True)
class NearDedup:
    shingle: int = 5
    percent: int = 80          # links have 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 4
    bits: int = 4              # 1, 2, 4 or 8 low bits kept of each minimum
    slack: float = 6.0         # deviations an estimate may fall short before a pair goes
    salts: int = 64
    block: int = 1024          # members of a bucket compared in one task at once

    @property
    def count(self) -> int:
        return self.bands * self.rows

    @property
    def least(self) -> float:
        """Smallest estimate with which a pair is still confirmed or ruled out on its sets."""
        s = self.percent / 100
        return s - self.slack * math.sqrt(max(s * (1 - s), 0.04) / self.count)


def pack(low: np.ndarray, bits: int) -> bytes:
    kept = (low & np.uint32((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    packed = np.zeros(len(kept) // per, np.uint8)
    for i in range(per):
        packed |= kept[i::per] << np.uint8(i * bits)
    return packed.tobytes()


def estimates(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Similarity from packed signatures (rows of bytes): equal fields by bit counts, less chance hits."""
    differ = left ^ right
    folded = differ.copy()
    for i in range(1, bits):
        folded |= differ >> np.uint8(i)
    mask = {1: 0xFF, 2: 0x55, 4: 0x11, 8: 0x01}[bits]
    unequal = np.bitwise_count(folded & np.uint8(mask)).sum(axis=-1)
    fields = left.shape[-1] * (8 // bits)
    chance = 2.0 ** -bits
    return (1 - unequal / fields - chance) / (1 - chance)


def sign(docs: DataFrame, p: NearDedup) -> DataFrame:
    """One row per document: set digest, set size, packed signature, band keys."""

    def run(batches):
        permute = W.Permutations(p.count)
        for batch in batches:
            rows = []
            for shingles in W.text_shingles(batch.column(1), p.shingle):
                if not len(shingles):
                    rows.append((0, 0, 0, None, None))
                    continue
                low = permute.minima(shingles)
                hi = int(W.mix(shingles).sum(dtype=np.uint64).astype(np.int64))
                lo = int(W.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64))
                rows.append((hi, lo, len(shingles), pack(low, p.bits),
                             W.band_keys(low, p.bands, p.rows).astype(np.int64)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()),
                 pa.array(columns[4], pa.list_(pa.int64()))],
                names=["id", "hi", "lo", "n_shingles", "sig", "bands"])

    return docs.mapInArrow(run, _SIGNED)


def star_pairs(members: DataFrame, salts: int) -> DataFrame:
    """``a, b`` (a < b): every member of a bucket with a leader, for buckets of any size.

    ``members`` has ``key, id``. Salted sub-buckets have their own leaders, and the
    leaders of a bucket (at most one per salt) meet its smallest.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    led = salted.withColumn("lead", F.min("id").over(Window.partitionBy("key", "salt")))
    inner = led.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    heads = led.where("id = lead").select("key", F.col("lead").alias("id"))
    top = heads.withColumn("lead", F.min("id").over(Window.partitionBy("key")))
    outer = top.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    return inner.union(outer).distinct()


def _likely(pairs: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """Pairs whose estimated similarity is not clearly below the threshold."""
    least = p.least
    joined = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(
        sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                           for i in (2, 3))
            keep = pa.array(estimates(left, right, p.bits) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return joined.mapInArrow(run, "a bigint, b bigint").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """``a, b, both, either``: intersection and union of the full shingle sets."""
    texts = docs.toDF("id", "text")
    joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            both, either = [], []
            for left, right in zip(W.text_shingles(batch.column(2), shingle),
                                   W.text_shingles(batch.column(3), shingle), strict=True):
                i, u = W.jaccard_counts(left, right)
                both.append(i)
                either.append(u)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())],
                names=["a", "b", "both", "either"])

    return joined.mapInArrow(run, "a bigint, b bigint, both bigint, either bigint")


def _links(pairs: DataFrame, docs: DataFrame, p: NearDedup) -> DataFrame:
    return confirmed(pairs, docs, p.shingle).where(
        (F.col("either") > 0) & (100 * F.col("both") >= p.percent * F.col("either")))


def _runs(batches, keys):
    """Tables of whole runs of equal ``keys``, and where their runs start, from a sorted stream."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        cell = np.stack([held.column(c).to_numpy() for c in keys])
        cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield held.slice(0, int(cuts[-1])), [0, *cuts[:-1].tolist()]
            held = held.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield held, [0]


def _cells(members: DataFrame, key: str, block: int) -> DataFrame:
    """Members of a group dealt to (block, block) cells ``i, j``: every pair of a group meets in one.

    A group of at most ``block`` members is one cell; no cell holds more than about twice as many.
    """
    sizes = stored(members.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "near-sizes")
    mine = members.join(sizes, key).withColumn(
        "mine", F.pmod(F.xxhash64("id"), F.col("blocks").cast("bigint")).cast("int"))
    cells = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop(
        "mine", "other", "blocks")


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _dealt(cells: DataFrame, *keys: str) -> DataFrame:
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, *keys).sortWithinPartitions(*keys, "id")


def _open(members: DataFrame, roots: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """``id, root, other``: members that look like one of another component in a shared bucket.

    Cells compare signatures only and return each such member once, with one component of
    those that look alike in the cell: a row per member, not one per pair.
    """
    placed = stored(
        members.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .select("key", "id", F.coalesce("root", "id").alias("root")), "near-placed")
    still = stored(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"))
                   .where("x < y").select("key"), "near-open")
    cells = _cells(placed.join(still, "key", "left_semi"), "key", p.block)
    cells = _dealt(cells.join(sigs.select("id", "sig"), "id").select("key", "i", "j", "id", "root", "sig"), "key", "i", "j")
    least = p.least

    def run(batches):
        for table, bounds in _runs(batches, ("key", "i", "j")):
            ids, root, sig = table.column("id").to_numpy(), table.column("root").to_numpy(), _bytes(table.column("sig"))
            rows, heads = [], []
            for x, y in zip(bounds, [*bounds[1:], len(ids)], strict=True):
                # Alike members of different components share a label, that of a component's first.
                own, hit = root[x:y], np.zeros(y - x, bool)
                _, label = np.unique(own, return_inverse=True)
                for row in range(y - x - 1):
                    apart = np.flatnonzero(own[row + 1:] != own[row]) + row + 1
                    if len(apart):
                        apart = apart[estimates(sig[x + row][None, :], sig[x + apart], p.bits) >= least]
                    if len(apart):
                        hit[row] = hit[apart] = True
                        joined = np.unique(label[[row, *apart]])
                        if len(joined) > 1:
                            label[np.isin(label, joined)] = joined[0]
                rows.append(x + np.flatnonzero(hit))
                first = np.full(len(label), len(label))
                np.minimum.at(first, label, np.arange(len(label)))
                heads.append(own[first[label[hit]]])
            rows, heads = np.concatenate(rows), np.concatenate(heads)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(root[rows]), pa.array(heads)],
                                                 names=["id", "root", "other"])

    return cells.mapInArrow(run, "id bigint, root bigint, other bigint").distinct()


def _late_links(near: DataFrame, docs: DataFrame, sigs: DataFrame, p: NearDedup) -> DataFrame:
    """``a, b``: links between components, enough to join all that belong together.

    Components that look alike form clusters; the members of a cluster meet in cells with
    their texts. Jaccard distance obeys the triangle inequality, so exact distances to a
    few pivots rule out most pairs; all others are counted on the full sets. Pairs of
    components that a link has joined already are passed over.
    """
    clusters = components(near.select(F.col("root").alias("u"), F.col("other").alias("v")), ROWS_A_TASK)
    members = stored(near.select("id", "root").distinct().join(
        clusters.select(F.col("node").alias("root"), F.col("root").alias("cluster")), "root"), "near-clusters")
    cells = _cells(members, "cluster", p.block).join(docs.toDF("id", "text"), "id").join(sigs.select("id", "sig"), "id")
    cells = _dealt(cells.select("cluster", "i", "j", "id", "root", "sig", "text"), "cluster", "i", "j")
    least, far, shingle = p.least, 1 - p.percent / 100, p.shingle

    def run(batches):
        for table, bounds in _runs(batches, ("cluster", "i", "j")):
            found = []
            for x, y in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
                found.extend(links(table.slice(x, y - x)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    def links(cell):
        ids, root, sig = cell.column("id").to_numpy(), cell.column("root").to_numpy(), _bytes(cell.column("sig"))
        sets = list(W.text_shingles(cell.column("text"), shingle))
        group = {r: r for r in root.tolist()}

        def top(r):
            while group[r] != r:
                r = group[r]
            return r

        _, pivots = np.unique(root, return_index=True)
        away = np.array([[1 - jaccard(sets[v], s) for s in sets] for v in pivots[:8]])
        for row in range(len(ids) - 1):
            other = np.flatnonzero(root[row + 1:] != root[row]) + row + 1
            if not len(other):
                continue
            other = other[np.abs(away[:, other] - away[:, row:row + 1]).max(axis=0) <= far + 1e-9]
            other = other[estimates(sig[row][None, :], sig[other], p.bits) >= least]
            for at in other.tolist():
                a, b = top(int(root[row])), top(int(root[at]))
                if a == b:
                    continue
                both, either = W.jaccard_counts(sets[row], sets[at])
                if either and 100 * both >= p.percent * either:
                    group[max(a, b)] = min(a, b)
                    yield int(ids[row]), int(ids[at])

    def jaccard(left, right):
        both, either = W.jaccard_counts(left, right)
        return both / either if either else 1.0

    return cells.mapInArrow(run, "a bigint, b bigint")


def near_components(docs: DataFrame, p: NearDedup = NearDedup()) -> DataFrame:
    """One row per row of ``docs`` (two columns: id, text): ``id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id reachable by links, ``kept`` marks the row whose
    id it is. A row without id has no component and is kept.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text")
    signed = stored(sign(docs, p), "near-signed")
    full = signed.where("id is not null and n_shingles > 0")
    classes = stored(full.groupBy("hi", "lo").agg(F.min("id").alias("rep")), "near-classes")
    heads = stored(
        full.join(classes.select("hi", "lo", F.col("rep").alias("id")), ["hi", "lo", "id"], "left_semi")
        .dropDuplicates(["hi", "lo"]).select("id", "sig", "bands"), "near-heads")
    sigs = heads.select("id", "sig")
    members = heads.select(F.explode("bands").alias("key"), "id")
    pairs = stored(_likely(star_pairs(members, p.salts), sigs, p), "near-pairs")
    texts = docs.where("id is not null")
    links = stored(_links(pairs, texts, p), "near-links")
    roots = stored(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), ROWS_A_TASK), "near-roots")
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    crowded = members.join(stored(shared, "near-shared"), "key", "left_semi")
    near = stored(_open(crowded, roots, sigs, p), "near-alike")
    more = stored(_late_links(near, texts, sigs, p), "near-links")
    repeated = _repeated_ids(full, classes)
    stars = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
    edges = stars.union(more.select(F.col("a").alias("u"), F.col("b").alias("v"))).union(repeated)
    roots = stored(components(edges, ROWS_A_TASK), "near-roots")
    rows = signed.select("id", "hi", "lo", "n_shingles").join(classes, ["hi", "lo"], "left").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return rows.select(
        "id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("root", "rep", "id")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _repeated_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several rows with different sets."""
    twice = full.groupBy("id").agg(F.min("hi").alias("x"), F.max("hi").alias("y")).where("x < y").select("id")
    reps = full.select("id", "hi", "lo").join(twice, "id", "left_semi").join(classes, ["hi", "lo"])
    return reps.where("rep <> id").select(F.col("id").alias("u"), F.col("rep").alias("v"))


def keep_one(docs: DataFrame, p: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each near-duplicate group, all columns as they are.

    Identical rows that repeat a kept id count as copies: one of them stays.
    """
    name, n = unused(docs.columns, "__gone"), unused(docs.columns, "__n")
    gone = near_components(docs.select(id_col, text_col), p).where("not kept").select(F.col("id").alias(name))
    left = docs.join(gone.distinct(), F.col(id_col) == F.col(name), "left_anti")
    doubled = stored(left.groupBy(id_col).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(id_col), "near-doubled")
    single = left.join(doubled, id_col, "left_anti")
    return single.unionByName(left.join(doubled, id_col, "left_semi").dropDuplicates()).select(*docs.columns)
