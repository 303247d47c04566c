"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Every document is tokenised once and ended by one id. Longer ones are cut into pieces of
the whole capacity, the remainder first; whole pieces are sequences of their own. The
others are packed in shards of bounded size: a bin is filled greedily by the longest
piece that fits, then its smallest piece is replaced by two unpacked ones that fit its
expanded gap more tightly, and both steps repeat until the gap can't shrink.

Null and empty texts are a document of the end id alone. Rows that repeat an id are
documents of their own. No rows give no pieces.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.names import refuse, unused
from docketry.plans.tables import stored

CAPACITY = 1024
END_ID = 2
PIECES_A_SHARD = 50_000
_PIECE = "id bigint, piece int, start bigint, length bigint, ids binary"
_ODD_SPACE = re.compile(r"\s\s|\s\Z")
_WORD_AND_SIGNS = regex.compile(r"( ?\p{L}+)([^\s\p{L}\p{N}]+)")


class Encoder:
    """Token ids of whole texts, remembering those of frequent words.

    A byte-level BPE tokenizer of this family never joins across a blank or line end that
    stands alone between other characters, nor a word with the signs after it. So a text
    is the sequence of its ``" word"`` parts and line ends. Texts with any other white
    space go through the tokenizer whole.
    """

    REMEMBERED = 700_000
    LONGEST = 48
    # Words that go through the tokenizer as one text
    TOGETHER = 2_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each of the words, those of a blank and letters in one text of many, as they stand in a text anyway."""
        lettered = [x for x in words if x[:1] == " " and x[1:].isalpha()]
        known: dict[str, bytes] = {}
        for at in range(0, len(lettered), self.TOGETHER):
            part = lettered[at:at + self.TOGETHER]
            found = self.tokenizer.encode("".join(part), add_special_tokens=False)
            ids, owner = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
            starts = np.flatnonzero(np.diff(owner, prepend=-1)) * 4
            # One part of the text per word, or the tokenizer sees other letters.
            if len(starts) == len(part):
                known.update(zip(part, map(ids.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(ids)])), strict=True))
        others = [x for x in words if x not in known]
        known.update(zip(others, self.encode(others), strict=True))
        return [known[x] for x in words]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.REMEMBERED:
            self.known = {}
        parts: list[list[str] | None] = []
        for text in texts:
            if _ODD_SPACE.search(text):
                parts.append(None)
                continue
            own = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if "\x00" not in text else None
            parts.append(own)
        missing = {x for own in parts if own for x in own if x not in self.known}
        pairs = {x: m.groups() for x in missing if (m := _WORD_AND_SIGNS.fullmatch(x))}
        alone = [x for x in missing.difference(pairs).union(*pairs.values()) if x not in self.known]
        new = dict(zip(alone, self.encode_words(alone), strict=True))
        for x, (word, signs) in pairs.items():
            new[x] = (new.get(word) or self.known[word]) + (new.get(signs) or self.known[signs])
        self.known.update((k, v) for k, v in new.items() if len(k) <= self.LONGEST)
        long = {k: v for k, v in new.items() if len(k) > self.LONGEST}
        look = self.known | long if long else self.known
        whole = iter(self.encode([t for t, own in zip(texts, parts, strict=True) if own is None]))
        return [next(whole) if own is None else b"".join(map(look.__getitem__, own)) for own in parts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``id, piece, start, length, ids`` of every document (two columns: id, text).

    ``ids`` are little-endian unsigned 32-bit. A text of more than ``capacity`` ids is cut
    into pieces of that length, of which the first may be shorter.
    """
    docs = docs.toDF("id", "text").select(F.col("id").cast("bigint").alias("id"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                out = []
                texts = [t or "" for t in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        out.append((key, i, x, y - x, ids[4 * x:4 * y]))
                columns = list(zip(*out, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["id", "piece", "start", "length", "ids"])

    return docs.mapInArrow(run, _PIECE)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece of one shard."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for row in range(len(lengths) - 1, -1, -1):
        waiting[int(lengths[row])].append(row)
    count = np.bincount(lengths, minlength=capacity + 1)
    # Longest waiting length that is at most each gap; 0 where none is.
    fits = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = len(lengths)

    def take(length: int) -> None:
        count[length] -= 1
        if not count[length]:
            tail = fits[length:]
            tail[tail == length] = fits[length - 1]

    def give_back(length: int) -> None:
        count[length] += 1
        tail = fits[length:]
        np.maximum(tail, length, out=tail)

    number = 0
    while left:
        inside: list[int] = []
        gap = capacity
        while True:
            while gap and fits[gap]:
                longest = int(fits[gap])
                take(longest)
                inside.append(longest)
                gap -= longest
            if not gap:
                break
            smallest = min(inside)
            pair = _two_for(smallest, smallest + gap, count, fits)
            if pair is None:
                break
            inside.remove(smallest)
            for length in pair:
                take(length)
                inside.append(length)
            give_back(smallest)
            gap += smallest - sum(pair)
        at = 0
        for length in inside:
            row = waiting[length].pop()
            bins[row], offsets[row] = number, at
            at += length
        left -= len(inside)
        number += 1
    return bins, offsets


def _two_for(small: int, room: int, count: np.ndarray, fits: np.ndarray) -> tuple[int, int] | None:
    """Two waiting lengths with the largest sum over ``small`` and within ``room``."""
    a = np.flatnonzero(count[1:room]) + 1
    if not len(a):
        return None
    b = fits[room - a]
    alone = (b == a) & (count[a] < 2)
    b = np.where(alone, fits[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(total.argmax())
    return (int(a[best]), int(b[best])) if total[best] > small else None


def pack(pieces: DataFrame, capacity: int = CAPACITY, pieces_a_shard: int = PIECES_A_SHARD) -> DataFrame:
    """``pieces`` (with ``length``) plus ``sequence_id, offset``, which the table must not have yet.

    ``pieces`` must be a stored table: its rows are dealt to shards by position.
    """
    refuse(pieces.columns, "sequence_id", "offset")
    shard = unused(pieces.columns, "__shard")
    own = F.col("length") >= capacity
    whole = pieces.where(own).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("bigint"))
    part = pieces.where(~own)
    shards = max(1, -(-part.count() // pieces_a_shard))
    part = part.withColumn(shard, F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "id", "piece")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
        base = table.column(shard)[0].as_py() << 32
        return table.drop_columns([shard]).append_column("sequence_id", pa.array(bins + base)).append_column(
            "offset", pa.array(offsets))

    fields = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    packed = part.repartition(shards, shard).groupBy(shard).applyInArrow(
        run, f"{fields}, sequence_id bigint, offset bigint")
    return whole.unionByName(packed)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     digest: bool = False) -> DataFrame:
    """Every piece of every document (two columns: id, text) with its ids and place.

    ``digest`` keeps ``ids_crc32`` instead of the ids, for a plan without them.
    """
    pieces = token_pieces(docs, tokenizer, capacity, end_id)
    if digest:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(stored(pieces, "token-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, members``: the filled sequences; a group is at most one capacity of ids."""
    member = F.struct("offset", "id", "piece", "start", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    empty = F.lit(b"")
    return rows.select(
        "sequence_id",
        F.aggregate("m", F.lit(0).cast("bigint"), lambda n, x: n + x.length).alias("length"),
        F.aggregate("m", empty, lambda ids, x: F.concat(ids, x.ids)).alias("ids"),
        F.transform("m", lambda x: F.struct(x.id, x.piece, x.start, x.offset, x.length)).alias("members"))
