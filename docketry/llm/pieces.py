"""SentencePiece encoding and decoding by streaming Viterbi search.

The text is read once, in a window of the longest piece. Every boundary keeps the best piece
that ends there and a backpointer; pieces that start at a boundary are found by one walk down a
trie. Only the last ``longest piece`` boundaries can still be extended; as soon as their backpointer paths meet in one boundary, the ids before it are
committed and forgotten.

For a ``unigram`` model the best path has the largest sum of piece scores. A ``bpe`` model
merges the best-scored pair first, which sums of scores don't reproduce; there a path may
only join two pieces that their merge order leaves apart. One piece at each boundary then
survives, and the path is the library's own segmentation.

A character outside the vocabulary becomes its UTF-8 bytes (or ``<unk>`` without byte
pieces). Blanks are ``▁``, one of which is put before a text that isn't empty. Null and
empty texts have no ids. Decoding gives the text back, but a literal ``▁`` comes back as
a blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.names import refuse

BLANK = "▁"
WORDS = re.compile(" *[^ ]+| +")
UNKNOWN = -1


def _trie(ids: dict[str, int]) -> dict:
    """Nested dictionaries by character; the piece number of a node is under the empty string."""
    root: dict = {}
    for text, number in ids.items():
        node = root
        for character in text:
            node = node.setdefault(character, {})
        node[""] = number
    return root


# Letters and digits of the Latin script; other characters count as signs.
LETTERS = r"[A-Za-z0-9\u00c0-\u024f]"


def _borders(ids: dict[str, int]) -> re.Pattern:
    """The places between a letter and a sign that no piece holds beside one."""
    letter = re.compile(LETTERS)
    near = {BLANK, " "}
    for text in ids:
        for a, b in zip(text, text[1:]):
            if bool(letter.match(a)) != bool(letter.match(b)):
                near |= {a, b}
    near = "".join(map(re.escape, sorted(c for c in near if not letter.match(c))))
    return re.compile(rf"(?<={LETTERS})(?!{LETTERS}|[{near}])(?=.)|(?<!{LETTERS})(?<![{near}])(?<=.)(?={LETTERS})", re.DOTALL)


class Vocabulary:
    """Pieces, scores and byte pieces of a model, without its own search."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int], unknown: int,
                 special: set[int] = frozenset(), kind: str = "bpe"):
        self.kind, self.unknown, self.byte_ids, self.special = kind, unknown, byte_ids, set(special)
        hidden = {unknown, *byte_ids.values(), *special}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in hidden and p}
        self.scores, self.pieces = scores, pieces
        self.longest = max(map(len, self.ids), default=1)
        # No path crosses the start of a run of blanks if no piece has a blank after something else.
        self.breaks = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self._apart: dict[tuple[int, int], bool] = {}
        if kind == "bpe":
            self.halves = {i: self._halves(p) for p, i in self.ids.items() if len(p) > 1}
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.halves[i]}
            # Place in the order of merges; characters are there from the start, equal scores have one place.
            merges = {i for p, i in self.ids.items() if len(p) > 1}
            place = {x: n for n, x in enumerate(sorted({-scores[i] for i in merges}), 1)}
            self.rank = dict.fromkeys(self.ids.values(), 0) | {i: place[-scores[i]] for i in merges}
            # Pieces that score better than a part of theirs are merged out of order.
            self.early: set[int] = set()
            for i in sorted(merges, key=lambda i: len(pieces[i])):
                if any(h in self.early or self.rank[h] >= self.rank[i] for h in self.halves[i]):
                    self.early.add(i)
        self.trie = _trie(self.ids)
        self.borders = _borders(self.ids)
        text = {i: p.replace(BLANK, " ").encode() for p, i in self.ids.items()}
        self.bytes_of = [text.get(i, b"") for i in range(len(pieces))]
        for value, i in byte_ids.items():
            self.bytes_of[i] = bytes([value])
        self.bytes_of[unknown] = " ⁇ ".encode()

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        special = {i for i in range(n) if m.is_control(i) or m.is_unused(i)}
        return cls(pieces, [m.get_score(i) for i in range(n)], byte_ids, m.unk_id(), special, kind)

    def merged(self, text: str) -> list[list[str]]:
        """The parts of a text after every merge: best-scored pair first, leftmost among equals."""
        parts = list(text)
        steps = [parts]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                number = self.ids.get(parts[i] + parts[i + 1])
                if number is not None and (best is None or self.scores[number] > best):
                    best, at = self.scores[number], i
            if best is None:
                return steps
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
            steps.append(parts)

    def _halves(self, text: str) -> tuple[int, int] | None:
        """The two pieces that are merged last when the text becomes one piece; None if it doesn't."""
        steps = self.merged(text)
        return tuple(map(self.ids.get, steps[-2])) if steps[-1] == [text] else None

    def apart(self, left: int, right: int) -> bool:
        """Whether merging leaves these two neighbouring pieces as they are.

        Their merges are undone from the last one back, on either side of the line between
        them. At each stage the two pieces at the line must not merge before the undone merge.
        Of equally ranked merges the left one comes first. Pieces merged out of order are tried.
        """
        if left == UNKNOWN or right == UNKNOWN:
            return True
        known = self._apart.get((left, right))
        if known is not None:
            return known
        if len(self._apart) > 2_000_000:
            self._apart.clear()
        a, b, before, rank, free = left, right, len(self.rank) + 1, self.rank, True
        tried = left in self.early or right in self.early
        if tried:
            free = self.merged(self.pieces[a] + self.pieces[b])[-1] == [self.pieces[a], self.pieces[b]]
        while not tried:
            joined = self.ids.get(self.pieces[a] + self.pieces[b])
            if joined is not None and rank[joined] < before:
                free = False
                break
            if rank[a] > rank[b]:
                before, a = rank[a], self.halves[a][1]
            elif rank[b]:
                before, b = rank[b] + 1, self.halves[b][0]
            else:
                break
        self._apart[left, right] = free
        return free


def stream(characters: Iterable[str], v: Vocabulary) -> Iterator[tuple[int, str]]:
    """Committed ``piece number, text``; the number is ``UNKNOWN`` for a character outside the vocabulary."""
    source, longest = iter(characters), v.longest
    text, left, done = "", UNKNOWN, 0
    back, piece, total = [0], [UNKNOWN], [0.0]
    while True:
        more = "".join(islice(source, longest))
        text += more
        # A boundary is extended once all pieces that can start there are in the window.
        until = len(text) if len(more) < longest else len(text) - longest + 1
        _extend(text, done, until, v, left, back, piece, total)
        done = max(done, until)
        if len(more) < longest:
            break
        cut = _meeting(back, max(0, done - longest + 1), done) if done >= longest else 0
        if cut:
            yield from _path(text, back, piece, cut)
            left = piece[cut]
            text, done = text[cut:], done - cut
            back = [0] + [None if b is None else max(0, b - cut) for b in back[cut + 1:]]
            piece, total = piece[cut:], total[cut:]
    yield from _path(text, back, piece, len(text))


def _extend(text: str, first: int, last: int, v: Vocabulary, left: int, back: list, piece: list, total: list) -> None:
    """Extends the boundaries from ``first`` to before ``last``: a walk down the trie from each of them."""
    end_of, bpe, scores, known = len(text), v.kind == "bpe", v.scores, v._apart
    missing = end_of + 1 - len(back)
    back += [None] * missing
    piece += [UNKNOWN] * missing
    total += [0.0] * missing
    for begin in range(first, last):
        before = piece[begin] if begin else left
        node, end = v.trie, begin
        while end < end_of:
            node = node.get(text[end])
            if node is None:
                break
            end += 1
            number = node.get("")
            if number is None:
                continue
            if not bpe:
                score = total[begin] + scores[number]
                if back[end] is None or score > total[end]:
                    back[end], piece[end], total[end] = begin, number, score
            elif back[end] is None:
                apart = known.get((before, number)) if before != UNKNOWN else True
                if v.apart(before, number) if apart is None else apart:
                    back[end], piece[end] = begin, number
        if back[begin + 1] is None:
            back[begin + 1], piece[begin + 1], total[begin + 1] = begin, UNKNOWN, total[begin] - 1e6


def _meeting(back: list[int], first: int, last: int) -> int:
    """The boundary in which the paths of all boundaries from ``first`` to ``last`` meet."""
    open_ends = set(range(first, last + 1))
    while len(open_ends) > 1:
        furthest = max(open_ends)
        open_ends.discard(furthest)
        open_ends.add(back[furthest])
    return open_ends.pop()


def _path(text: str, back: list[int], piece: list[int], end: int) -> list[tuple[int, str]]:
    out = []
    while end:
        out.append((piece[end], text[back[end]:end]))
        end = back[end]
    return out[::-1]


class Codec:
    """Encodes and decodes whole texts; one per worker process.

    Where no path crosses the start of a run of blanks, the words between are searched by
    themselves, cut once more between letters and signs that no piece joins, and those met are
    remembered.
    """

    REMEMBERED = 600_000
    LONGEST = 40

    def __init__(self, v: Vocabulary):
        self.v, self.known = v, {}

    def _search(self, text: str) -> bytes:
        out = []
        for number, part in stream(text, self.v):
            if number != UNKNOWN:
                out.append(number)
            elif self.v.byte_ids:
                out.extend(self.v.byte_ids[b] for b in part.encode())
            else:
                out.append(self.v.unknown)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit."""
        if not text:
            return b""
        if not self.v.breaks:
            return self._search(BLANK + text.replace(" ", BLANK))
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        out, known = [], self.known
        for part in WORDS.findall(" " + text.replace(BLANK, " ")):
            ids = known.get(part)
            if ids is None:
                ids = b"".join(map(self._part, self.v.borders.split(part)))
                if len(part) <= self.LONGEST:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        """Ids of a part that no piece crosses the ends of."""
        ids = self.known.get(part)
        if ids is None:
            ids = self._search(part.replace(" ", BLANK))
            if len(part) <= self.LONGEST:
                self.known[part] = ids
        return ids

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.v.bytes_of.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, kind: str) -> Codec:
    if (path, kind) not in _codecs:
        _codecs[path, kind] = Codec(Vocabulary.load(path, kind))
    return _codecs[path, kind]


def encode(docs: DataFrame, model: str, kind: str = "bpe", text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of its text column (binary, little-endian unsigned 32-bit) as one more column.

    Rows are encoded one by one, also repeated ones, and texts whole, however long. A name that the table
    has already is refused, here and in the other two.
    """
    refuse(docs.columns, ids)
    at = docs.columns.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches):
        own = codec(model, kind)
        for batch in batches:
            found = [own.encode(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())],
                                             names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, f"{fields}, `{ids}` binary")


def decode(encoded: DataFrame, model: str, kind: str = "bpe", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its id column as one more column; null ids are the empty text."""
    refuse(encoded.columns, text)
    at = encoded.columns.index(ids)
    fields = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes)

    def run(batches):
        own = codec(model, kind)
        for batch in batches:
            found = [own.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())],
                                             names=[*batch.schema.names, text])

    return encoded.mapInArrow(run, f"{fields}, `{text}` string")


def digests(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """Without the ids: ``n_ids`` and ``ids_crc32`` in their place."""
    refuse(encoded.columns, "n_ids", "ids_crc32")
    return encoded.withColumn("n_ids", (F.length(ids) / 4).cast("bigint")).withColumn("ids_crc32", F.crc32(ids)).drop(ids)
