"""Repair of conversation structure by a Viterbi search that emits edits as its survivors coalesce.

The rows of a conversation, in the order of their turns, are edited at the least cost so that
the roles' initials read ``(s?(ua)+)?``. A row is kept (0), gets the role user or assistant (1) or is
deleted (2, the only choice for blank and repeated rows); an empty user or assistant turn can be
inserted anywhere (5); an undeleted truncated row adds 5. Of equally cheap edits the initials
(D, I, K, R) that come first in ASCII order are taken.

Four states say which role was last: none, system, user, assistant. Every state has one survivor, a
leaf of a tree of backpointers whose nodes count their branches. A node without survivors goes, one with a
single branch joins it, and as soon as all survivors share the node behind the root, its edits are final
and are emitted. Ties are decided on the complete unresolved suffixes: survivors stand in the order of their
edits from the common ancestor on, and as the edits of a row end with its letter, no such suffix is the
beginning of another; so two new paths compare by their parents' places and, of one parent, by their last
letters. A survivor that another one can replace for less, whatever follows, is dropped, which lets most
conversations coalesce within a few rows.

Spark moves every text once, to the partition of its conversation, and sorts it there; a task streams
through its rows. The tree has at most seven nodes. The audit keeps a letter for every edit, its result, and
no text: survivors carry the digest of what they have written. The repaired turns wait until their edits are
final; where the end alone decides (one role throughout, say), they wait for the end. Digest and
edits are sequential, so one task streams through even the longest conversation, but it never holds it.
Rows said in an earlier turn too are found before that, by an aggregate over digests of role and text, so
no task remembers what a conversation has said.

Null roles and texts count as one blank, an empty role fits nowhere, null turns come first, null ids are a conversation. Rows of one
turn are ordered by role and by the MD5 of their text. A text of white space is blank. Texts are used
whole, however long. Conversations without rows are reported where ``also`` names them; empty tables give
empty results. Only the id, turn, role and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.plans.hot import join_by_key

SPACE = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
# Role that may follow each state, by its initial, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
MISSING = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# What it costs at most to go on from the first state as from the second.
REPLACE = {
    START: {SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: 2 * INSERT, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}


@dataclass(slots=True)
class Turn:
    turn: int | None
    role: str
    text: str


class Node:
    """Edits in the tree of backpointers, up to the next fork. Its branches are its reference count."""

    __slots__ = ("parent", "letters", "rows", "branches")

    def __init__(self, parent: Node | None, letters: str, rows: list[Turn]):
        self.parent, self.letters, self.rows, self.branches = parent, bytearray(letters, "ascii"), rows, []
        if parent is not None:
            parent.branches.append(self)


class Digest:
    """SHA-256 of the lines that a path has written so far."""

    __slots__ = ("hash", "lines")

    def __init__(self, hash=None, lines: int = 0):
        self.hash, self.lines = hash or hashlib.sha256(), lines

    def extended(self, written: list[tuple[str, str]]) -> Digest:
        new = Digest(self.hash.copy(), self.lines)
        for role, text in written:
            new.hash.update(f"{chr(10) if new.lines else ''}{role}:{text}".encode())
            new.lines += 1
        return new


class Survivors:
    """The cheapest path into every state; ``emit(letters, rows)`` gets edits once they are final.

    Nodes hold the rows they keep where ``rows`` are asked for. Else every survivor carries the
    digest of what it has written, so no text outlives its step.
    """

    def __init__(self, emit: Callable[[str, list[Turn]], None], rows: bool):
        self.emit, self.rows = emit, rows
        self.root = Node(None, "", [])
        # state, cost, leaf and digest, in the order of the survivors' unresolved suffixes
        self.alive = [(START, 0, self.root, None if rows else Digest())]

    def nodes(self) -> int:
        count, todo = 0, [self.root]
        while todo:
            branches = todo.pop().branches
            count += len(branches)
            todo.extend(branches)
        return count

    def delete(self) -> None:
        """A row that every path deletes."""
        if len(self.alive) == 1:
            self.emit("D", [])
        else:
            for _, _, leaf, _ in self.alive:
                leaf.letters += b"D"
        self.alive = [(state, cost + DELETE, leaf, digest) for state, cost, leaf, digest in self.alive]

    def step(self, row: Turn, truncated: bool) -> None:
        initial, extra = row.role[:1], TRUNCATED if truncated else 0
        best: dict[int, tuple] = {}

        def offer(target: int, cost: int, place: int, letters: str) -> None:
            new = (cost, place, letters)
            if target not in best or new < best[target]:
                best[target] = new

        for place, (state, cost, _, _) in enumerate(self.alive):
            offer(state, cost + DELETE, place, "D")
            for before, at, paid in (("", state, cost), ("I", MISSING[state][1], cost + INSERT)):
                kept = AFTER.get((at, initial))
                if kept is not None:
                    offer(kept, paid + extra, place, before + "K")
                offer(MISSING[at][1], paid + REROLE + extra, place, before + "R")
        costs = {state: new[0] for state, new in best.items()}
        lasting = [state for state in best
                   if not any(other != state and costs[other] + REPLACE[other][state] < costs[state] for other in costs)]
        before, self.alive = self.alive, []
        for state in sorted(lasting, key=lambda state: best[state][1:]):
            cost, place, letters = best[state]
            origin, _, leaf, digest = before[place]
            written = written_by(letters, origin, row)
            self.alive.append((state, cost, Node(leaf, letters, [row] if self.rows and letters[-1] != "D" else []),
                               digest and digest.extended(written)))
        for _, _, leaf, _ in before:
            self._release(leaf)
        self._coalesce()
        self.alive = [(state, cost, self._joined(leaf), digest) for state, cost, leaf, digest in self.alive]

    def _release(self, node: Node) -> None:
        while not node.branches and node.parent is not None:
            node.parent.branches.remove(node)
            node = node.parent

    def _coalesce(self) -> None:
        while len(self.root.branches) == 1 and (self.root.branches[0].branches or len(self.alive) == 1):
            self.root = self.root.branches[0]
            self.root.parent = None
            self.emit(self.root.letters.decode(), self.root.rows)
            self.root.letters, self.root.rows = bytearray(), []

    def _joined(self, leaf: Node) -> Node:
        """The leaf after joining with the nodes above it that have no other branch."""
        node = leaf
        while node.parent is not None and node.parent is not self.root:
            above = node.parent
            if len(above.branches) == 1:
                above.letters += node.letters
                above.rows += node.rows
                above.branches = node.branches
                for branch in node.branches:
                    branch.parent = above
                leaf = above if node is leaf else leaf
            node = above
        return leaf

    def finish(self) -> tuple[int, Digest | None]:
        """Emits what is left of the cheapest whole path; its cost and digest."""
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        _, place = min((cost + INSERT * len(ends[state]), place) for place, (state, cost, _, _) in enumerate(self.alive))
        state, cost, leaf, digest = self.alive[place]
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.parent
        for node in reversed(path):
            self.emit(node.letters.decode(), node.rows)
        if ends[state]:
            self.emit(ends[state], [])
        return cost + INSERT * len(ends[state]), digest and digest.extended(written_by(ends[state], state, None))


def written_by(letters: str, state: int, row: Turn | None) -> list[tuple[str, str]]:
    """Role and text of the turns that a row's edits write."""
    out = []
    for letter in letters:
        if letter != "D":
            role, after = MISSING[state]
            if letter == "K":
                role, after = row.role, AFTER[state, row.role[:1]]
            out.append((role, "" if letter == "I" else row.text))
            state = after
    return out


class Repair:
    """One conversation, row by row. ``out(letters, rows)`` gets final edits, and the rows kept by them if asked for."""

    def __init__(self, out: Callable[[str, list[Turn]], None], rows: bool = False):
        self.survivors = Survivors(out, rows)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None

    def add(self, row: Turn, seen: bool) -> None:
        if row.turn is not None:
            self.turns += row.turn != self.high
            self.low = row.turn if self.low is None else self.low
            self.high = row.turn
        initial = row.role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        said = row.text.rstrip(SPACE)
        if not said or seen:
            self.blank += not said
            self.duplicate += bool(said)
            self.survivors.delete()
            return
        cut = not said.endswith(ENDS)
        self.truncated += cut
        self.survivors.step(row, cut)

    def gaps(self) -> int | None:
        found = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return found if found < 2**63 else None


def _order(turn: Column) -> Column:
    return F.struct(turn.isNotNull(), turn)


PRESENT, SEEN, ROW = 0, 1, 2


def _arranged(turns: DataFrame, also: DataFrame | None, id: str, turn: str, role: str, text: str) -> DataFrame:
    """``__id, turn, role, digest, kind, text``: the rows of a conversation together, in order.

    A row said in an earlier turn too has a row of kind SEEN in front of it.
    """
    rows = turns.select(
        F.col(id).alias("__id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
        F.coalesce(text, F.lit(" ")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    light = rows.select("__id", "turn", "role", "digest", F.md5(F.concat(
        F.coalesce(F.concat(F.lit("="), F.col("__id").cast("string")), F.lit("")), F.lit("\0"), "role", F.lit("\0"), F.hex("digest"))).alias("key"))
    again = light.groupBy("key").agg(F.min(_order(F.col("turn"))).alias("first"), F.max(_order(F.col("turn"))).alias("last"),
                                     F.count("*").alias("rows")).where("first < last").drop("last")
    later = join_by_key(light, again, ["key"], "rows").where(_order(F.col("turn")) > F.col("first"))
    none, empty = F.lit(None), F.lit("")
    parts = rows.select("__id", "turn", "role", "digest", F.lit(ROW).alias("kind"), "text").unionByName(
        later.select("__id", "turn", "role", "digest", F.lit(SEEN).alias("kind"), empty.alias("text")))
    if also is not None:
        parts = parts.unionByName(also.select(
            F.col(id).alias("__id"), none.cast("bigint").alias("turn"), empty.alias("role"), none.cast("binary").alias("digest"),
            F.lit(PRESENT).alias("kind"), empty.alias("text")))
    return parts.repartition("__id").sortWithinPartitions(
        F.asc_nulls_first("__id"), F.asc_nulls_first("turn"), "role", "digest", "kind")


def _conversations(batches: Iterator[pa.RecordBatch], begin: Callable, end: Callable) -> Iterator[bool]:
    """Streams sorted rows: ``begin(id)`` gives a Repair, ``end(id, repair)`` takes it. Yields after every batch."""
    here, repair, marked, last = None, None, None, None
    for batch in batches:
        for key, turn, role, digest, kind, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if repair is None or key != here:
                if repair is not None:
                    end(here, repair)
                here, repair, marked, last = key, begin(key), None, None
            if kind == SEEN:
                marked = (turn, role, digest)
            elif kind == ROW:
                now = (turn, role, digest)
                repair.add(Turn(turn, role, text), now == marked or now == last)
                last = now
        yield True
    if repair is not None:
        end(here, repair)
    yield True


def audit(turns: DataFrame, also: DataFrame | None = None, id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> DataFrame:
    """One row per conversation of ``turns``, and of the ids of ``also``: counts of faults, cost, edits and the SHA-256 of
    the repaired ``role:text`` lines."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    if id in (*counts, "audit", "repaired_sha256"):
        raise ValueError(f"the id column can't be named {id}")
    kind = turns.schema[id].dataType
    schema = T.StructType([T.StructField("__id", kind), *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        types = None

        def begin(_):
            edits: list[str] = []
            found = Repair(lambda letters, rows: edits.append(letters))
            found.edits = edits
            return found

        def end(key, found):
            cost, digest = found.survivors.finish()
            told.append((key, found.gaps(), found.blank, found.duplicate, found.truncated, found.illegal, cost,
                         "".join(found.edits), digest.hash.hexdigest()))

        def watched():
            nonlocal types
            for batch in batches:
                types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield batch

        for _ in _conversations(watched(), begin, end):
            if told:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*told, strict=True), types, strict=True)]
                told.clear()
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return _arranged(turns, also, id, turn, role, text).mapInArrow(run, schema).withColumnRenamed("__id", id)


def repair(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns: ``id, place, edit (I, K or R), turn, role, text``; inserted turns have an empty text and no turn."""
    kind = turns.schema[id].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
                           T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list[tuple] = []
        types = None

        def begin(key):
            place, state = 0, START

            def out(letters, rows):
                nonlocal place, state
                kept = iter(rows)
                for letter in letters:
                    if letter == "D":
                        continue
                    row = None if letter == "I" else next(kept)
                    [(role, text)] = written_by(letter, state, row)
                    told.append((key, place, letter, row and row.turn, role, text))
                    place, state = place + 1, AFTER[state, role[0]]

            return Repair(out, rows=True)

        def watched():
            nonlocal types
            for batch in batches:
                types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield batch

        for _ in _conversations(watched(), begin, lambda key, found: found.survivors.finish()):
            if told:
                columns = [pa.array(list(c), t) for c, t in zip(zip(*told, strict=True), types, strict=True)]
                told.clear()
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    names = {"__id": id, "turn": turn, "role": role, "text": text}
    if len({"place", "edit", *names.values()}) < 6:
        raise ValueError("the columns can't be named place or edit")
    return _arranged(turns, None, id, turn, role, text).mapInArrow(run, schema).withColumnsRenamed(names)
