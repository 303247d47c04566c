"""Conversation repair against every way to edit, and against a plain whole-table search."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from docketry.llm import conversations as C
from docketry.llm import queries

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile("(s?(ua)+)?")


def faults(rows):
    """First fault of every row."""
    out, seen = [], set()
    for role, text in rows:
        said = text.strip(SPACE)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else
                   "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows, inserts=2):
    """Cheapest edits of a short conversation, by trying every one."""
    gaps = [list(itertools.chain.from_iterable(itertools.product(["user", "assistant"], repeat=n) for n in range(inserts + 1)))
            for _ in range(len(rows) + 1)]
    best = None
    for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["K", "user", "assistant", "D"] for f in faults(rows)]):
        for put in itertools.product(*gaps):
            cost, audit, roles, out = 0, "", [], []
            for i in range(len(rows) + 1):
                for role in put[i]:
                    cost, audit, roles, out = cost + 5, audit + "I", [*roles, role], [*out, role + ":"]
                if i < len(rows):
                    edit, (role, text) = edits[i], rows[i]
                    cost += {"K": 0, "D": 2}.get(edit, 1)
                    audit += edit if edit in "KD" else "R"
                    if edit != "D":
                        cost += 5 * (faults(rows)[i] == "truncated")
                        role = role if edit == "K" else edit
                        roles, out = [*roles, role], [*out, f"{role}:{text}"]
            if (best is None or (cost, audit) < best[:2]) and GRAMMAR.fullmatch("".join(r[:1] or "-" for r in roles)):
                best = (cost, audit, "\n".join(out))
    return best


def plain(rows):
    """Cheapest edits by whole strings kept for every state; any number of inserts."""
    alive = {0: (0, "", "")}
    nexts = {0: "u", 1: "u", 2: "a", 3: "u"}

    def add(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found
            return True

    def widen(alive):
        todo = list(alive)
        while todo:
            state = todo.pop()
            cost, audit, out = alive[state]
            role = {"u": "user", "a": "assistant"}[nexts[state]]
            target = 2 if role == "user" else 3
            if add(alive, target, (cost + 5, audit + "I", out + "\n" + role + ":")):
                todo.append(target)

    for (role, text), fault in zip(rows, faults(rows), strict=True):
        widen(alive)
        best = {}
        for state, (cost, audit, out) in alive.items():
            add(best, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            for new in ("user", "assistant"):
                if new[0] == nexts[state]:
                    add(best, 2 if new == "user" else 3, (cost + 1 + extra, audit + "R", f"{out}\n{new}:{text}"))
            if role[:1] == nexts[state] or (state == 0 and role[:1] == "s"):
                add(best, {"s": 1, "u": 2, "a": 3}[role[:1]], (cost + extra, audit + "K", f"{out}\n{role}:{text}"))
        alive = best
    widen(alive)
    cost, audit, out = min(alive[s] for s in (0, 3) if s in alive)
    return cost, audit, out[1:]


def whole(rows, also=()):
    """Every column of the audit for rows (conv, turn, role, text)."""
    out = {key: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for key in also}
    rows = [(k, t, " " if r is None else r, " " if x is None else x) for k, t, r, x in rows]
    order = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest())
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=order)
        turns = [r[1] for r in own if r[1] is not None]
        found = faults([r[2:] for r in own])
        cost, audit, text = plain([r[2:] for r in own])
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        out[key] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


TEXTS = ["Yes.", "No!", "Why?", "cut", "and  ", "", " \t", "Done. \n", "é…", "So."]
ROLES = ["user", "assistant", "system", "tool", " ", "", "umpire"]


def some_rows(rng, count):
    roles = rng.choice([ROLES[:2], ROLES[:3], ROLES])
    ends = rng.choice([["."], ["."], [".", "", " "]])
    return [(rng.choice(roles), rng.choice(TEXTS) if rng.random() < 0.2 else f"{rng.randrange(50)}{rng.choice(ends)}")
            for _ in range(count)]


def streamed(rows):
    """Cost, audit and digest of the streaming search, and its largest tree."""
    edits, seen, most = [], set(), 0
    repair = C.Repair(lambda letters, rows: edits.append(letters))
    for i, (role, text) in enumerate(rows):
        repair.add(C.Turn(i, role, text), (role, text) in seen)
        seen.add((role, text))
        most = max(most, repair.survivors.nodes())
    cost, digest = repair.survivors.finish()
    return (cost, "".join(edits), digest.hash.hexdigest()), most


def hashed(found):
    return (*found[:2], hashlib.sha256(found[2].encode()).hexdigest())


def test_against_every_edit():
    rng = random.Random(11)
    for n in [0, 1, 2, 3] * 12 + [4] * 6:
        rows = some_rows(rng, n)
        want = exhaustive(rows, 2 if n < 4 else 1)
        assert plain(rows) == want and streamed(rows)[0] == hashed(want), rows


def test_against_whole_strings():
    rng = random.Random(12)
    for _ in range(3000):
        rows = some_rows(rng, rng.randrange(40))
        assert streamed(rows)[0] == hashed(plain(rows)), rows


def test_tree_stays_small():
    rng = random.Random(13)
    for roles in (["user", "assistant"], ["user"], ["tool"], ["user", "assistant", "system"]):
        for ends in ([""], ["."], ["", "."]):
            rows = [(rng.choice(roles), f"{i}{rng.choice(ends)}") for i in range(3000)]
            assert streamed(rows)[1] <= 7, (roles, ends)
    assert streamed([("user", "a."), ("tool", "x")] + [("user", "a.")] * 5000)[1] <= 7


def test_edits_are_emitted_early():
    """Alternating roles leave nothing open, a single role two paths to the end."""
    sent = []
    repair = C.Repair(lambda letters, rows: sent.append(len(letters)), rows=True)
    for i in range(1000):
        repair.add(C.Turn(i, ["user", "assistant"][i % 2], f"{i}."), False)
    assert sum(sent) >= 998
    repair = C.Repair(lambda letters, rows: sent.append(len(letters)), rows=True)
    for i in range(1000):
        repair.add(C.Turn(i, "user", f"{i}."), False)
    assert repair.survivors.nodes() == 2


def table():
    rng = random.Random(14)
    rows = []
    for key in range(60):
        rows += [(key, rng.choice([None, t, t, t, 2 * t]), *row) for t, row in enumerate(some_rows(rng, rng.randrange(1, 25)))]
    rows += [(100, 1, "user", "Same.")] * 4 + [(100, 5, "user", "Same."), (100, None, "user", "Same.")]
    rows += [(101, t, "user" if t % 2 else "assistant", "Ok.") for t in range(40)]
    rows += [(None, 3, None, None), (None, None, "user", "Hi."), (102, None, None, "x" * 100_000), (103, -2**63, "user", "A."),
             (104, 2**62, "user", "nul\x00 \U0001f642."), (105, 0, "system", "Only.")]
    rng.shuffle(rows)
    return rows


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_audit_of_a_table(spark):
    rows = table()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int")
    also = spark.createDataFrame([(k,) for k in (0, 100, 999, None)], "conv_id long")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in C.audit(frame, also).collect()}
    assert got == whole(rows, [0, 100, 999, None])


def test_repaired_turns(spark):
    rows = table()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sent = {}
    for r in sorted(C.repair(frame).collect(), key=lambda r: r.place):
        assert (r.turn is None and r.text == "") or r.edit != "I"
        sent.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    want = whole(rows)
    for key in want:
        assert [p for p, _ in sent.get(key, [])] == list(range(len(sent.get(key, []))))
        assert hashlib.sha256("\n".join(t for _, t in sent.get(key, [])).encode()).hexdigest() == want[key][-1]
    with pytest.raises(ValueError, match="place"):
        C.repair(frame.withColumnRenamed("turn", "place"), turn="place")
    with pytest.raises(ValueError, match="id column"):
        C.audit(frame.withColumnRenamed("conv_id", "cost"), id="cost")


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.audit(empty).count() == 0 and C.repair(empty).count() == 0


def damage(rows):
    out = []
    for key, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out += [(key, turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
    return out


def test_registered_query(spark, tmp_path):
    path = "/root/testdata/sf0.001/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, "/root/testdata/sf0.001").collect()}
    assert got == whole(damage(rows), {r[0] for r in rows})
    odd = [(k, t, r, x) for k, t, r, x in table() if k is None or k < 103]
    spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == whole(damage(odd), {r[0] for r in odd})
