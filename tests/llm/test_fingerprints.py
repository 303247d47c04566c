"""Fingerprints, the edit of neighbours, and banded near pairs."""

import hashlib
import random

from docketry.llm import fingerprints as P

P_ = P.Fingerprints()


def texts(n=60, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "bêta", "gamma", "δέλτα", "🙂", "x" * 300, "omega,"] + [f"w{i}" for i in range(200)]
    out = []
    for i in range(n):
        if i % 5 == 4:
            out.append(out[-1] if i % 10 == 9 else out[-1] + " more")
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 120]))))
    return out + ["", None, "a", "ab", "abc"]


def test_edit_follows_descending_ids(spark):
    rows = list(enumerate(texts()))
    rows = [(i * 7 - 100, t) for i, t in rows]
    got = {r.id: r for r in P.edit_next(spark.createDataFrame(rows, "i long, t string").repartition(5), rows_a_range=9).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for n, (key, text) in enumerate(order):
        text, after = text or "", order[(n + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        other = got[order[(n + 1) % len(order)][0]]
        assert got[key].near_next == P.likeness(got[key].fingerprint, other.fingerprint)
        assert got[key].near_edited == P.likeness(got[key].fingerprint, got[key].edited_fingerprint)
    prints = {}
    for key, text in rows:
        prints.setdefault(text or "", set()).add(got[key].fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) > 40


def test_likeness_follows_jaccard(spark):
    words = [f"t{i}" for i in range(1000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:500] + [f"u{i}" for i in range(500)]))]
    got = {r.id: r.fingerprint for r in P.fingerprint_documents(spark.createDataFrame(rows, "i long, t string")).collect()}
    assert abs(P.likeness(got[1], got[2]) - 1 / 3) < 0.15


def test_repeated_missing_and_no_rows(spark):
    schema = "doc_id long, text string, id string"
    assert P.edit_next(spark.createDataFrame([], "i long, t string")).collect() == []
    one = P.edit_next(spark.createDataFrame([(3, "abcdef")], "i long, t string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1
    rows = [(None, "x y z", "a"), (4, "p q", "b"), (4, "p q", "c"), (None, None, None), (4, "other text", "d")]
    docs = spark.createDataFrame(rows, schema).select("doc_id", "text")
    got = P.edit_next(docs, rows_a_range=1).collect()
    assert sorted(str(r.id) for r in got) == ["4", "4", "4", "None", "None"]


def test_near_pairs_are_verified(spark):
    rows = list(enumerate(texts(120, seed=9)))
    docs = spark.createDataFrame(rows, "i long, t string")
    found = P.near_pairs(docs).collect()

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    node = {}
    for i, s in sets.items():
        node.setdefault(frozenset(s), i)
    want = {(a, b) for a in node.values() for b in node.values()
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in found} == want and want
    assert all(abs(r.jaccard - len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) < 1e-12 for r in found)


def _family(seed=8, members=240):
    """A template family whose blocks have variants, and near copies of some members: texts, and the pairs of ids."""
    rng = random.Random(seed)

    def fresh():
        kinds = [rng.choices((0, 1, 2), (86, 7, 7))[0] for _ in range(24)]
        return [f"t{i}-{kind}-{j}" for i, kind in enumerate(kinds) for j in range(10)]

    rows = [(i, " ".join(fresh())) for i in range(members)]
    pairs = [(i, 1000 + i) for i in range(members - 60, members, 2)]
    return rows + [(b, f"{rows[a][1]} y{a} z{a}") for a, b in pairs], pairs


def test_near_copies_inside_a_template_family(spark):
    rows, pairs = _family()
    docs = spark.createDataFrame(rows + [(5000, rows[50][1]), (6000, ""), (None, "x")], "i long, t string")
    got = {r.id: r for r in P.near_classes(docs).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert {i: got[i].class_id for i in ids} == {i: top(i) for i in ids}
    assert all(got[a].class_id == got[b].class_id and got[b].n_links for a, b in pairs)
    assert got[5000].class_id == got[50].class_id and set(got) == {*ids, 5000}
