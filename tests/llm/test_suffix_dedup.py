"""Repeated passages against brute force over all 50-word windows."""

import random
from collections import defaultdict

from docketry.llm import suffix_dedup as S


def words(text):
    return (text or "").encode().lower().split()


def brute(rows, least=50):
    """Word positions of every document inside a window that another (or a smaller) document has."""
    where = defaultdict(set)
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - least + 1):
            where[tuple(w[i:i + least])].add(key)
    spans, cuts = defaultdict(set), defaultdict(set)
    for key, text in rows:
        w = words(text)
        for i in range(len(w) - least + 1):
            has = where[tuple(w[i:i + least])]
            if len(has) > 1:
                spans[key] |= set(range(i, i + least))
            if min(has) < key:
                cuts[key] |= set(range(i, i + least))
    return spans, cuts


def corpus(seed=4):
    rng = random.Random(seed)

    def fresh(n):
        return [f"v{rng.randrange(3000)}" for _ in range(n)]

    passages = [fresh(n) for n in (49, 50, 51, 60, 90, 300)]
    rows = []
    for key in range(60):
        body = fresh(rng.choice([5, 40, 120, 400]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            body += rng.choice(passages) + fresh(rng.choice([0, 3, 50]))
        rows.append((key, rng.choice([" ", "\n"]).join(body)))
    rows += [(100 + i, rows[3][1]) for i in range(4)]                       # whole copies
    rows += [(200 + i, " ".join(fresh(30) + passages[3] + fresh(30))) for i in range(60)]   # one common passage
    rows += [(300, "la " * 500), (301, "LA la " * 200), (302, "la " * 30), (303, None), (304, ""), (305, "é " * 80)]
    return rows


def covered(spans):
    return {i for s in spans for i in range(s["start"], s["end"])}


def test_passages_agree_with_brute_force(spark):
    rows = corpus()
    for reach in (8, 2):
        got = S.repeated_passages(spark.createDataFrame(rows, "i long, t string").repartition(5), S.SuffixDedup(reach=reach)).collect()
        spans, cuts = brute(rows)
        found = {r.id: covered(r.spans) for r in got}
        assert set(found) == set(spans)
        missed = sum(len(spans[k] - found[k]) for k in spans)
        # Only words at a passage's edge that match by chance in a document that sorts elsewhere.
        assert missed <= 0.001 * sum(map(len, spans.values()))
        texts = dict(rows)
        for r in got:
            assert r.twin != r.id
            assert covered(r.cuts) <= (cuts[r.id] if r.id < 300 else found[r.id])
            assert len(words(texts[r.id])) >= max(covered(r.spans)) + 1
        # The passage that sixty documents share is cut in all but the first.
        assert sum(len(r.cuts) > 0 for r in got if 200 <= r.id < 300) >= 59
        assert {r.id for r in got if 100 <= r.id < 200 and covered(r.cuts) == spans[r.id]} == {100, 101, 102, 103}


def test_cut_leaves_one_copy(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(55))
    rows = [(1, f"Début  un\n{passage}\tfin un.", "a"), (2, f"other start {passage}", "b"), (3, passage, "c"),
            (4, "short text", "d"), (5, None, "e"), (None, passage, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    left = {(r.doc_id, r.id): r.text for r in S.cut_repeats(docs, S.repeated_passages(docs.select("doc_id", "text"))).collect()}
    assert left == {(1, "a"): rows[0][1], (2, "b"): "other start ", (4, "d"): "short text", (5, "e"): None, (None, "f"): passage}


def test_no_rows_and_repeated_ids(spark):
    docs = spark.createDataFrame([], "i long, t string")
    assert S.repeated_passages(docs).collect() == []
    text = " ".join(f"q{i}" for i in range(80))
    twice = spark.createDataFrame([(1, text), (1, text)], "i long, t string")
    assert S.repeated_passages(twice).collect() == []


def test_passages_around_a_common_notice(spark):
    rng = random.Random(12)

    def fresh(n):
        return [f"n{rng.randrange(10 ** 6)}" for _ in range(n)]

    notice = fresh(45)
    rows = [(i, " ".join(fresh(30) + notice + fresh(30))) for i in range(400)]
    for i in range(40):                       # own words before, after or on both sides of the notice, in two documents
        before, after = fresh((10, 0, 5)[i % 3]), fresh((0, 10, 5)[i % 3])
        rows += [(key, " ".join(fresh(30) + before + notice + after + fresh(30))) for key in (1000 + i, 2000 + i)]
    got = {r.id: r for r in S.repeated_passages(spark.createDataFrame(rows, "i long, t string").repartition(5)).collect()}
    spans, cuts = brute(rows)
    assert {k: covered(r.spans) for k, r in got.items()} == spans and len(spans) == 80
    assert {k: covered(r.cuts) for k, r in got.items() if r.cuts} == cuts and set(cuts) == {2000 + i for i in range(40)}
    assert all(r.twin == (k + 1000 if k < 2000 else k - 1000) for k, r in got.items())


def test_no_word_is_missed(spark):
    rows = [r for r in corpus() if not 100 <= r[0] < 200]
    got = S.repeated_passages(spark.createDataFrame(rows, "i long, t string").repartition(5)).collect()
    spans, cuts = brute(rows)
    assert {r.id: covered(r.spans) for r in got} == spans and {r.id: covered(r.cuts) for r in got if r.cuts} == cuts
