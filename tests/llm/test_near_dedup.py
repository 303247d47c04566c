"""Near-dedup against all pairs, in plain Python."""

import random

import pytest

from docketry.llm import near_dedup as N


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    ids = sorted({i for i, _ in rows})
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, s) in enumerate(sets):
        for j, t in sets[:n]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, [(i, len(s)) for i, s in sets]


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünder", "ÀB", "x" * 500]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 9, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words).swapcase() if rng.random() < .2
                         else " ".join(words)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "W1"), (n + 4, "w1"), (n + 5, "w1 w2")]


@pytest.mark.parametrize("k,block", [(4, 1024), (5, 3)])
def test_components_agree_with_all_pairs(spark, k, block):
    rows = corpus()
    found = N.near_components(spark.createDataFrame(rows, "i long, t string"),
                              N.NearDedup(shingle=k, block=block, salts=4)).collect()
    roots, sizes = brute(rows, k, 80)
    assert {r.id: r.component_id for r in found} == roots
    assert sorted((r.id, r.n_shingles) for r in found) == sorted(sizes)
    assert all(r.kept == (r.id == r.component_id) for r in found)


def test_open_buckets_find_links_that_leaders_miss(spark):
    # 1 - 2 and 2 - 3 are links, 1 - 3 is not: a chain needs more than one leader.
    words = [f"t{i}" for i in range(220)]
    rows = [(1, " ".join(words[:200])), (2, " ".join(words[10:210])), (3, " ".join(words[20:220])),
            (4, " ".join(words[20:220]) + " tail")]
    found = N.near_components(spark.createDataFrame(rows, "i long, t string"), N.NearDedup(shingle=4)).collect()
    assert {r.id: r.component_id for r in found} == brute(rows, 4, 80)[0]


def test_odd_rows(spark):
    schema = "text string, doc_id long, id string, sig int, root string"
    empty = spark.createDataFrame([], schema)
    assert N.keep_one(empty).collect() == []
    rows = [("a b c d e f", None, "x", 1, None), ("a b c d e f", 5, "y", 1, None), ("a b c d e f", 5, "y", 1, None),
            ("a b c d e f", 7, None, 1, None), (None, 8, None, 1, None), (None, 9, None, 1, None)]
    kept = N.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["text", "doc_id", "id", "sig", "root"]
    assert sorted((str(r.doc_id), r.id) for r in kept.collect()) == [
        ("5", "y"), ("8", None), ("9", None), ("None", "x")]


def test_estimate_is_corrected_for_chance():
    import numpy as np

    rng = np.random.default_rng(1)
    for bits in (1, 2, 4, 8):
        a = rng.integers(0, 2**32, 4096, dtype=np.uint32)
        b = np.where(rng.random(4096) < 0.7, a, rng.integers(0, 2**32, 4096, dtype=np.uint32))
        left, right = (np.frombuffer(N.pack(x, bits), np.uint8)[None, :] for x in (a, b))
        assert abs(N.estimates(left, right, bits)[0] - 0.7) < 0.05
        assert N.estimates(left, left, bits)[0] == 1


def test_alike_components_without_a_link(spark):
    # Two groups of near copies whose bases share about two thirds: alike by signature, never linked.
    rng = random.Random(8)
    base = [f"t{i}" for i in range(300)]
    other = base[:240] + [f"u{i}" for i in range(60)]
    rows = []
    for n in range(80):
        text = list(base if n % 2 else other)
        text[rng.randrange(300)] = f"x{n}"
        rows.append((n, " ".join(text)))
    rows += [(100, " ".join(base[:270] + other[240:270])), (101, " ".join(base[:262] + other[240:278]))]
    for block in (1024, 16):
        found = N.near_components(spark.createDataFrame(rows, "i long, t string"), N.NearDedup(shingle=4, block=block)).collect()
        assert {r.id: r.component_id for r in found} == brute(rows, 4, 80)[0]


def test_component_steps_write_what_their_rows_need(spark, monkeypatch):
    """With many shuffle partitions a step of few links is one task, not one a partition."""
    from docketry.llm import graph, near_dedup

    seen, real = [], graph.stored

    def noted(rows, name):
        seen.append((name, rows.rdd.getNumPartitions()))
        return real(rows, name)

    monkeypatch.setattr(graph, "stored", noted)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    words = [f"w{i}" for i in range(60)]
    rows = [(g * 10 + i, " ".join([*words[:50], f"g{g}", f"x{i}"])) for g in range(3) for i in range(3)]
    try:
        for key, value in (("spark.sql.shuffle.partitions", "7"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(key, value)
        near_dedup.near_components(spark.createDataFrame(rows, "id long, text string"), near_dedup.NearDedup(shingle=4)).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    steps = [n for name, n in seen if name in ("links-low", "links-large")]
    assert steps and set(steps) == {1}
