"""Co-training: held-out accuracy of the combined views, and odd rows."""

import random

import pytest

from docketry.llm import quality as Q


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < .7
        words = [rng.choice("the of and report about river some longer sentences".split()) for _ in range(rng.randrange(20, 80))]
        if not good and rng.random() < .9:
            words = [w.upper() + "!!" for w in words] if rng.random() < .5 else [w + "###" for w in words]
        source = rng.choice(["a", "b", "c"]) if good or rng.random() < .3 else rng.choice(["x", "y"])
        rows.append((i, " ".join(words) + ".", source, None))
        if i % 4 == 0:
            labels.append((i, good))
        rows[-1] += (good,)
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, y string").repartition(3)
    given = spark.createDataFrame(labels, "id long, good boolean")
    got = {r.id: r for r in Q.co_train(docs, given, ["source", "y"]).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    rest = [r for r in rows if r[0] % 4]
    hits = sum((got[r[0]].score >= .5) == r[4] for r in rest)
    views = [sum((got[r[0]][name] >= .5) == r[4] for r in rest) for name in ("p_text", "p_meta")]
    assert hits >= 0.93 * len(rest) and hits >= max(views) - 0.01 * len(rest)


def test_one_kind_of_label_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "", "s"), (None, "x " * 9000, "s")], "i long, t string, score string")
    given = spark.createDataFrame([(1, True), (1, False), (2, None), (3, True)], "id long, good boolean")
    assert [r.score for r in Q.co_train(docs, given, ["score"]).collect()] == [0.5] * 3
    assert Q.co_train(docs.limit(0), given, ["score"]).collect() == []
    rows, labels = corpus(200)
    more = docs.union(spark.createDataFrame([r[:3] for r in rows], docs.schema))
    more = more.withColumn("i", Q.F.coalesce("i", Q.F.lit(None)))
    got = Q.co_train(more, spark.createDataFrame(labels, "id long, good boolean"), ["score"]).collect()
    assert len(got) == 203 and all(0 <= r.score <= 1 for r in got)


def test_features_of_a_text():
    hashes = next(iter([Q.W.word_hashes(*Q.W.text_buffers(Q.pa.array(["ab AB\nab 1!"])))[0]]))
    found = dict(zip(Q.FEATURES, Q._measure("ab AB\nab 1!", hashes, 8), strict=True))
    assert found["upper"] == pytest.approx(2 / 11) and found["digit"] == pytest.approx(1 / 11)
    assert found["distinct_words"] == 0.5 and found["distinct_lines"] == 1 and found["top_word"] == 0.75


def test_all_pages_of_a_document_count(spark):
    """Bad documents are on one bad host among several; only the set of all hosts tells them."""
    rng = random.Random(6)
    rows = [(i, "some words in a plain line of text.", rng.random() < .6) for i in range(500)]
    pages = [(i, f"host{rng.randrange(50)}", "www") for i, _, _ in rows for _ in range(3)]
    pages += [(i, f"spam{i % 3}", "www") for i, _, good in rows if not good] + [(0, None, None)] * 3
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    given = spark.createDataFrame([(i, good) for i, _, good in rows if i % 2], "id long, good boolean")
    shown = spark.createDataFrame(pages, "id long, domain string, head string")
    got = {r.id: r.score for r in Q.co_train(docs, given, [], pages=shown).collect()}
    assert len(got) == 500
    assert sum((got[i] >= .5) == good for i, _, good in rows if not i % 2) >= 240
