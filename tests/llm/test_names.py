"""Tables whose columns are named like those that the operators add."""

import pytest

from docketry.llm import language, names, near_dedup, packing, pieces, pii, suffix_dedup


def test_unused_and_refused():
    assert names.unused(["a", "B"], "c") == "c" and names.unused(["__id", "__ID_1"], "__id") == "__id_2"
    names.refuse(["a"], "b")
    with pytest.raises(ValueError, match="column Score"):
        names.refuse(["score"], "Score")


def test_stages_keep_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text + " mail a@b.cd", 5, 6, 7), (2, "x y z " + text + " 1.2.3.4", 5, 6, 7), (3, "short", 5, 6, 7), (3, "short", 5, 6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone int, __id int, __cuts int")
    docs = docs.selectExpr("*", "1 as __n", "2 as __mark", "3 as __spans")
    for got in (near_dedup.keep_one(docs), pii.sanitise(docs), suffix_dedup.cut_repeats(docs, suffix_dedup.repeated_passages(docs.select("doc_id", "text")))):
        assert got.columns == docs.columns
        assert {(r["__gone"], r["__id"], r["__cuts"], r["__n"], r["__mark"], r["__spans"]) for r in got.collect()} == {(5, 6, 7, 1, 2, 3)}


def test_result_names_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "b", 3)], "doc_id long, text string, score string, length long")
    with pytest.raises(ValueError, match="score"):
        language.predict(docs, None)
    with pytest.raises(ValueError, match="ids"):
        pieces.encode(docs.withColumnRenamed("score", "ids"), "unused")
    with pytest.raises(ValueError, match="n_ids"):
        pieces.digests(docs.withColumnRenamed("score", "n_ids"))
    with pytest.raises(ValueError, match="sequence_id"):
        packing.pack(docs.withColumnRenamed("score", "sequence_id"))
