"""The pipeline, stage by stage, against brute force on a small table."""

import random
import re

import pytest

import corpus_pipeline as C
from docketry.llm import packing
from tests_llm_brute import near, pii, suffix

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and of that with from this is on and in the her them river stone".split(),
         "de": "der und die nicht ein mit von auf sich ist haus baum".split(),
         "fr": "le la et des que pour dans ce qui sur les pas maison".split()}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []

    def text(lang, n):
        return [rng.choice(WORDS[lang]) + (str(rng.randrange(40)) if rng.random() < .5 else "") for _ in range(n)]

    shared = text("en", 70)
    for i in range(120):
        lang = list(WORDS)[i % 3]
        words = text(lang, rng.choice([8, 40, 120]))
        if i % 10 == 3:
            words += shared + text(lang, 20)
        if i % 7 == 1:
            words.insert(3, f"user{i}@mail.example.org or +1 555 010 {1000 + i}")
        rows.append((i, " ".join(words), lang, "s", 0))
    rows += [(200 + i, rows[i][1], rows[i][2], "s", 0) for i in range(0, 30, 3)]
    rows += [(300, None, "en", "s", 0), (301, "", None, None, 0), (302, "12 !! 3", "en", "s", 0), (303, "the and of the", None, None, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_agree_with_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        after_df = C.stored(stage(spark, docs, sf_dir), "test-stage")
        assert after_df.columns == docs.columns and after_df.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in after_df.collect()}
        if name == "language":
            want = {k: t for k, t in before.items() if t and re.search(r"[^\W\d_]", t)}
        elif name == "near_dedup":
            roots = near(list(before.items()), 5, 80)
            want = {k: t for k, t in before.items() if roots[k] == k}
            assert len(want) < len(before)
        elif name == "suffix_dedup":
            want = suffix(before)
            assert want != before
        else:
            want = {k: pii(t) for k, t in before.items()}
            assert want != before
        assert after == want, name
        before, docs = after, after_df
    packed = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(before)
    encode = packing.encoder(C.tokenizer("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(encode([t])[0]) // 4 + 1 for t in before.values())
    assert sorted(r.doc_id for r in C.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in packed)


def test_stages_on_odd_tables(spark, tmp_path):
    rows = [(1, "the a\nthe", None, "s", 3), (1, "the a\nthe", None, "s", 3), (None, "x", None, None, None), (2, None, None, None, None)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, COLUMNS)
        for _, stage in C.STAGES:
            docs = C.stored(stage(spark, docs, ""), "test-stage")
        assert sorted(str(r.doc_id) for r in docs.collect()) == (["1", "None"] if data else [])
