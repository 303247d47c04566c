"""Language ID: the kernel against plain sets, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from docketry.llm import language as L

TEXTS = {"en": "the and of that with from this is on and in the her them", "de": "der und die nicht ein mit von auf sich ist",
         "fr": "le la et des que pour dans ce qui sur les"}


def rows(seed=1, n=120):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = list(TEXTS)[i % 3]
        out.append((i, " ".join(rng.choice(TEXTS[lang].split(), rng.integers(5, 60))), lang))
    return out


def test_presence_kernel_is_shared_grams():
    p = L.StringKernel(longest=3)

    def grams(text):
        t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        while "  " in t:
            t = t.replace("  ", " ")
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    a, b = "Der Hund, 12 Ähren!", "den Hut und Ähre"
    x, y = L._grams(a, p), L._grams(b, p)
    assert len(x) == len(grams(a)) and len(y) == len(grams(b))
    assert len(np.intersect1d(x, y)) == len(grams(a) & grams(b))


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "en"), (901, "", "en"), (902, " 12 !? ²", "de"), (903, "the and of", None), (None, "le la et des", "fr")]
    docs = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string")
    docs = docs.withColumn("held_out", L.held_out(docs.doc_id)).repartition(3)
    model = L.fit(docs.where("not held_out").select("lang", "text", "doc_id"))
    got = {r.doc_id: r for r in L.predict(docs.drop("lang"), model).collect()}
    assert model.languages == ["de", "en", "fr"]
    for key, _, lang in rows():
        assert got[key].held_out == (zlib.crc32(str(key).encode()) % 4 == 2)
        assert got[key].lang_pred == lang and 0 < got[key].score <= 1
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[901].score == 0
    assert got[903].lang_pred == "en" and got[None].lang_pred == "fr"


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = L.fit(docs.select("lang", "text", "doc_id"))
    assert L.predict(docs, model).first().lang_pred == "und"
    assert L.predict(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("sample", [5, 600])
def test_sample_bound(spark, sample):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    model = L.fit(docs.select("lang", "text", "doc_id"), L.StringKernel(sample=sample, landmarks=4))
    assert model.landmark.shape[1] == 12
