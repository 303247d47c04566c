"""Quality by co-training of two views: what a text looks like, and where its page is.

Each view has its own logistic regression (Spark ML, over all labelled rows). In every
round a view gives labels to unlabelled documents of which it is confident; the other
view learns from them in the next round, with less weight than from real labels, and
never from its own. At the end each view is calibrated on a held-out fold of the labels,
and the score adds the calibrated log-odds of both views over the base rate.

Every document gets a score, an empty table an empty result. Texts are measured whole, however
long. Null and empty texts have text features of zero. Without both
kinds of labels every score is 0.5. Rows that repeat an id are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm import words as W
from docketry.plans.tables import stored

FEATURES = ["log_words", "word_length", "long_words", "upper", "digit", "symbol", "punctuation", "space", "non_ascii",
            "distinct_words", "distinct_lines", "top_word", "line_words", "sentence_ends", "pipes", "repeats"]
SPACES = " \n\t\r\x0b\x0c"


@dataclass(frozen=True)
class CoTraining:
    rounds: int = 2
    confident: float = 0.95    # probability from which a view labels for the other
    pseudo_weight: float = 0.3
    folds: int = 5             # one of them calibrates, and is never trained on
    hashed: int = 1 << 18      # dimensions of the metadata categories
    regularisation: float = 1e-3
    iterations: int = 12


_UPPER, _SYMBOL, _PUNCTUATION = regex.compile(r"\p{Lu}"), regex.compile(r"[#$%&*|<>=~^\\@_{}\[\]]"), regex.compile(r"[.,;:!?'\"()-]")


def _measure(text: str, hashes: np.ndarray, letters: int) -> list[float]:
    n, w = len(text), len(hashes)
    if not w:
        return [0.0] * len(FEATURES)
    lines = [x for x in text.split("\n") if x.strip()]
    _, counts = np.unique(hashes, return_counts=True)
    pairs = np.unique(hashes[1:] * np.uint64(31) + hashes[:-1]) if w > 1 else hashes
    return [
        float(np.log1p(w)), letters / w, letters > 12 * w, len(_UPPER.findall(text)) / n, sum(map(text.count, "0123456789")) / n,
        len(_SYMBOL.findall(text)) / n, len(_PUNCTUATION.findall(text)) / n, (n - letters) / n, 1 - len(text.encode("ascii", "ignore")) / n,
        len(counts) / w, len(set(lines)) / len(lines), counts.max() / w, min(w / len(lines), 200.0) / 200,
        sum(map(text.count, ".!?")) / w, text.count("|") / w, 1 - len(pairs) / max(w - 1, 1)]


def views(docs: DataFrame, metadata: list[str], p: CoTraining, pages: DataFrame | None = None) -> DataFrame:
    """``docs`` (id, text, then ``metadata``) as ``id, text_view, meta_view``, two vectors, in one pass over the texts.

    ``pages`` (id, then more metadata; an id may have many) is joined once the texts are numbers: all
    different values of a document's pages count, and the size class of their number. Metadata
    values are hashed categories; a null is a value of its own. A document's set of page values holds
    at most ``hashed`` numbers, however many pages it has.
    """
    docs = docs.select(F.col(docs.columns[0]).cast("bigint").alias("id"), F.col(docs.columns[1]).alias("text"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(f"meta_{c}") for c in metadata])
    names = ["id", "numbers", *docs.columns[2:]]

    def run(batches):
        for batch in batches:
            data, offsets = W.text_buffers(batch.column(1))
            rows, texts = [], batch.column(1).to_pylist()
            for first, last in W.slices(offsets):
                part = offsets[first:last + 1]
                hashes, bounds, _ = W.word_hashes(data[part[0]:part[-1]], part - part[0])
                for i in range(first, last):
                    text = texts[i] or ""
                    own = hashes[bounds[i - first]:bounds[i - first + 1]]
                    rows.append([float(x) for x in _measure(text, own, len(text) - sum(map(text.count, SPACES)))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], names=names)

    kinds = "".join(f", `{c}` string" for c in names[2:])
    measured = docs.mapInArrow(run, f"id bigint, numbers array<double>{kinds}")
    values = F.array(*[F.concat_ws("=", F.lit(c), F.col(c)) for c in names[2:]]).cast("array<string>")
    if pages is not None:
        more = pages.columns[1:]
        said = [F.xxhash64(F.lit(c), F.coalesce(F.col(f"page_{c}").cast("string"), F.lit("?"))) for c in more]
        own = pages.toDF("id", *[f"page_{c}" for c in more]).select(
            "id", F.explode(F.array(*said)).alias("value")).groupBy("id").agg(
            F.collect_set(F.pmod("value", F.lit(p.hashed))).alias("set"), F.count("*").alias("rows"))
        size = F.concat(F.lit("pages="), F.log2(F.col("rows") / len(more)).cast("int").cast("string"))
        own = own.select("id", F.concat(F.transform("set", lambda v: F.concat(F.lit("page"), v.cast("string"))), F.array(size)).alias("shown"))
        measured = measured.join(own, "id", "left")
        values = F.concat(values, F.coalesce("shown", F.array(F.lit("pages=?"))))
    hasher = HashingTF(inputCol="values", outputCol="meta_view", numFeatures=p.hashed, binary=True)
    return hasher.transform(measured.withColumn("values", values).withColumn("text_view", array_to_vector("numbers"))).select(
        "id", "text_view", "meta_view")


def _learn(rows: DataFrame, view: str, p: CoTraining) -> LogisticRegressionModel:
    learner = LogisticRegression(featuresCol=view, labelCol="y", weightCol="weight", maxIter=p.iterations,
                                 regParam=p.regularisation)
    return learner.fit(rows.select(view, "y", "weight"))


def _odds(model: LogisticRegressionModel, rows: DataFrame, view: str, name: str) -> DataFrame:
    """The model's log-odds of a good document as one more column."""
    model = model.setFeaturesCol(view).setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("")
    return model.transform(rows).withColumn(name, vector_to_array("__raw")[1]).drop("__raw")


def _calibrated(held: DataFrame, odds: str, p: CoTraining) -> Column:
    """Platt scaling of a view's log-odds on the held-out labels; as they are where one kind is missing."""
    rows = held.select(array_to_vector(F.array(odds)).alias("x"), "y", F.lit(1.0).alias("weight"))
    if rows.select("y").distinct().count() < 2:
        return F.col(odds)
    fit = _learn(rows, "x", p)
    return F.col(odds) * float(fit.coefficients[0]) + float(fit.intercept)


def co_train(docs: DataFrame, labels: DataFrame, metadata: list[str], p: CoTraining = CoTraining(),
             pages: DataFrame | None = None) -> DataFrame:
    """``id, p_text, p_meta, score`` for every row of ``docs`` (id, text, then ``metadata``).

    ``labels`` is ``id, good`` (boolean); an id with both labels counts as unlabelled.
    """
    known = labels.toDF("id", "good").where("good is not null").groupBy("id").agg(
        F.min("good").alias("good"), F.max("good").alias("other")).where("good = other")
    rows = views(docs, metadata, p, pages).join(known.select("id", F.col("good").cast("double").alias("y")), "id", "left")
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(p.folds))), "quality-views")
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    labelled = rows.where("y is not null and fold <> 0").withColumn("weight", F.lit(1.0))
    kinds = {r.y: r.n for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        half = F.lit(0.5)
        return rows.select("id", half.alias("p_text"), half.alias("p_meta"), half.alias("score"))
    open_rows = rows.where("y is null").drop("y")
    seen = ("text_view", "meta_view")
    models = {view: _learn(labelled.coalesce(tasks), view, p) for view in seen}
    edge = float(np.log(p.confident / (1 - p.confident)))
    for _ in range(p.rounds):
        # Both views hand over labels before either learns from them.
        offered = {view: _odds(models[view], open_rows, view, "odds").where(F.abs("odds") >= edge).select(
            *seen, (F.col("odds") > 0).cast("double").alias("y"), F.lit(p.pseudo_weight).alias("weight")) for view in seen}
        own = labelled.select(*seen, "y", "weight")
        models = {view: _learn(own.unionByName(offered[other]).coalesce(tasks), view, p)
                  for view, other in (seen, seen[::-1])}
    scored = _odds(models["meta_view"], _odds(models["text_view"], rows, "text_view", "text_odds"), "meta_view", "meta_odds")
    held = scored.where("y is not null and fold = 0").coalesce(tasks)
    text, meta = (_calibrated(held, c, p) for c in ("text_odds", "meta_odds"))
    base = float(np.log(kinds[1.0] / kinds[0.0]))

    def chance(odds: Column) -> Column:
        return 1 / (1 + F.exp(-odds))

    return scored.select("id", chance(text).alias("p_text"), chance(meta).alias("p_meta"),
                         chance(text + meta - base).alias("score"))
