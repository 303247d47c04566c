"""Language identification with blended-spectrum string kernels.

A text is the set of its character n-grams of 1 to ``longest`` code points (lower case,
anything but letters is one blank), hashed into ``dims`` presence features. The kernel of
two texts is the number of features they share, divided by the root of the product of
their sizes. ``landmarks`` texts span the Nyström space, and one-versus-rest ridge
regression in it gives a score per language. Scoring is one product of a batch's presence
matrix with the landmark matrix, and one of its kernel values with the regression weights.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language
first in alphabetical order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.names import refuse

UNDETERMINED = "und"


@dataclass(frozen=True)
class StringKernel:
    longest: int = 4
    dims: int = 1 << 15        # at most 2^16
    sample: int = 600          # most labelled rows of one language used for fitting
    landmarks: int = 48        # landmarks of one language
    ridge: float = 1e-3
    batch: int = 128           # texts of one matrix product


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    landmark: np.ndarray       # dims x m presence, divided by the root of its size
    weights: np.ndarray        # m x languages
    kernel: StringKernel


def _grams(text: str, p: StringKernel) -> np.ndarray:
    """Sorted distinct features of a text; empty where it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int64)
    kinds, back = np.unique(code, return_inverse=True)
    letter = np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[back]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    last = len(code) - 1 - int(letter[::-1].argmax())
    keep[last + 1:] = False
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint64)
    found, value = [], np.zeros(len(code), np.uint64)
    for n in range(1, min(p.longest, len(code)) + 1):
        value = value[:len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(n)
        mixed = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(mixed >> np.uint64(40))
    mark = np.zeros(p.dims, bool)
    for x in found:
        mark[x % np.uint64(p.dims)] = True
    return np.flatnonzero(mark)


def features(docs: DataFrame, p: StringKernel) -> DataFrame:
    """``lang, grams`` (16-bit feature numbers) of labelled rows, for a bounded sample."""

    def run(batches):
        for batch in batches:
            grams = [_grams(t or "", p).astype("<u2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.binary())], names=["lang", "grams"])

    return docs.mapInArrow(run, "lang string, grams binary")


def fit(labelled: DataFrame, p: StringKernel = StringKernel()) -> LanguageModel:
    """Fit on at most ``p.sample`` rows of each language of ``labelled`` (lang, text, key).

    Rows with a null language take no part. The sample of a language is its rows of
    lowest key hash; a hash threshold from the counts keeps all others out of the sort.
    Without any labelled letter there are no languages, and every text is ``und``.
    """
    labelled = labelled.toDF("lang", "text", "key").where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if counts:
        share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * p.sample / n))])
        draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
        drawn = labelled.withColumn("draw", draw).where(F.col("draw") <= share[F.col("lang")])
        first = Window.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
        drawn = drawn.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= p.sample)
        rows = features(drawn.select("lang", "text"), p).collect()
    else:
        rows = []
    rows = sorted((r.lang, bytes(r.grams)) for r in rows if r.grams)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros((p.dims, 1), np.float32), np.zeros((1, 0)), p)
    sets = [np.frombuffer(g, "<u2").astype(np.int64) for _, g in rows]
    target = np.array([[lang == x for x in languages] for lang, _ in rows], float)
    chosen = []
    for i in range(len(languages)):
        own = np.flatnonzero(target[:, i])
        chosen.extend(own[np.linspace(0, len(own) - 1, min(p.landmarks, len(own))).astype(int)])
    landmark = np.zeros((p.dims, len(chosen)), np.float32)
    for j, row in enumerate(chosen):
        landmark[sets[row], j] = 1 / np.sqrt(len(sets[row]))
    kernel = np.concatenate([_kernel(sets[at:at + p.batch], landmark) for at in range(0, len(sets), p.batch)]).astype(float)
    # Nyström: K ~ C W^-1 C'. Ridge regression in the space of W^-1/2.
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    balance = (1 / target.sum(axis=0))[target.argmax(axis=1)][:, None] * len(rows) / len(languages)
    left = phi.T @ (balance * phi) + p.ridge * len(rows) * np.eye(phi.shape[1])
    beta = np.linalg.solve(left, phi.T @ (balance * target))
    return LanguageModel(languages, landmark, root @ beta, p)


def _kernel(sets: list[np.ndarray], landmark: np.ndarray) -> np.ndarray:
    """Normalised kernel values of a batch: presence matrix times landmark matrix."""
    presence = np.zeros((len(sets), landmark.shape[0]), np.float32)
    for i, s in enumerate(sets):
        presence[i, s] = 1 / np.sqrt(max(len(s), 1))
    return presence @ landmark


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", language: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) as two more columns.

    Rows are judged one by one, also those that repeat an id, and texts whole, however long. Names that
    the table has already are refused.
    """
    refuse(docs.columns, language, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            best = np.full(batch.num_rows, len(m.languages))
            value = np.zeros(batch.num_rows)
            texts = batch.column(at).to_pylist()
            for first in range(0, len(texts), m.kernel.batch) if m.languages else ():
                sets = [_grams(t or "", m.kernel) for t in texts[first:first + m.kernel.batch]]
                rows = np.flatnonzero([len(s) > 0 for s in sets])
                scores = _kernel(sets, m.landmark).astype(float) @ m.weights
                best[first + rows] = scores[rows].argmax(axis=1)
                value[first + rows] = np.clip(scores[rows].max(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(value, pa.float64())],
                names=[*batch.schema.names, language, score])

    return docs.mapInArrow(run, f"{fields}, `{language}` string, `{score}` double")


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
