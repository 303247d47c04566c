"""Case search for many queries at once, and the reasons shown with the results."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import enrich as E
from docketry.functions import facets as A
from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.plans import blocks as P
from docketry.plans import prose as T
from docketry.plans import tokens as W

# fixed values: score weights and limits
SECOND_WEIGHT = 0.5
W_TERM, W_VECTOR, W_SIMILARITY, W_PRIORITY = 14.0, 85.0, 0.35, 0.2
OFFLINE = (20.0, 0.0, 1.0, 0.4)
MAX_RESULTS = 10
EXPLAIN_TERMS = 6


def search_blob(cases: DataFrame) -> Column:
    parts = ["title", "summary", "judgment", "final_verdict", "why_match"]
    return F.concat_ws(
        " ", *[X.blank(c) for c in parts], F.array_join(F.col("tags"), " "), X.blank("citation")
    )


def _vectors(c: Column) -> Column:
    """Bucket lists of all tokens, repeats kept, at any length."""
    return X.let(
        X.words(c, 3),
        lambda t: F.struct(H.buckets(t, H.SEED_A).alias("first"), H.buckets(t, H.SEED_B).alias("second")),
    )


def prepare_queries(q: pd.DataFrame) -> dict:
    terms, asked_by = P.vocabulary(q["terms"])
    return {
        "n": len(q),
        "matcher": P.TermMatcher(list(terms)),
        # A repeated term counts as often as it is typed.
        "asked_by": asked_by,
        "vectors": P.hashed_matrix(list(q["first"]), list(q["second"]), SECOND_WEIGHT, H.DIMS),
    }


def _hashed(texts: pa.Array) -> np.ndarray:
    """``hashed_matrix`` of lower-cased texts."""
    owner, tokens = W.words(texts)
    coded = tokens.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    out = np.zeros((len(texts), H.DIMS))
    for seed, weight in ((H.SEED_A, 1.0), (H.SEED_B, SECOND_WEIGHT)):
        buckets = (W.fnv1a(coded.dictionary, seed) % np.uint64(H.DIMS)).astype(np.int64)
        out += weight * P.add_up(owner, buckets[code], out.shape)
    return out


def scorer(w_term: float, w_vector: float):
    def score(state: dict, rows: P.Rows, floors: np.ndarray | None = None) -> np.ndarray:
        blob = rows.arrow("blob")
        words = pc.split_pattern_regex(blob, T.SPACES)
        owner = np.repeat(np.arange(len(blob)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        hits = P.owner_counts(state["matcher"].rows((owner, words.flatten())), state["asked_by"], (len(rows), state["n"]))
        total = w_term * hits + rows["base"].to_numpy(float)[:, None]
        if w_vector:
            mine = _hashed(blob)
            total = total + w_vector * P.cosine_matrix(mine, state["vectors"])
        return np.where(total > 0, total, -np.inf)

    return score


def search_cases(queries: DataFrame, cases: DataFrame, k: int = 5, offline: bool = False,
                 max_queries: int = P.MAX_QUERIES) -> DataFrame:
    """``query_id, text`` against enriched cases: the best ``k`` (1-10) per query.

    Score: typed terms found as substrings, hashed-vector cosine, baseline similarity,
    priority and outcome words. ``offline`` uses the lighter weights without vectors.
    """
    k = min(max(int(k), 1), MAX_RESULTS)
    w_term, w_vector, w_sim, w_pri = OFFLINE if offline else (W_TERM, W_VECTOR, W_SIMILARITY, W_PRIORITY)
    typed = F.lower(X.trim_wide("text"))
    features = queries.select(
        "query_id", typed.alias("text"),
        F.filter(F.split(typed, f"{X.SPACE}+"), lambda t: t != "").alias("terms"),
        _vectors(typed).alias("v"),
    ).select("query_id", "text", "terms", "v.first", "v.second")
    blank, features = features.filter(F.col("text") == ""), features.filter(F.col("text") != "")
    blob = F.lower(
        F.concat_ws(" ", X.blank("title"), X.blank("summary"), X.blank("why_match"), F.array_join(F.col("tags"), " "))
    ) if offline else F.lower(search_blob(cases))
    bonus = F.lit(0) if offline else E.verdict_signal(
        F.coalesce(F.nullif(X.blank("judgment"), F.lit("")), X.blank("summary"))
    )
    base = F.col("similarity") * w_sim + F.coalesce("priority_score", F.lit(0)) * w_pri + bonus
    carry = ["ord", "id", "title", "court", "year", "similarity", "type", "summary", "judgment", "tags", "final_verdict"]
    # Words and vectors of the cases are told in the tasks that score them.
    rows = cases.select(*carry, base.alias("base"), blob.alias("blob"))
    found = P.top_rows(
        rows, features, prepare_queries, scorer(w_term, w_vector), k, carry, floor=-1e9, max_queries=max_queries
    )
    scored = found.withColumnRenamed("score", "rank_score").select(
        "*",
        X.clamp(X.round_half_up("rank_score"), 40, 99).cast("int").alias("shown_similarity"),
        A.match_level(F.col("rank_score") / 100).alias("match_level"),
    )
    # A blank query gets the first k cases (at most ten rows) as they are stored.
    first = cases.select(*carry).orderBy("ord").limit(k)
    first = first.withColumn("rank", F.row_number().over(Window.orderBy("ord")))
    return scored.unionByName(blank.select("query_id").join(F.broadcast(first), F.lit(True)).select(
        "query_id", *carry, F.lit(None).cast("double").alias("rank_score"), "rank",
        F.col("similarity").cast("int").alias("shown_similarity"), A.match_level(F.col("similarity") / 100).alias("match_level"),
    ))


def phrases(c: X.ColumnLike) -> Column:
    """Distinct provision and act phrases of a text."""
    # fixed values: phrase shapes
    shapes = [r"article\s+\d+[a-z]?", r"section\s+\d+[a-z]?", r"[a-z][a-z\s]{2,40}\s+act", r"[a-z][a-z\s]{2,30}\s+law"]
    found = F.concat(
        *[F.regexp_extract_all(X.blank(c), F.lit(X.word_re(s, True)), F.lit(0)) for s in shapes]
    )
    return F.array_distinct(F.transform(found, lambda p: F.trim(F.regexp_replace(p, f"{X.SPACE}+", " "))))


def explain_matches(results: DataFrame, stop: Sequence[str] = tuple(L.EXPLAIN_STOP_WORDS)) -> DataFrame:
    """Add ``matched_terms`` (phrases, then shared tokens, at most six) and ``why_matched``.

    ``results`` has ``query_text`` and the case text columns. Narrow.
    """
    text = F.concat_ws(
        " ", X.blank("title"), X.blank("summary"), X.blank("judgment"), F.array_join(F.col("tags"), " ")
    )
    shared = F.array_intersect(X.tokens("query_text", list(stop), 4), X.tokens(text, list(stop), 4))
    terms = F.slice(
        F.array_distinct(F.concat(phrases(F.concat_ws(" ", X.blank("query_text"), text)), shared)), 1, EXPLAIN_TERMS
    )
    # fixed values: the sentence's parts
    lead = F.when(
        F.size("matched_terms") > 0,
        F.concat(F.lit("shared legal terms ("), F.array_join(F.slice("matched_terms", 1, 3), ", "), F.lit(")")),
    ).otherwise("similar legal issues and factual patterns")
    return results.withColumn("matched_terms", terms).withColumn(
        "why_matched",
        F.concat(
            F.lit("This case matches due to "), lead,
            F.lit(", comparable statutory context, and aligned judgement outcomes."),
        ),
    )
