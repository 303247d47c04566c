"""Hybrid retrieval of many queries over a chunk index.

gate -> expansion -> exact score -> pool -> per-case cap -> diversity re-rank ->
thresholds -> sources and confidence. Everything up to the pool runs where the chunks
lie; from there on a query owns at most ``POOL_MAX`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators import bm25 as M
from docketry.operators import chunks as C
from docketry.plans import blocks as P

# fixed values: score weights, limits, section weights
W_COSINE, W_BM25, W_KEYWORD, W_TITLE = 0.5, 0.32, 0.10, 0.03
BM25_HALF = 6.0
SHARPNESS = 2.2
W_EXACT = 0.22
PHRASE_STEP, PHRASE_CAP, PHRASE_LIMIT = 0.05, 0.14, 3
REF_STEP, REF_CAP = 0.06, 0.12
SCORE_CAP = 0.995
SECTION_WEIGHTS = {"Judgment": 1.0, "Summary": 0.92}
OTHER_SECTION = 0.85
SCORE_FLOOR = (0.12, 0.6)
TOP_K = (1, 12)
PER_CASE = 2
KEEP_ABOVE, KEEP_ROWS, MAX_SOURCES = 0.4, 3, 5
MMR_LAMBDA = 0.78
POOL_MAX = 72
# Rounding slack of a bound
SLACK = 1e-8

CARRY = [
    "ord", "id", "case_id", "title", "section", "court", "year", "type", "final_verdict", "text", "terms",
]


@dataclass(frozen=True)
class QueryRules:
    stop: tuple = tuple(L.STOP_WORDS)
    domain_terms: tuple = tuple(L.DOMAIN_TERMS)
    domain_pattern: str = L.DOMAIN_QUERY_PATTERN
    synonyms: dict = field(default_factory=lambda: dict(L.SYNONYMS))


def gate_queries(queries: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """Queries of the domain: a pattern or a lexicon token."""
    text = F.lower(X.squash("text"))
    lexicon = F.array(*[F.lit(t) for t in rules.domain_terms])
    in_domain = text.rlike(rules.domain_pattern) | F.arrays_overlap(
        X.tokens("text", list(rules.stop)), lexicon
    )
    return queries.filter((text != "") & in_domain)


def expand_tokens(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """Tokens followed by the synonyms of each, without repeats."""
    if not synonyms:
        return tokens
    pairs = [x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))]
    table = F.create_map(*pairs)
    extra = F.flatten(
        F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>")))
    )
    return F.array_union(tokens, extra)


def query_features(queries: DataFrame, rules: QueryRules = QueryRules(), default_k: int = 4,
                   default_min: float = 0.22) -> DataFrame:
    """``query_id, text`` (and optional ``top_k, min_score``) to the columns scored."""
    stop = list(rules.stop)
    has = set(queries.columns)
    k = F.coalesce(F.col("top_k"), F.lit(default_k)) if "top_k" in has else F.lit(default_k)
    low = F.coalesce(F.col("min_score"), F.lit(default_min)) if "min_score" in has else F.lit(default_min)
    base = gate_queries(queries, rules).select(
        "query_id",
        X.squash("text").alias("text"),
        X.clamp(k, *TOP_K).cast("int").alias("top_k"),
        X.clamp(low, *SCORE_FLOOR).cast("double").alias("min_score"),
        X.tokens("text", stop).alias("tokens"),
        X.without(X.words("text", 4), stop).alias("long_words"),
        C.references("text").alias("refs"),
    )
    n = F.size("long_words")
    pairs = F.zip_with(
        F.slice("long_words", F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice("long_words", F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return base.select(
        "*",
        pairs.alias("phrases"),
        expand_tokens(F.col("tokens"), rules.synonyms).alias("expanded"),
        H.buckets(F.col("tokens"), H.SEED_A).alias("first"),
        H.buckets(F.col("tokens"), H.SEED_B).alias("second"),
    ).drop("long_words")


def with_rarity(features: DataFrame, df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the document frequency of each expanded token and the index statistics.

    The grouping key is a query; a group holds that query's tokens only.
    """
    frequencies = (
        X.exploded(features, F.col("expanded"), ["token"], ["query_id"])
        .join(df, "token", "left")
        .groupBy("query_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("df", F.lit(0)).alias("df")))).alias("dfs"))
    )
    return features.join(frequencies, "query_id", "left").select(
        "*",
        F.transform("expanded", lambda t: F.element_at(F.col("dfs"), t)).alias("expanded_df"),
        stats.select("n_chunks").scalar().alias("n_chunks"),
        stats.select("avg_chunk_length").scalar().alias("mean_length"),
    ).drop("dfs")


def prepare_queries(q: pd.DataFrame) -> dict:
    """Pack a block of queries for scoring."""
    rarity = {}
    for tokens, dfs in zip(q["expanded"], q["expanded_df"]):
        rarity.update(zip(tokens, dfs))
    n_chunks = float(max(1, q["n_chunks"].iloc[0])) if len(q) else 1.0
    expanded, expanded_of = P.vocabulary(q["expanded"])
    df = np.array([rarity[t] for t in expanded], float)
    exact, exact_of = P.vocabulary(q["tokens"])
    phrases, phrases_of = P.vocabulary(q["phrases"])
    refs, refs_of = P.vocabulary(q["refs"])
    sizes = lambda column: q[column].map(len).to_numpy(float)
    return {
        "n": len(q),
        "vectors": P.hashed_matrix(list(q["first"]), list(q["second"]), C.SECOND_WEIGHT, H.DIMS),
        "expanded": pa.array(list(expanded), pa.string()), "expanded_of": expanded_of,
        "idf": np.log(1 + (n_chunks - df + 0.5) / (df + 0.5)),
        "exact": pa.array(list(exact), pa.string()), "exact_of": exact_of,
        "titles": P.TermMatcher(list(exact)),
        "phrases": P.TermMatcher(list(phrases)), "phrases_of": phrases_of,
        "refs": refs, "refs_of": refs_of,
        "n_tokens": np.maximum(1, sizes("tokens")), "n_expanded": np.maximum(1, sizes("expanded")),
        "phrase_limit": np.minimum(PHRASE_LIMIT, sizes("phrases")),
        "mean_length": float(max(1.0, q["mean_length"].iloc[0])) if len(q) else 1.0,
        "min_score": q["min_score"].to_numpy(float),
    }


def score_rows(state: dict, rows: P.Rows, floors: np.ndarray | None = None) -> np.ndarray:
    """Rows x queries matrix of the hybrid score; below the query's floor is -inf.

    Title words, phrases and references add a bounded amount, so texts are only looked at in
    rows that can still reach the floor of some query.
    """
    shape = (len(rows), state["n"])
    cosine = P.cosine_matrix(P.hashed_lists(rows, "first", "second", C.SECOND_WEIGHT, H.DIMS), state["vectors"])
    lexical, keyword = M.lexical_sums(state, rows, M.impacts(state, rows))
    keyword = keyword / state["n_expanded"]
    row, query, _, _ = M.token_hits(rows, state["exact"], state["exact_of"])
    exact = P.add_up(row, query, shape) / state["n_tokens"]
    core = W_COSINE * cosine + W_BM25 * lexical / (lexical + BM25_HALF) + W_KEYWORD * keyword
    weight = rows["section"].map(SECTION_WEIGHTS).fillna(OTHER_SECTION).to_numpy(float)[:, None]

    def total(part, titles, boost):
        raw = 1 - np.exp(-SHARPNESS * np.maximum(0, core[part] + W_TITLE * titles)) + W_EXACT * exact[part] + boost
        return np.minimum(SCORE_CAP, raw * weight[part])

    least = state["min_score"] if floors is None else np.maximum(state["min_score"], floors)
    reach = (total(slice(None), 1.0, most_boost(state)) + SLACK >= least).any(1)
    score = np.full(shape, -np.inf)
    at = np.flatnonzero(reach)
    if len(at):
        close = rows.take(at)
        score[at] = total(at, _titles(state, close), _boost(state, close))
    return np.where(score < state["min_score"], -np.inf, score)


def most_boost(state: dict) -> np.ndarray:
    """What phrases and references can add at most, per query."""
    asked = np.bincount([q for owners in state["refs_of"] for q in owners], minlength=state["n"])[:state["n"]]
    return np.minimum(PHRASE_CAP, PHRASE_STEP * state["phrase_limit"]) + np.minimum(REF_CAP, REF_STEP * asked)


def _titles(state: dict, rows: P.Rows) -> np.ndarray:
    found = state["titles"].rows(rows.lists("title_words"))
    return P.owner_counts(found, state["exact_of"], (len(rows), state["n"])) / state["n_tokens"]


def _boost(state: dict, rows: P.Rows) -> np.ndarray:
    shape = (len(rows), state["n"])
    inside = [sorted(state["phrases"].inside(t)) for t in rows["text_low"]] if state["phrases"].terms else [[]] * len(rows)
    phrase = P.owner_counts(P.expand(np.arange(len(rows)), inside), state["phrases_of"], shape)
    shared = [[state["refs"][r] for r in refs if r in state["refs"]] for refs in rows["refs"]] if state["refs"] else [[]] * len(rows)
    refs = P.owner_counts(P.expand(np.arange(len(rows)), shared), state["refs_of"], shape)
    boost = np.minimum(PHRASE_CAP, PHRASE_STEP * np.minimum(phrase, state["phrase_limit"]))
    return boost + np.minimum(REF_CAP, REF_STEP * refs)


def candidate_pool(queries: DataFrame, chunks: DataFrame, df: DataFrame, stats: DataFrame,
                   rules: QueryRules = QueryRules(), default_k: int = 4, default_min: float = 0.22,
                   max_queries: int = P.MAX_QUERIES) -> DataFrame:
    """Best ``max(6k, 24)`` chunks per query at or above its minimum score."""
    features = with_rarity(query_features(queries, rules, default_k, default_min), df, stats)
    rows = scored_rows(chunks)
    best = P.top_rows(
        rows, features, prepare_queries, score_rows, POOL_MAX, ["ord"], floor=-1e9, max_queries=max_queries
    )
    limits = features.select("query_id", "top_k")
    pool = best.join(limits, "query_id").filter(F.col("rank") <= F.greatest(F.col("top_k") * 6, F.lit(24)))
    return with_chunks(pool, chunks)


def with_chunks(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk columns of chosen rows, which came through the exchange as ordinals."""
    return chunks.select(*[c for c in CARRY if c != "terms"], F.map_keys("token_freq").alias("terms")).join(pool, "ord").select(
        "query_id", *CARRY, "score", "rank", "top_k")


def scored_rows(chunks: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The columns of a chunk table that ``score_rows`` reads, and ``more``."""
    return chunks.select(
        "ord", "section", *more,
        F.map_keys("token_freq").alias("terms"), F.map_values("token_freq").alias("tfs"),
        "length", F.col("sparse.first").alias("first"), F.col("sparse.second").alias("second"),
        F.split(F.lower(X.squash("title")), " ").alias("title_words"),
        F.lower(X.squash("text")).alias("text_low"),
        C.references(F.concat_ws(" ", X.blank("title"), X.blank("text"))).alias("refs"),
    )


def cap_per_case(pool: DataFrame) -> DataFrame:
    """At most two chunks of a case, then the first ``max(3k, 12)``, renumbered."""
    by_case = Window.partitionBy("query_id", "case_id").orderBy("rank")
    by_query = Window.partitionBy("query_id").orderBy("rank")
    return (
        pool.withColumn("__case", F.row_number().over(by_case))
        .filter(F.col("__case") <= PER_CASE)
        .withColumn("pos", F.row_number().over(by_query))
        .filter(F.col("pos") <= F.greatest(F.col("top_k") * 3, F.lit(12)))
        .drop("__case")
    )


def _diversify(group: pd.DataFrame) -> pd.DataFrame:
    """Greedy: relevance against the largest overlap with what is already chosen."""
    group = group.sort_values("pos").reset_index(drop=True)
    tokens = [set(t) for t in group["terms"]]
    nearest = np.zeros(len(group))
    open_rows = list(range(len(group)))
    order = []
    while open_rows and len(order) < int(group["top_k"].iloc[0]):
        gain = MMR_LAMBDA * group["score"].to_numpy()[open_rows] - (1 - MMR_LAMBDA) * nearest[open_rows]
        pick = open_rows.pop(int(np.argmax(gain)))
        order.append(pick)
        for i in open_rows:
            union = len(tokens[i] | tokens[pick])
            shared = len(tokens[i] & tokens[pick]) / union if tokens[i] and tokens[pick] else 0.0
            nearest[i] = max(nearest[i], shared)
    return group.iloc[order].assign(pos=range(1, len(order) + 1))


def mmr(candidates: DataFrame) -> DataFrame:
    """Diversity re-rank of each query's candidates (at most 36 rows per group)."""
    return candidates.groupBy("query_id").applyInPandas(_diversify, candidates.schema)


def keep_best(ranked: DataFrame) -> DataFrame:
    """The first three above 0.4, or the first three when none is."""
    by_query = Window.partitionBy("query_id")
    above = F.col("score") > KEEP_ABOVE
    return (
        ranked.withColumn("__any", F.max(above.cast("int")).over(by_query))
        .filter((F.col("__any") == 0) | above)
        .withColumn("pos", F.row_number().over(by_query.orderBy("pos")).cast("int"))
        .filter(F.col("pos") <= KEEP_ROWS)
        .drop("__any")
    )


def title_key(c: X.ColumnLike) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(X.blank(c), f"{X.SPACE}+", " "), "[^a-zA-Z0-9. ]", ""))


def to_sources(hits: DataFrame) -> DataFrame:
    """Last chunk per title in the place of the first, best per case, at most five."""
    q = Window.partitionBy("query_id", "clean_title")
    by_title = (
        hits.withColumn("clean_title", title_key("title"))
        .filter(F.col("clean_title") != "")
        .withColumn("__place", F.min("pos").over(q))
        .withColumn("__last", F.row_number().over(q.orderBy(F.desc("pos"))))
        .filter(F.col("__last") == 1)
    )
    c = Window.partitionBy("query_id", "case_id")
    by_case = (
        by_title.withColumn("__first", F.min("__place").over(c))
        .withColumn("__best", F.row_number().over(c.orderBy(F.desc("score"), "__place")))
        .filter(F.col("__best") == 1)
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "__first")
    cleaned = C.clean_chunk("text")
    cut = F.when(F.length(cleaned) <= 240, cleaned).otherwise(
        F.concat(F.trim(F.substring(cleaned, 1, 240)), F.lit("..."))
    )
    excerpt = C.clean_chunk(cut)
    stand_in = F.concat(
        F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("General")), F.lit(" judgment — "),
        F.coalesce(F.nullif(F.col("court"), F.lit("")), F.lit("Supreme Court of India")), F.lit(" ("),
        F.coalesce(F.col("year").cast("string"), F.lit("N.A.")), F.lit(")"),
    )
    dirty = (F.length("excerpt") < 40) | F.lower("excerpt").contains("case title extracted") | (
        F.regexp_count("excerpt", F.lit(";")) > 2
    ) | F.col("excerpt").rlike(r"(?i)decision\s*:\s*0")
    return (
        by_case.withColumn("source_no", F.row_number().over(final))
        .filter(F.col("source_no") <= MAX_SOURCES)
        .withColumn("excerpt", excerpt)
        .select(
            "query_id", "source_no", "case_id", "clean_title", "court", "year", "type", "final_verdict",
            "section", F.round("score", 4).alias("score"),
            F.when(dirty, stand_in).otherwise(F.col("excerpt")).alias("excerpt"),
        )
    )


def confidence(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """0-100 figure per query from the mean of its best scores and its source count."""
    top = hits.groupBy("query_id").agg(
        F.avg("score").alias("__mean"), F.first("top_k").alias("__k")
    )
    found = sources.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"))
    coverage = F.least(
        F.lit(1.0),
        F.coalesce("n_sources", F.lit(0)) / F.greatest(F.lit(1), F.least(F.lit(5), F.col("__k"))),
    )
    return top.join(found, "query_id", "left").select(
        "query_id",
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        X.clamp(
            X.round_half_up(F.round((F.col("__mean") * 0.9 + coverage * 0.1) * 100, 6)), 40, 99
        ).alias("confidence"),
    )


def outcome_class(hits: DataFrame) -> DataFrame:
    """Outcome signal of the text retrieved for each query (at most three chunks)."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    return hits.groupBy("query_id").agg(F.lower(F.array_join(texts, " ")).alias("__all")).select(
        "query_id", X.first_rule("__all", L.OUTCOME_RULES, "undetermined").alias("outcome")
    )


def answers(queries: DataFrame, confidence_rows: DataFrame, rules: QueryRules = QueryRules()) -> DataFrame:
    """One row per query, also for those without hits: ``query_id, state, grounded, n_sources, confidence``.

    ``state`` is ``blank``, ``out_of_domain``, ``no_hits`` or ``grounded``; all but the last
    have confidence 0 and no sources.
    """
    inside = gate_queries(queries, rules).select("query_id", F.lit(True).alias("inside")).distinct()
    joined = queries.select("query_id", X.squash("text").alias("text")).join(inside, "query_id", "left").join(
        confidence_rows, "query_id", "left")
    state = (
        F.when(F.col("text") == "", "blank").when(F.col("inside").isNull(), "out_of_domain")
        .when(F.col("confidence").isNull(), "no_hits").otherwise("grounded")
    )
    return joined.select(
        "query_id", state.alias("state"), (state == "grounded").alias("grounded"),
        F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("confidence", F.lit(0)).cast("int").alias("confidence"),
    )


@dataclass
class Retrieval:
    hits: DataFrame
    sources: DataFrame
    confidence: DataFrame
    answers: DataFrame


def retrieve(queries: DataFrame, chunks: DataFrame, df: DataFrame, stats: DataFrame,
             rules: QueryRules = QueryRules(), default_k: int = 4, default_min: float = 0.22,
             diversity: bool = True, max_queries: int = P.MAX_QUERIES) -> Retrieval:
    """All stages. Queries that are blank, outside the domain or without hits have a row in ``answers`` only."""
    pool = candidate_pool(queries, chunks, df, stats, rules, default_k, default_min, max_queries)
    candidates = cap_per_case(pool)
    ranked = mmr(candidates) if diversity else candidates.filter(F.col("pos") <= F.col("top_k"))
    hits = keep_best(ranked)
    sources = to_sources(hits)
    found = confidence(hits, sources)
    return Retrieval(hits, sources, found, answers(queries, found, rules))
