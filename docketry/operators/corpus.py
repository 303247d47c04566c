"""Corpus jobs: enrichment, deduplication, assembly, listings and filters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import enrich as E
from docketry.functions import facets as A
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators.chunks import references
from docketry.plans.ordinal import with_ordinal


@dataclass(frozen=True)
class EnrichRules:
    priority: L.PriorityRules = field(default_factory=L.PriorityRules)
    verdicts: tuple = tuple(L.VERDICT_RULES)
    anchors: tuple = tuple(L.JUDGMENT_ANCHORS)
    tags: tuple = tuple(L.TAG_RULES)
    cues: tuple = tuple(L.SUMMARY_CUES)


def enrich_cases(raw: DataFrame, rules: EnrichRules = EnrichRules()) -> DataFrame:
    """Raw cases (plus an ``ord`` column) to enriched cases in one narrow pass.

    ``issues`` and ``decision`` columns are used when present; otherwise the labelled
    segments of the body are.
    """
    have = set(raw.columns)
    issues = F.col("issues") if "issues" in have else X.segment("full_text", "Issues:")
    decision = F.col("decision") if "decision" in have else X.segment("full_text", "Decision:")
    body = F.coalesce(
        F.nullif(X.blank("full_text"), F.lit("")), F.nullif(X.blank("summary"), F.lit("")), X.blank("title")
    )
    year = F.regexp_extract(F.substring(X.blank("decision_date"), 1, 4), r"^\s*(\d+)", 1).try_cast("int")
    base = raw.select(
        F.col("case_id").alias("id"), "ord", "title", "court",
        F.coalesce(F.nullif(year, F.lit(0)), F.lit(2000)).alias("year"),
        X.blank("citation").alias("citation"),
        X.blank("decision_date").alias("decided"),
        F.coalesce(F.nullif(X.blank("case_type"), F.lit("")), F.lit("General")).alias("type"),
        X.blank("jurisdiction").alias("jurisdiction"),
        issues.alias("issues"), decision.alias("decision"),
        E.judgment_excerpt("full_text", decision, "summary", rules.anchors).alias("raw_judgment"),
        E.summary(body, rules.cues).alias("summary"),
    )
    scored = base.select(
        "id", "ord", "title", "court", "year", "citation", "type", "summary", "raw_judgment",
        E.similarity("title", "issues", "decision", "citation").alias("similarity"),
        E.priority("title", "issues", "decision", "citation", "decided", rules.priority).alias("priority_score"),
        E.summary("raw_judgment", rules.cues).alias("judgment"),
        E.verdict("raw_judgment", "summary", rules.verdicts).alias("outcome"),
        E.why_match("issues", "decision", "citation").alias("why_match"),
        E.tags("issues", "citation", "jurisdiction", rules.tags).alias("tags"),
    )
    return scored.select(
        "*", A.band("priority_score").alias("priority_band"),
        E.final_verdict("outcome", "title").alias("final_verdict"),
    ).drop("outcome")


def dedupe_cases(df: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """First row per lower-cased title, date and lower-cased court; untitled rows dropped.

    ``min_by`` keeps one candidate per key and task before the shuffle, so a record
    copied into a third of the table does not gather anywhere.
    """
    columns = df.columns
    return (
        df.filter(X.blank("title") != "")
        .groupBy(
            F.lower("title").alias("__t"), X.blank("decision_date").alias("__d"), F.lower(X.blank("court")).alias("__c")
        )
        .agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__row"))
        .select("__row.*")
    )


def reindex(df: DataFrame, order: Sequence[str] = ("ord",), prefix: str = "CASE-", width: int = 6) -> DataFrame:
    """Dense zero-padded ids in ingest order; the old ordinal is replaced as well."""
    numbered = with_ordinal(df, [F.col(c) for c in order], "__n")
    number = (F.col("__n") + 1).cast("string")
    padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    return numbered.withColumn("case_id", F.concat(F.lit(prefix), padded)).withColumn("ord", F.col("__n")).drop("__n")


def build_corpus(primary: DataFrame, extra: DataFrame, target: int) -> DataFrame:
    """Primary rows, topped up from ``extra`` (a fifth more than missing), deduplicated,
    cut at ``target`` and renumbered. Both inputs have ``ord``."""
    have = primary.count()
    merged = primary.withColumn("__source", F.lit(0))
    if have < target:
        quota = (target - have) + math.ceil((target - have) * 0.2)
        top_up = with_ordinal(extra, [F.col("ord")], "__n").filter(F.col("__n") < quota).drop("__n")
        merged = merged.unionByName(top_up.withColumn("__source", F.lit(1)))
    unique = dedupe_cases(merged, ("__source", "ord"))
    numbered = reindex(unique, ("__source", "ord"))
    return numbered.filter(F.col("ord") < target).drop("__source")


# ---- listings ------------------------------------------------------------------
def list_cases(cases: DataFrame, court: str | None = None, kind: str | None = None) -> DataFrame:
    """Equality filters with an "All ..." sentinel, highest priority first."""
    out = cases
    if court and court != "All Courts":
        out = out.filter(F.col("court") == court)
    if kind and kind != "All Types":
        out = out.filter(F.col("type") == kind)
    return out.orderBy(F.desc(F.coalesce("priority_score", F.lit(0))), "ord")


def text_filter(cases: DataFrame, query: str, columns: Sequence[str] = (
        "title", "summary", "why_match", "court", "type", "year", "tags")) -> DataFrame:
    """Rows whose joined fields contain every blank-separated term of the query."""
    parts = [F.array_join(F.col(c), " ") if dict(cases.dtypes)[c].startswith("array") else X.blank(F.col(c).cast("string"))
             for c in columns]
    terms = query.strip().lower().split()
    # The fields are joined once for all terms.
    holds = X.let(F.lower(F.concat_ws(" ", *parts)), lambda blob: reduce(lambda a, b: a & b, [blob.contains(t) for t in terms], F.lit(True)))
    return cases.filter(holds) if terms else cases


def facet_filter(cases: DataFrame, court: str = "All Courts", kind: str = "All Types",
                 location: str = "All Locations", query: str = "", **kwargs) -> DataFrame:
    """Facets on derived court level, type bucket and place, plus a text filter."""
    out = cases
    levels = [name for name, _ in L.COURT_LEVELS]
    if court != "All Courts":
        out = out.filter(A.court_level("court") == court if court in levels else F.col("court") == court)
    if kind != "All Types":
        out = out.filter(A.type_bucket("type") == kind)
    if location != "All Locations":
        out = out.filter(A.court_location("court") == location)
    # Texts are read last, for the rows that are left.
    return text_filter(out, query, **kwargs) if query.strip() else out


def citation_table(documents: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, kind, value``: one row per document and distinct thing it cites.

    Kinds: ``reference`` (provision ids), ``section``, ``statute``, ``year``, ``reporter``,
    ``case`` (names from a quoted list) and ``issue`` (whether-clauses). Narrow, nothing is
    left out; documents without citations have no rows.
    """
    found = {
        "reference": references(text), "section": E.explicit_sections(text), "statute": E.statutes(text),
        "year": E.citation_years(text), "reporter": E.citation_reporters(text), "case": E.cited_names(text),
        "issue": E.whether_issues(text),
    }

    def named(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    rows = F.flatten(F.array(*[named(kind, values) for kind, values in found.items()]))
    return X.exploded(documents, rows, ["r"], ["doc_id"]).select("doc_id", "r.kind", "r.value")


def get_case(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.filter(F.col("id") == case_id)


def cases_in_band(cases: DataFrame, band: str | None = None) -> DataFrame:
    out = cases if band is None else cases.filter(F.coalesce("priority_band", F.lit("P3")) == band)
    return out.orderBy(F.desc(F.coalesce("priority_score", F.lit(0))), "ord")


def top_priority(cases: DataFrame, n: int = 20) -> DataFrame:
    return cases.orderBy(F.desc(F.coalesce("priority_score", F.lit(0))), "ord").limit(n)


def case_queue(cases: DataFrame, mode: str = "unassigned") -> DataFrame:
    """Work queue: most urgent band first, then highest risk, then ingest order."""
    if mode == "unassigned":
        cases = cases.filter(X.blank("assigned_judge").isin("", "Unassigned"))
    elif mode == "needs-reassign":
        cases = cases.filter(F.col("status") == "Under Review")
    return cases.orderBy(A.band_order("priority_band"), F.desc(F.coalesce("risk_score", F.lit(0.0))), "ord")


def domain_documents(docs: DataFrame, signals=tuple(L.DOMAIN_SIGNALS), keep: int = 2) -> DataFrame:
    """Documents with a domain signal of at least ``keep``, and the signal."""
    return docs.withColumn("signal", E.domain_signal("text", signals)).filter(F.col("signal") >= keep)


def top_keywords(docs: DataFrame, k: int = 14, stop: Sequence[str] = tuple(L.KEYWORD_STOP_WORDS),
                 column: str = "text") -> DataFrame:
    """Add ``keywords``: the most frequent words of each document, ties by first use.
    Inside the row: no shuffle."""
    counted = X.runs(X.without(X.words(column, 4, "a-z"), list(stop)))
    ranked = F.sort_array(
        F.transform(counted, lambda r: F.struct((-r["n"]).alias("n"), r["pos"].alias("pos"), r["token"].alias("token")))
    )
    return docs.withColumn("keywords", F.transform(F.slice(ranked, 1, k), lambda r: r["token"]))


def facets(cases: DataFrame, places: Sequence[str] = tuple(L.KNOWN_LOCATIONS)) -> DataFrame:
    """``facet, value``: the distinct courts and places to offer as filters."""
    fields = F.array(
        F.struct(F.lit("court").alias("facet"), F.col("court").alias("value")),
        F.struct(F.lit("location").alias("facet"), A.court_location("court", places).alias("value")),
    )
    return (
        cases.select(F.inline(fields))
        .filter((F.col("facet") != "court") | (F.lower("value") != "supreme court of india"))
        .distinct()
        .orderBy("facet", "value")
    )
