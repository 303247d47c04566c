"""Operational snapshot, labelled records, issue lists and type variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import activity_checks as A
from checks import corpus_checks as K
from checks import triage_checks as T
from checks.base import Check, first_case, table, texts, trim_ws
from docketry.functions import enrich as E
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators import corpus as C
from docketry.operators import roster as R
from docketry.plans.tables import folder
from docketry.sources import ops as O


# Entries of one snapshot document, about; a task holds one document at a time.
SNAPSHOT_ROWS = 2_000


def snapshot(spark, sf_dir):
    """Snapshot documents per nation: its suppliers as judges, their line items as hearings. A nation has as many
    documents, one a line, as its rows need, so no document grows with the tables."""
    path = folder(spark, "snapshot")
    s = table(spark, sf_dir, "supplier")
    judge = F.struct(
        F.concat(F.lit("judge-"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("High Court").alias("courtLevel"),
        F.lit("Civil").alias("category"), (F.col("s_suppkey") % 40).cast("int").alias("yearsOfExperience"), F.lit(50).alias("caseLoadCapacity"),
        (F.col("s_suppkey") % 60).cast("int").alias("currentCaseLoad"), F.lit("Available").alias("availability"),
        F.concat(F.lit("NATION_"), "s_nationkey").alias("district"))
    items = table(spark, sf_dir, "lineitem")
    line = items.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    day = F.to_date("l_shipdate")
    hearing = F.struct(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("caseId"),
        F.concat(F.lit("judge-"), "l_suppkey").alias("assignedJudgeId"), F.date_format(day, "yyyy-MM-dd").alias("hearingDate"),
        F.concat((F.col("l_linenumber") % 12 + 1).cast("string"), F.when(F.col("l_orderkey") % 2 == 0, F.lit(":30 PM")).otherwise(":05 am")).alias("hearingTime"),
        F.lit("Scheduled").alias("status"))
    parts = F.lit(max(1, (s.count() + items.count()) // (25 * SNAPSHOT_ROWS)))
    dealt = lambda *keys: F.pmod(F.xxhash64(*keys), parts).alias("part")
    judges = s.select("s_nationkey", dealt("s_suppkey"), judge.alias("judge"))
    rows = judges.withColumn("hearing", F.lit(None).cast(line.select(hearing.alias("h")).schema["h"].dataType)).unionByName(
        line.select("s_nationkey", dealt("l_orderkey", "l_partkey", "l_linenumber"), hearing.alias("hearing")), allowMissingColumns=True)
    docs = rows.groupBy("s_nationkey", "part").agg(F.collect_list("judge").alias("judges"), F.collect_list("hearing").alias("hearings"))
    docs.select("s_nationkey", F.to_json(F.struct("judges", "hearings")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return O.read_ops_snapshot(spark, path, lines=True)


def snapshot_judges(spark, sf_dir):
    return O.list_judges(snapshot(spark, sf_dir)["judges"]).select("id", "name", "years_of_experience", "current_case_load", "district")


def snapshot_hearings(spark, sf_dir):
    return snapshot(spark, sf_dir)["hearings"].select(
        "id", "case_id", F.col("assigned_judge_id").alias("judge_id"), F.col("hearing_day").cast("string").alias("hearing_day"), "slot")


def labelled_segments(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "doc_id", X.segment("text", "the ").alias("after_the"), X.segment("text", "que ").alias("after_que"))


def labelled_cases(spark, sf_dir):
    """Issues and decision inside the body, behind their labels, and no columns for them."""
    raw = K.raw_cases(spark, sf_dir)
    body = F.concat(F.lit("Issues: "), "issues", F.lit("\nDecision:  "), "decision", F.lit(" \n"), "full_text")
    return C.enrich_cases(raw.withColumn("full_text", body).drop("issues", "decision"), K.RULES).select("id", "similarity")


def issue_lists(spark, sf_dir):
    """Provisions as a register lists them, written from parts."""
    p = table(spark, sf_dir, "part")
    year = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit(", "), (1900 + F.col("p_size")).cast("string"))).otherwise("")
    line = F.concat(F.lit("  Section "), "p_partkey", F.lit("A in The "), "p_name", F.lit("  Act"), year, F.lit(" ; rule 4 in Tax Code;ab ;plain  note "), "p_brand")
    return p.select("p_partkey", F.array_join(E.issue_list(line), "|").alias("issues"))


def domain_documents(spark, sf_dir):
    return C.domain_documents(texts(spark, sf_dir), K.REL_SIGNALS).select("doc_id", "signal")


def type_variants(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", *[E.case_type("text", v).alias(v) for v in L.CASE_TYPE_RULES])


def queue_of_texts(spark, sf_dir):
    """Triage and assignment in one job, seeded by the text."""
    queue = texts(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "text")
    return R.assign_queue(queue, T.judges(spark, sf_dir), T.RULES).select("case_id", "judge_id", "score", "category")


def segment_sql(label):
    return f"""CASE WHEN contains(text, '{label}') THEN {trim_ws(f"split_part(substr(text, instr(text, '{label}') + {len(label)}), chr(10), 1)")} ELSE '' END"""


CHECKS = [
    Check("snapshot_judges", snapshot_judges, """
SELECT 'judge-' || s_suppkey AS id, s_name AS name, (s_suppkey % 40)::INT AS years_of_experience, (s_suppkey % 60)::INT AS current_case_load,
  'NATION_' || s_nationkey AS district FROM supplier"""),
    Check("snapshot_hearings", snapshot_hearings, """
SELECT concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS id, l_orderkey::VARCHAR AS case_id, 'judge-' || l_suppkey AS judge_id,
  strftime(l_shipdate, '%Y-%m-%d') AS hearing_day,
  CASE WHEN l_orderkey % 2 = 0 THEN lpad((CASE WHEN h = 12 THEN 12 ELSE h + 12 END)::VARCHAR, 2, '0') || ':30'
    ELSE lpad((CASE WHEN h = 12 THEN 0 ELSE h END)::VARCHAR, 2, '0') || ':05' END AS slot
FROM (SELECT *, l_linenumber % 12 + 1 AS h FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey"""),
    Check("labelled_segments", labelled_segments, f"""
SELECT doc_id, {segment_sql('the ')} AS after_the, {segment_sql('que ')} AS after_que FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""),
    Check("case_similarity_labelled", labelled_cases, f"WITH {K.CASES} SELECT id, similarity FROM enriched"),
    Check("issue_lists", issue_lists, """
SELECT p_partkey, 'Section ' || p_partkey || 'A, ' || p_name || ' Act' || CASE WHEN p_partkey % 3 > 0 THEN ' (' || (1900 + p_size) || ')' ELSE '' END
  || '|rule 4, Tax Code|plain note ' || p_brand AS issues FROM part"""),
    Check("domain_documents", domain_documents, r"""
SELECT doc_id, signal FROM (SELECT doc_id, (CASE WHEN regexp_matches(lower(text), '\b(the|und|que)\b') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), '\bder\b') THEN 1 ELSE 0 END)::INT AS signal FROM documents) WHERE signal >= 2"""),
    Check("case_type_variants", type_variants, "SELECT doc_id, " + ", ".join(
        f"{first_case('low', rules, chr(39) + L.CASE_TYPE_DEFAULT[v] + chr(39))} AS {v}"
        for v, rules in L.CASE_TYPE_RULES.items()) + f" FROM {T.LOW}"),
    Check("queue_of_texts", queue_of_texts, f"""
WITH {T.TRIAGE}, {T.JUDGES}, texts AS (SELECT doc_id AS case_id, category, severity, risk, text AS seed FROM triaged JOIN documents USING (doc_id)),
{T.ranking('texts', 1)} SELECT case_id, id AS judge_id, score, wanted AS category FROM ranked"""),
]
