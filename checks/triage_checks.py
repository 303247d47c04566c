"""Intake triage, rule matching, overrides and judge assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Check, fill, in_list, table, texts
from docketry.functions import lexicon as L
from docketry.operators import changes as G
from docketry.operators import roster as R
from docketry.operators import triage as T

RULES = L.TriageRules(
    types=(("Criminal", "thes|sch|une"), ("Civil", "eau|ment|los ")), default_type="Specialized Cases",
    severity=(("Critical", ("thth", "eux ", "dass")), ("High", ("ung ", "que ", "hed")), ("Medium", ("and ", "der "))),
    bail=(("ther", 18), ("die ", 22), ("les ", 10), ("ing", 8), ("los", 6)),
    escape=(("whou", 22), ("elle", 24), ("und ", 12), ("ción", 18), ("atan", 10)),
)
LITE = L.LiteTriageRules(("thes", "sch"), ("thth", "eux "), ("ung ", "que "), ("and ", "der "), "elle")
STATUTES = [
    {"ord": 1, "terms": ["the ", "AND ", "thes"], "sections": ["A 1", "A 2"], "domain": "Criminal", "severity": "Critical", "public_risk": True},
    {"ord": 2, "terms": ["der ", "und ", "sch", "thes"], "sections": ["B 1"], "domain": "Civil", "severity": "Medium", "public_risk": False},
    {"ord": 3, "terms": ["que ", "les ", "eau"], "sections": ["C 1"], "domain": "Criminal", "severity": "High", "public_risk": False},
    {"ord": 4, "terms": ["los ", "una ", "que ", "ción"], "sections": ["D 1"], "domain": "Civil", "severity": "Low", "public_risk": False},
]


def triaged(spark, sf_dir):
    t = T.triage(texts(spark, sf_dir), RULES)
    return t.select(
        "doc_id", "case_type", "severity", "bail_risk", "escape_risk", "risk", "priority_score", "priority_band",
        "category", F.size("risk_factors").alias("n_factors"), T.rationale().alias("rationale"),
    )


def triaged_lite(spark, sf_dir):
    d = texts(spark, sf_dir).withColumn("hint", (F.col("doc_id") % 100).cast("double"))
    return T.triage_lite(d, LITE, score_hint="hint").select(
        "doc_id", "case_type", "severity", "bail_risk", "escape_risk", "risk", "priority_score", "priority_band"
    )


def matched(spark, sf_dir, match="substring"):
    m = T.rule_priority(T.match_rules(texts(spark, sf_dir), STATUTES, match=match))
    return m.select(
        "doc_id", F.col("rule.ord").alias("rule_no"), "rule_hits", F.array_join("rule.sections", "|").alias("sections"),
        "rule_score", "rule_level",
    )


def matched_words(spark, sf_dir):
    words = [{**r, "terms": [t.strip() for t in r["terms"]]} for r in STATUTES]
    m = T.match_rules(texts(spark, sf_dir), words, match="word")
    return m.select("doc_id", F.col("rule.ord").alias("rule_no"), "rule_hits")


def manual(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "Criminal").when(F.col("o_orderstatus") == "O", "Civil").otherwise("Specialized Cases").alias("case_type"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Critical").when(F.col("o_orderpriority") == "2-HIGH", "High")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium").otherwise("Low").alias("severity"),
    )
    return T.override_scores(o).select("o_orderkey", "priority_score", "bail_risk", "escape_risk", "risk", "priority_band")


def judges(spark, sf_dir):
    """Suppliers as judges; their line items are the load."""
    load = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.join(load, k == F.col("l_suppkey"), "left").select(
        F.concat(F.lit("judge-"), k.cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.when(k % 5 == 0, "Supreme Court").when(k % 5 < 3, "High Court").otherwise("District Court").alias("court_level"),
        F.when(k % 3 == 0, "Criminal").when(k % 3 == 1, "Civil").otherwise("Other").alias("category"),
        (F.lit(3) + k % 30).cast("int").alias("years_of_experience"),
        F.when(k % 17 == 0, 0).otherwise(400 + k % 7 * 100).cast("int").alias("case_load_capacity"),
        F.coalesce("n", F.lit(0)).cast("int").alias("current_case_load"),
        F.when(k % 4 < 2, "Available").when(k % 4 == 2, "Busy").otherwise("On Leave").alias("availability"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("district"),
    )


def queue(spark, sf_dir):
    o = texts(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderstatus") == "F", "Criminal").when(F.col("o_orderstatus") == "O", "Civil").otherwise("Other").alias("category"),
        F.when(p == "1-URGENT", "Critical").when(p == "2-HIGH", "High").when(p == "3-MEDIUM", "Medium").otherwise("Low").alias("severity"),
        (F.col("o_orderkey") % 90 + 10).cast("int").alias("risk"), F.concat(F.lit("case "), F.col("o_orderkey")).alias("seed"),
    )


def ranked(spark, sf_dir):
    return R.rank_judges(queue(spark, sf_dir), judges(spark, sf_dir), 3).select(
        "case_id", "rank", "judge_id", "score", "utilization", "reason"
    )


def customer_judges(spark, sf_dir):
    """Customers as a large roster; their orders are the load."""
    load = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.join(load, k == F.col("o_custkey"), "left").select(
        F.concat(F.lit("judge-"), k.cast("string")).alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 5 == 0, "Supreme Court").when(F.col("c_nationkey") % 5 < 3, "High Court").otherwise("District Court").alias("court_level"),
        F.when(F.col("c_nationkey") % 3 == 0, "Criminal").when(F.col("c_nationkey") % 3 == 1, "Civil").otherwise("Other").alias("category"),
        (F.lit(3) + k % 30).cast("int").alias("years_of_experience"),
        F.when(k % 17 == 0, 0).otherwise(10 + k % 7 * 5).cast("int").alias("case_load_capacity"),
        F.coalesce("n", F.lit(0)).cast("int").alias("current_case_load"),
        F.when(F.col("c_acctbal") > 6000, "Available").when(F.col("c_acctbal") > 3000, "Busy").otherwise("On Leave").alias("availability"),
    )


def ranked_large(spark, sf_dir):
    return R.rank_judges(queue(spark, sf_dir), customer_judges(spark, sf_dir), 3).select(
        "case_id", "rank", "judge_id", "score", "utilization", "reason"
    )


# Pieces of words that the rules of parts are made of.
PIECES = ["the", "er", "on", "an", "re", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "st", "ou", "le"]


def part_rules(spark, sf_dir):
    """Parts as rules: made-up word pieces, the part's name, and one term in two rules of ten that is short or has a blank."""
    k = F.col("p_partkey")
    piece = lambda n: F.element_at(F.array(*[F.lit(p) for p in PIECES]), (F.floor(n) % 20 + 1).cast("int"))
    word = F.concat(piece(k), piece(k / 20), piece(k / 400))
    more = F.when(k % 10 == 0, F.array(F.concat(piece(k / 7), F.lit(" "), piece(k / 3)))).when(
        k % 10 == 1, F.array(F.substring("p_name", 1, 2))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select(
        (k + 1).cast("int").alias("ord"),
        F.concat(F.array(word, F.upper(F.concat(word, piece(k / 2))), F.col("p_name")), more).alias("terms"),
        F.array("p_brand").alias("sections"), F.lit("Civil").alias("domain"),
        F.when(F.col("p_size") > 25, "High").otherwise("Low").alias("severity"), (k % 2 == 0).alias("public_risk"))


def matched_many(spark, sf_dir):
    m = T.match_rules(texts(spark, sf_dir), part_rules(spark, sf_dir), key="doc_id")
    return m.select("doc_id", F.col("rule.ord").alias("rule_no"), "rule_hits", F.array_join("rule.sections", "|").alias("sections"))


def assigned(spark, sf_dir):
    return R.assign_judges(queue(spark, sf_dir), judges(spark, sf_dir)).select(
        "case_id", "judge_id", "judge_name", "score", "party_label", "requires_public_prosecutor"
    )


def assigned_queue(spark, sf_dir):
    d = texts(spark, sf_dir).select(F.col("doc_id").alias("case_id"), "text", F.col("source").alias("name"))
    t = T.triage(d, RULES)
    return R.assign_judges(t, judges(spark, sf_dir), seed="name").select("case_id", "judge_id", "score", "category")


def available(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("judge-"), F.col("l_suppkey").cast("string")).alias("judge_id"),
        F.to_date("l_shipdate").cast("string").alias("hearing_date"),
    )
    return R.available_judges(judges(spark, sf_dir), "nation_1", "Criminal", True, h, "1998-03-05").select(
        "id", "district", "availability", "current_case_load", F.size("scheduled_dates").alias("n_booked")
    )


def status(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("judge-"), F.col("l_suppkey").cast("string")).alias("judge_id"),
        F.to_date("l_shipdate").alias("hearing_date"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("slot"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("id"),
    )
    return R.judge_status(judges(spark, sf_dir), h).select(
        "judge_id", "utilization_percent", "is_free", F.array_join("upcoming", ",").alias("upcoming")
    )


def counts(spark, sf_dir):
    return R.roster_counts(judges(spark, sf_dir), "nation_1")


def capacity(spark, sf_dir):
    return R.roster_capacity(judges(spark, sf_dir))


def overrides(spark, sf_dir):
    """Every event overrides the band of the order its user id points at."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("case_id"), F.lit("P2").alias("original_band"),
        F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("override_band"),
        F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("override_score"), F.col("ts").alias("created_at"),
    )


def managed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.lit("P3").alias("priority_band"), F.col("o_totalprice").alias("priority_score"),
    )


def overridden(spark, sf_dir):
    return G.apply_overrides(managed(spark, sf_dir), overrides(spark, sf_dir))


def override_log(spark, sf_dir):
    return G.override_history(overrides(spark, sf_dir)).select("case_id", "id", "override_band", "newest_first")


LOW = "(SELECT *, lower(text) AS low FROM documents)"


def hits(terms, strict=False):
    if strict:
        return " + ".join(rf"(regexp_matches(low, '\b{t.strip().lower()}\b'))::INT" for t in terms)
    return " + ".join(f"(contains(low, '{t.lower()}'))::INT" for t in terms)


def points(weighted):
    return " + ".join(f"CASE WHEN contains(low, '{t}') THEN {w} ELSE 0 END" for t, w in weighted)


def names(prefix, weighted):
    return ", ".join(f"CASE WHEN contains(low, '{t}') THEN '{prefix} signal: {t}' END" for t, _ in weighted)


BAND = "CASE WHEN {0} >= 85 THEN 'P0' WHEN {0} >= 70 THEN 'P1' WHEN {0} >= 50 THEN 'P2' ELSE 'P3' END"
TRIAGE = fill(
    r"""
t0 AS (SELECT doc_id, source, low, CASE WHEN regexp_matches(low, 'thes|sch|une') THEN 'Criminal'
    WHEN regexp_matches(low, 'eau|ment|los ') THEN 'Civil' ELSE 'Specialized Cases' END AS case_type,
  CASE WHEN regexp_matches(low, 'thth|eux |dass') THEN 'Critical' WHEN regexp_matches(low, 'ung |que |hed') THEN 'High'
    WHEN regexp_matches(low, 'and |der ') THEN 'Medium' ELSE 'Low' END AS severity FROM <<low>>),
t1 AS (SELECT *, greatest(10, least(99, 18 + CASE WHEN case_type = 'Criminal' THEN 10 ELSE 0 END
    + CASE severity WHEN 'Critical' THEN 18 WHEN 'High' THEN 12 WHEN 'Medium' THEN 6 ELSE 0 END + <<bail>>))::INT AS bail_risk,
  greatest(10, least(99, 12 + CASE WHEN case_type = 'Criminal' THEN 8 ELSE 0 END
    + CASE severity WHEN 'Critical' THEN 18 WHEN 'High' THEN 12 WHEN 'Medium' THEN 4 ELSE 0 END + <<escape>>))::INT AS escape_risk,
  list_filter([<<bn>>, <<en>>, CASE WHEN severity = 'Critical' THEN 'critical offense severity' END,
    CASE WHEN severity = 'High' THEN 'high offense severity' END], lambda x: x IS NOT NULL) AS factors FROM t0),
triaged AS (SELECT *, greatest(10, least(99, floor(round(bail_risk * 0.55e0 + escape_risk * 0.45e0, 6) + 0.5)))::INT AS risk,
  greatest(20, least(99, floor(round(0.34e0 * CASE case_type WHEN 'Criminal' THEN 42 WHEN 'Civil' THEN 26 ELSE 34 END
    + 0.3e0 * CASE severity WHEN 'Critical' THEN 48 WHEN 'High' THEN 36 WHEN 'Medium' THEN 24 ELSE 12 END
    + 0.18e0 * bail_risk + 0.18e0 * escape_risk, 6) + 0.5)))::INT AS priority_score,
  CASE WHEN case_type IN ('Criminal', 'Civil') THEN case_type ELSE 'Other' END AS category FROM t1)""",
    low=LOW, bail=points(RULES.bail), escape=points(RULES.escape), bn=names("bail", RULES.bail), en=names("escape", RULES.escape),
)
MATCH = "m0 AS (SELECT doc_id, low, unnest([{ord: 0, n: 0}, " + ", ".join(
    f"{{ord: {r['ord']}, n: {hits(r['terms'])}}}" for r in STATUTES) + f"]) AS r FROM {LOW})," + """
matched AS (SELECT doc_id, low, r.ord AS ord, r.n AS n FROM m0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r.n DESC, r.ord) = 1)"""
JUDGES = """
load AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1),
judges AS (
  SELECT 'judge-' || s_suppkey AS id, s_name AS name, 'NATION_' || s_nationkey AS district,
    CASE WHEN s_suppkey % 5 = 0 THEN 'Supreme Court' WHEN s_suppkey % 5 < 3 THEN 'High Court' ELSE 'District Court' END AS court_level,
    CASE s_suppkey % 3 WHEN 0 THEN 'Criminal' WHEN 1 THEN 'Civil' ELSE 'Other' END AS category, 3 + s_suppkey % 30 AS years,
    CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE 400 + s_suppkey % 7 * 100 END AS capacity, coalesce(n, 0) AS load,
    CASE WHEN s_suppkey % 4 < 2 THEN 'Available' WHEN s_suppkey % 4 = 2 THEN 'Busy' ELSE 'On Leave' END AS availability
  FROM supplier LEFT JOIN load ON l_suppkey = s_suppkey
)"""
CUSTOMER_JUDGES = """
load AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
judges AS (
  SELECT 'judge-' || c_custkey AS id, c_name AS name,
    CASE WHEN c_nationkey % 5 = 0 THEN 'Supreme Court' WHEN c_nationkey % 5 < 3 THEN 'High Court' ELSE 'District Court' END AS court_level,
    CASE c_nationkey % 3 WHEN 0 THEN 'Criminal' WHEN 1 THEN 'Civil' ELSE 'Other' END AS category, 3 + c_custkey % 30 AS years,
    CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 10 + c_custkey % 7 * 5 END AS capacity, coalesce(n, 0) AS load,
    CASE WHEN c_acctbal > 6000 THEN 'Available' WHEN c_acctbal > 3000 THEN 'Busy' ELSE 'On Leave' END AS availability
  FROM customer LEFT JOIN load ON o_custkey = c_custkey
)"""
QUEUE = """
queue AS (SELECT o_orderkey AS case_id,
  CASE o_orderstatus WHEN 'F' THEN 'Criminal' WHEN 'O' THEN 'Civil' ELSE 'Other' END AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS severity,
  (o_orderkey % 90 + 10)::INT AS risk, 'case ' || o_orderkey AS seed FROM orders)"""


def ranking(source, k):
    """The hash of seed and name as seed part, power and name part, so that no pair is hashed letter by letter."""
    return fill(
        r"""
seeds AS (SELECT seed, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(seed || ':', ''), lambda c: ascii(c)::BIGINT)),
    lambda h, c: (h * 31 + c) & 4294967295) AS hs FROM (SELECT DISTINCT seed FROM <<src>>)),
roster AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, c: (h * 31 + c) & 4294967295) AS hn,
  list_reduce(list_prepend(1::BIGINT, list_transform(string_split(name, ''), lambda c: 31::BIGINT)), lambda h, c: (h * c) & 4294967295) AS pw,
  CASE WHEN capacity > 0 THEN load::DOUBLE / capacity ELSE 1 END AS used FROM judges),
fit AS (
  SELECT q.case_id, q.category AS wanted, q.severity, q.risk, r.*, floor(used * 100 + 0.5)::INT AS utilization,
    floor(round(100 * (0.3e0 * CASE WHEN r.category = q.category THEN 1 WHEN q.category = 'Other' AND r.category = 'Criminal' THEN 0.72e0 ELSE 0.38e0 END
      + 0.22e0 * CASE availability WHEN 'Available' THEN 1 WHEN 'Busy' THEN 0.6e0 ELSE 0.15e0 END
      + 0.18e0 * greatest(0, 1 - used) + 0.1e0 * least(1, years / 25e0)
      + 0.17e0 * CASE WHEN severity = 'Critical' OR risk >= 80 THEN CASE court_level WHEN 'Supreme Court' THEN 1 WHEN 'High Court' THEN 0.92e0 ELSE 0.68e0 END
          WHEN severity = 'High' OR risk >= 60 THEN CASE court_level WHEN 'High Court' THEN 1 WHEN 'Supreme Court' THEN 0.92e0 ELSE 0.76e0 END
          ELSE CASE court_level WHEN 'District Court' THEN 1 ELSE 0.84e0 END END
      + 0.03e0 * greatest(0.55e0, least(1, risk / 100e0))) + ((hs::HUGEINT * pw + hn) % 4294967296) % 11, 6) + 0.5)::INT AS score
  FROM <<src>> q JOIN seeds USING (seed), roster r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, utilization, name)::INT AS rank FROM fit QUALIFY rank <= <<k>>
)""",
        src=source, k=str(k),
    )


REASON = """'Selected for ' || CASE WHEN category = wanted THEN 'strong category fit' ELSE 'acceptable fallback fit' END || ', ' ||
  lower(availability) || ' status, ' || CASE WHEN used >= 85 THEN 'high current load' WHEN used >= 60 THEN 'moderate current load' ELSE 'low current load' END
  || ', and ' || CASE WHEN risk >= 80 THEN 'critical risk profile' WHEN risk >= 60 THEN 'elevated risk profile' ELSE lower(severity) || ' severity' END || '.'"""

CHECKS = [
    Check("intake_triage", triaged, f"""
WITH {TRIAGE} SELECT doc_id, case_type, severity, bail_risk, escape_risk, risk, priority_score, {BAND.format('priority_score')} AS priority_band,
  category, len(factors)::INT AS n_factors, 'Priority derived from ' || lower(case_type) || ' classification, ' || lower(severity)
  || ' severity, bail risk ' || bail_risk || ', and escape risk ' || escape_risk || '. ' || CASE WHEN len(factors) > 0
  THEN 'Risk factors: ' || array_to_string(factors[1:3], ', ') || '.' ELSE 'No explicit bail or flight-risk markers detected.' END AS rationale FROM triaged"""),
    Check("intake_triage_lite", triaged_lite, f"""
WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(low, 'thes|sch') THEN 'Criminal' ELSE 'Civil' END AS case_type,
  CASE WHEN regexp_matches(low, 'thth|eux ') THEN 'Critical' WHEN regexp_matches(low, 'ung |que ') THEN 'High'
    WHEN regexp_matches(low, 'and |der ') THEN 'Medium' ELSE 'Low' END AS severity FROM {LOW}),
b AS (SELECT *, 20 + CASE WHEN case_type = 'Criminal' THEN 15 ELSE 0 END + CASE WHEN severity = 'Critical' THEN 30 ELSE 0 END AS bail_risk,
  10 + CASE WHEN severity = 'Critical' THEN 40 ELSE 0 END AS escape_risk FROM a),
c AS (SELECT *, floor((bail_risk + escape_risk) / 2 + 0.5)::INT AS risk FROM b),
d AS (SELECT *, round(greatest(least(99e0, CASE case_type WHEN 'Criminal' THEN 40 ELSE 20 END
  + CASE severity WHEN 'Critical' THEN 55 WHEN 'High' THEN 40 WHEN 'Medium' THEN 25 ELSE 10 END + risk * 0.1e0), doc_id % 100), 6) AS priority_score FROM c)
SELECT doc_id, case_type, severity, bail_risk, escape_risk, risk, priority_score, {BAND.format('priority_score')} AS priority_band FROM d"""),
    Check("rule_match", matched, f"""
WITH {MATCH} SELECT doc_id, CASE WHEN n > 0 THEN ord END AS rule_no, n AS rule_hits,
  CASE WHEN n = 0 THEN '' WHEN ord = 1 THEN 'A 1|A 2' WHEN ord = 2 THEN 'B 1' WHEN ord = 3 THEN 'C 1' ELSE 'D 1' END AS sections,
  least(100, CASE WHEN n = 0 THEN 55 WHEN ord = 1 THEN 92 WHEN ord = 3 THEN 72 ELSE 48 END
    + CASE WHEN contains(low, 'bail') THEN 5 ELSE 0 END + CASE WHEN contains(low, 'child') OR contains(low, 'minor') THEN 8 ELSE 0 END
    + CASE WHEN contains(low, 'woman') OR contains(low, 'female') THEN 4 ELSE 0 END)::INT AS rule_score,
  CASE WHEN n > 0 AND ord IN (1, 3) THEN 'HIGH' ELSE 'MEDIUM' END AS rule_level FROM matched"""),
    Check("rule_match_words", matched_words, "WITH m0 AS (SELECT doc_id, unnest([{ord: 0, n: 0}, " + ", ".join(
        f"{{ord: {r['ord']}, n: {hits(r['terms'], True)}}}" for r in STATUTES) + f"]) AS r FROM {LOW})" + """
SELECT doc_id, CASE WHEN r.n > 0 THEN r.ord END AS rule_no, r.n AS rule_hits FROM m0
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r.n DESC, r.ord) = 1"""),
    Check("manual_override_scores", manual, f"""
WITH a AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 35 WHEN 'O' THEN 22 ELSE 28 END AS t, o_orderpriority AS p FROM orders),
b AS (SELECT *, greatest(20, least(99, t + CASE p WHEN '1-URGENT' THEN 48 WHEN '2-HIGH' THEN 36 WHEN '3-MEDIUM' THEN 24 ELSE 12 END))::INT AS priority_score FROM a)
SELECT o_orderkey, priority_score, CASE p WHEN '1-URGENT' THEN 84 WHEN '2-HIGH' THEN 68 WHEN '3-MEDIUM' THEN 48 ELSE 28 END AS bail_risk,
  CASE p WHEN '1-URGENT' THEN 78 WHEN '2-HIGH' THEN 62 WHEN '3-MEDIUM' THEN 38 ELSE 18 END AS escape_risk,
  CASE p WHEN '1-URGENT' THEN 82 WHEN '2-HIGH' THEN 64 WHEN '3-MEDIUM' THEN 43 ELSE 24 END AS risk,
  {BAND.format('priority_score')} AS priority_band FROM b"""),
    Check("judge_ranking", ranked, f"""
WITH {JUDGES}, {QUEUE}, {ranking('queue', 3)} SELECT case_id, rank, id AS judge_id, score, utilization, {REASON} AS reason FROM ranked"""),
    Check("judge_ranking_large", ranked_large, f"""
WITH {CUSTOMER_JUDGES}, {QUEUE}, {ranking('queue', 3)} SELECT case_id, rank, id AS judge_id, score, utilization, {REASON} AS reason FROM ranked"""),
    Check("rule_match_many", matched_many, f"""
WITH k AS (SELECT *, list_value({in_list(PIECES)}) AS p FROM part),
w AS (SELECT *, p[p_partkey % 20 + 1] || p[p_partkey // 20 % 20 + 1] || p[p_partkey // 400 % 20 + 1] AS word FROM k),
rules AS (SELECT p_partkey + 1 AS ord, p_brand AS section, unnest([word, word || p[p_partkey // 2 % 20 + 1], lower(p_name)] || CASE p_partkey % 10
  WHEN 0 THEN [p[p_partkey // 7 % 20 + 1] || ' ' || p[p_partkey // 3 % 20 + 1]] WHEN 1 THEN [lower(substr(p_name, 1, 2))] ELSE [] END) AS term FROM w),
terms AS (SELECT DISTINCT term FROM rules),
found AS (SELECT doc_id, term FROM {LOW}, terms WHERE contains(low, term)),
counted AS (SELECT doc_id, ord, section, count(*)::INT AS hits FROM found JOIN rules USING (term) GROUP BY ALL),
n AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, ord) = 1)
SELECT doc_id, ord::INT AS rule_no, coalesce(hits, 0) AS rule_hits, coalesce(section, '') AS sections FROM documents LEFT JOIN n USING (doc_id)"""),
    Check("judge_assignment", assigned, f"""
WITH {JUDGES}, {QUEUE}, {ranking('queue', 1)} SELECT case_id, id AS judge_id, name AS judge_name, score,
  CASE WHEN wanted = 'Criminal' THEN 'Accused' ELSE 'Defendant' END AS party_label, wanted = 'Criminal' AS requires_public_prosecutor FROM ranked"""),
    Check("queue_assignment", assigned_queue, f"""
WITH {TRIAGE}, {JUDGES}, texts AS (SELECT doc_id AS case_id, category, severity, risk, source AS seed FROM triaged), {ranking('texts', 1)}
SELECT case_id, id AS judge_id, score, wanted AS category FROM ranked"""),
    Check("judge_availability", available, f"""
WITH {JUDGES}, booked AS (SELECT 'judge-' || l_suppkey AS id, count(*)::INT AS n FROM lineitem WHERE l_shipdate::DATE = DATE '1998-03-05' GROUP BY 1)
SELECT id, district, availability, load::INT AS current_case_load, coalesce(n, 0)::INT AS n_booked FROM judges LEFT JOIN booked USING (id)
WHERE contains(lower(district), 'nation_1') AND category = 'Criminal' AND availability = 'Available'"""),
    Check("judge_status", status, f"""
WITH {JUDGES}, h AS (SELECT 'judge-' || l_suppkey AS id, concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS hid, l_shipdate, l_linenumber FROM lineitem),
n AS (SELECT id, hid, row_number() OVER (PARTITION BY id ORDER BY l_shipdate, l_linenumber, hid) AS r FROM h QUALIFY r <= 5),
u AS (SELECT id, string_agg(hid, ',' ORDER BY r) AS upcoming FROM n GROUP BY 1)
SELECT id AS judge_id, floor(CASE WHEN capacity > 0 THEN load::DOUBLE / capacity * 100 ELSE 0 END + 0.5)::INT AS utilization_percent,
  availability = 'Available' AND load < capacity * 0.8e0 AS is_free, coalesce(upcoming, '') AS upcoming FROM judges LEFT JOIN u USING (id)"""),
    Check("roster_counts", counts, f"""
WITH {JUDGES} SELECT coalesce(category, 'All') AS category, count(*) AS total, count(*) FILTER (WHERE availability = 'Available') AS available,
  count(*) FILTER (WHERE availability = 'Busy') AS busy, count(*) FILTER (WHERE availability = 'On Leave') AS on_leave
FROM judges WHERE contains(lower(district), 'nation_1') GROUP BY ROLLUP (category)"""),
    Check("roster_capacity", capacity, f"""
WITH {JUDGES} SELECT sum(capacity)::BIGINT AS total_capacity, sum(load)::BIGINT AS total_load,
  floor(sum(load)::DOUBLE / sum(capacity) * 100 + 0.5)::INT AS load_percent, count(*) FILTER (WHERE availability = 'Available') AS available FROM judges"""),
    Check("override_application", overridden, """
WITH o AS (SELECT user_id, 'P' || (event_id % 4) AS b, CASE WHEN event_id % 3 > 0 THEN value END AS s FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(b, 'P3') AS priority_band, coalesce(s, o_totalprice) AS priority_score
FROM orders LEFT JOIN o ON user_id = o_orderkey"""),
    Check("override_history", override_log, """
SELECT user_id AS case_id, event_id AS id, 'P' || (event_id % 4) AS override_band,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS newest_first
FROM events"""),
]
