"""Legal lexicons and edge cases on small invented records."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import enrich as E
from docketry.functions import facets as A
from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators import corpus as K
from docketry.operators import related as R
from docketry.operators import roster as J
from docketry.operators import schedule as S
from docketry.operators import search as Q
from docketry.operators import triage as T
from docketry.plans import prose as P


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("out")).first()[0]


RAW = "case_id STRING, ord LONG, title STRING, court STRING, jurisdiction STRING, decision_date STRING, citation STRING, case_type STRING, summary STRING, full_text STRING"
BODY = (
    "Issues: Article 14 and income tax demand\nDecision: 1\n"
    "The dispute concerns ownership of the land and the rights of the heirs. The court held that the appeal must "
    "be allowed in the light of the evidence. Bail was granted earlier in an interim order."
)


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        ("c1", 0, "Ram Kumar vs State, Criminal Appeal of 2015", "Supreme Court of India", "India", "2015-03-02", "AIR 2015 SC 1, 2015 SCC 9", "Criminal", "", BODY),
        ("c2", 1, "Land Board vs Devi", "Delhi High Court", "", "1998-01-01", "", "Civil", "", "Decision: 0\nProperty dispute about a sale deed; the petition is dismissed by the bench."),
        ("c3", 2, "Murder trial of X", "District Court, Patna", "India", "", "", "", "Accused convicted of murder after the bail application was rejected.", ""),
    ]
    return K.enrich_cases(spark.createDataFrame(rows, RAW)).cache()


def test_enriched_cases(cases):
    c1, c2, c3 = cases.orderBy("ord").collect()
    assert c1.final_verdict == "Appeal Allowed" and c2.final_verdict == "Case Dismissed"
    assert c1.tags == ["India", "Cited", "Equality", "Tax"] and c2.tags == ["India", "General"]
    assert 40 < len(c1.summary) < 430 and "court" in c1.summary
    assert c1.year == 2015 and c3.year == 2000 and c3.type == "General"
    # 55 + 1 (issues) + 0 + 4 (two citations) + 4 (long title)
    assert c1.similarity == 64
    assert c1.why_match == "Matched on issue overlap, similar outcome pattern, citation support in the source judgment metadata."
    # compliance 1/5 -> 2.0, citations .15 * 76, recency 2.25
    assert c1.priority_score == 20 and c1.priority_band == "P3"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("1", "Case Allowed / In Favor"), ("0", "Case Dismissed / Rejected"), ("Decision: 0.0 x", "Case Dismissed / Rejected"),
        ("", "Judgement unavailable"), ("the accused was found guilty", "Conviction Recorded"),
        ("nothing of note", "Judgement reserved / Mixed outcome"), ("disallowedness", "Judgement reserved / Mixed outcome"),
    ],
)
def test_verdicts(spark, text, expected):
    assert one(spark, E.verdict(F.col("t"), F.lit("")), t=text) == expected


def test_verdict_rule_order_is_kept(spark):
    assert one(spark, E.verdict_class(F.lit("found not guilty"))) == "Convicted"


def test_edges_are_ascii(spark):
    assert one(spark, F.regexp_count(F.lit("éabc abc"), F.lit(X.word_re("abc")))) == 2


def test_rounding_of_halves(spark):
    assert one(spark, X.round_half_up(F.lit(-2.5))) == -2 and one(spark, X.round_half_up(F.lit(2.5))) == 3


def test_frequencies_and_tokens(spark):
    got = one(spark, X.frequencies(X.words(F.lit("The cat, the CAT; a dog"))))
    assert got == {"the": 2, "cat": 2, "dog": 1}
    assert one(spark, X.tokens(F.lit("dog the dog cat"), L.STOP_WORDS)) == ["dog", "cat"]
    assert one(spark, X.frequencies(X.words(F.lit("")))) == {}


def test_hashes(spark):
    def fnv(s, seed):
        for ch in s:
            seed = ((seed ^ ord(ch)) * 16777619) & 0xFFFFFFFF
        return seed

    assert one(spark, H.fnv1a(F.lit("contract"), H.SEED_A)) == fnv("contract", H.SEED_A)
    h = 0
    for ch in "case 1:Justice A":
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    assert one(spark, H.rolling31(F.lit("case 1:Justice A"))) == h
    first, second = F.lit([3, 3, 5]), F.lit([5, 3, 9])
    assert one(spark, H.squared_norm(first, second, 0.45)) == pytest.approx(2.45**2 + 1.45**2 + 0.45**2)


@pytest.mark.parametrize(
    "raw, expected",
    [("05-03-2026", dt.date(2026, 3, 5)), ("2026-03-05", dt.date(2026, 3, 5)), ("2026-03-05T08:00:00Z", dt.date(2026, 3, 5)),
     ("04T08:24:21.874Z-05-2026", None), ("", None), ("31-02-2026", None)],
)
def test_hearing_dates(spark, raw, expected):
    assert one(spark, D.hearing_date("d"), d=raw) == expected


@pytest.mark.parametrize("raw, expected", [
    ("2:05 PM", "14:05"), ("12:10am", "00:10"), ("12:10 pm", "12:10"), ("9:30", "09:30"), ("noon", "10:00"), ("10:00:00", "10:00")])
def test_slots(spark, raw, expected):
    assert one(spark, D.slot("t"), t=raw) == expected


def test_decision_dates_keep_what_cannot_be_read(spark):
    assert one(spark, D.decision_date(F.lit("5 March, 2020"))) == "2020-03-05"
    assert one(spark, D.decision_date(F.lit(" sometime "))) == "sometime"


def test_titles_issues_statutes(spark):
    assert one(spark, E.case_title(F.lit("RAM kumar VS state OF delhi and ors."))) == "RAM Kumar vs State of Delhi and ors."
    assert one(spark, E.issue_list(F.lit("Article 14 in The Constitution Of India 1949 ; Section 5 in Evidence Act; ab"))) == [
        "Article 14, Constitution Of India (1949)", "Section 5, Evidence Act"]
    acts = F.lit("Under the Indian  Penal Code, Section 302 and Section 34 and Section 9")
    assert one(spark, E.statutes(acts)) == ["Indian Penal Code", "Section 302", "Section 34", "Section 9"]
    assert one(spark, E.statutes(acts, sections=2)) == ["Indian Penal Code", "Section 302", "Section 34"]
    assert one(spark, E.citation_years(F.lit(" ".join(str(1950 + n) for n in range(30))))) == [str(1950 + n) for n in range(30)]
    assert one(spark, E.cited_names(F.lit("{'Ram v. Shyam': 1.0, 'ab': 2, '1.00000': 1}"))) == ["Ram v. Shyam"]
    assert one(spark, E.whether_issues(F.lit("We ask whether the notice was valid; and WHETHER relief lies, so."))) == [
        "Whether the notice was valid.", "Whether relief lies."]
    assert one(spark, E.explicit_sections(F.lit("IPC 302 is cited")))[-1] == "IPC 302"


def test_facets(spark):
    assert one(spark, A.court_location(F.lit("High Court of Andhra Pradesh"))) == "Andhra Pradesh"
    assert one(spark, A.path_template(F.lit("/api/cases/123/abcdefghij/x"))) == "/api/cases/:id/:id/x"
    assert one(spark, A.match_level(F.lit(72.0))) == "Moderate Match"


def test_triage_terms_add_up(spark):
    text = "FIR for murder: accused absconding with passport, non-bailable, bail rejected"
    row = T.triage(spark.createDataFrame([(text,)], "text STRING")).first()
    assert (row.case_type, row.severity) == ("Criminal", "Critical")
    # 18+10+18 + 18 (non-bailable) + 22 (bail rejected) + 8 (bail) ; 12+8+18 + 22 + 12
    assert (row.bail_risk, row.escape_risk) == (94, 72)
    assert row.risk == 84 and row.priority_score == 59 and row.priority_band == "P2"
    assert row.risk_factors[:2] == ["bail signal: non-bailable", "bail signal: bail rejected"]


def test_rules_from_a_table(spark):
    rules = spark.createDataFrame(
        [(2, ["POCSO", "minor"], ["s2"], "Criminal", "Critical", True), (1, ["minor"], ["s1"], "Civil", "Low", False)],
        "ord INT, terms ARRAY<STRING>, sections ARRAY<STRING>, domain STRING, severity STRING, public_risk BOOLEAN")
    texts = spark.createDataFrame([("a minor and pocso",), ("a minor",), ("nothing",)], "text STRING")
    got = T.rule_priority(T.match_rules(texts, rules)).collect()
    assert [r.rule.ord for r in got] == [2, 1, None]
    assert [(r.rule_score, r.rule_level) for r in got] == [(100, "HIGH"), (56, "MEDIUM"), (55, "MEDIUM")]


def test_search_clamps_and_breaks_ties_by_order(spark, cases):
    queries = spark.createDataFrame([(1, "murder bail"), (2, "   "), (3, "zzzz")], "query_id LONG, text STRING")
    found = Q.search_cases(queries, cases, 50).orderBy("query_id", "rank").collect()
    assert [r.id for r in found if r.query_id == 1][0] == "c3"
    # The blank query gets the first cases as they are stored.
    assert {r.query_id for r in found} == {1, 2, 3} and len(found) == 9
    assert [r.ord for r in found if r.query_id == 2] == sorted(r.ord for r in found if r.query_id == 2)
    same = cases.withColumn("title", F.lit("x")).withColumn("similarity", F.lit(50)).withColumn("priority_score", F.lit(50))
    same = same.select(*[F.lit("y").alias(c) if c in ("summary", "judgment", "final_verdict", "why_match", "citation") else c for c in same.columns])
    same = same.withColumn("tags", F.array(F.lit("t")))
    assert [r.id for r in Q.search_cases(queries, same, 3).filter("query_id = 3").orderBy("rank").collect()] == ["c1", "c2", "c3"]


def test_search_in_blocks_equals_one_block(spark, cases):
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["land deed", "murder", "tax article", "bail", "court"])], "query_id LONG, text STRING")
    whole = Q.search_cases(queries, cases, 2).select("query_id", "rank", "id", "rank_score").collect()
    parts = Q.search_cases(queries, cases, 2, max_queries=2).select("query_id", "rank", "id", "rank_score").collect()
    assert sorted(whole) == sorted(parts)


def test_document_analysis(spark, cases):
    docs = spark.createDataFrame(
        [(1, "petition.pdf", "The petitioner cites Article 21 and AIR 2015; the appeal seeks compensation and interim relief for the accused."),
         (2, "fir copy.pdf", ""), (3, "recipe.pdf", "Mix flour and sugar, then bake slowly for an hour.")],
        "doc_id LONG, file_name STRING, text STRING")
    signals = R.document_signals(docs)
    table = R.section_table(signals, R.related_cases(signals, cases), cases).collect()
    rows = {(r.doc_id, r.section): r for r in table}
    assert len(rows) == 9
    facts = rows[1, "Facts"]
    assert facts.suspected_type == "Criminal" and facts.matches[0].title.startswith("Ram Kumar")
    assert "citation overlap" in facts.matches[0].reason
    assert rows[1, "Relief Sought"].highlights == ["interim relief", "compensation"]
    assert rows[2, "Facts"].highlights[2] == "fallback mode" and rows[2, "Facts"].suspected_type == "Criminal"
    assert [m.title for m in rows[2, "Facts"].matches] == ["Ram Kumar vs State, Criminal Appeal of 2015"]
    assert rows[3, "Facts"].matches == []
    unique = R.collect_matches(R.section_table(signals, R.related_cases(signals, cases), cases))
    assert unique.filter("doc_id = 1").count() == len({m.title for m in facts.matches})


ROSTER = "id STRING, name STRING, court_level STRING, category STRING, years_of_experience INT, case_load_capacity INT, current_case_load INT, availability STRING, district STRING"


@pytest.fixture(scope="module")
def judges(spark):
    rows = [(f"j{i}", f"Justice {chr(65 + i % 26)}{i}", ["Supreme Court", "High Court", "District Court"][i % 3],
             ["Criminal", "Civil", "Other"][i % 3], 3 + i, 40 + i % 4, 2 * i, ["Available", "Busy", "On Leave"][i % 3], "Kochi" if i % 2 else "")
            for i in range(12)]
    return spark.createDataFrame(rows, ROSTER)


def expected_ranking(case, judges):
    def rolling(s):
        h = 0
        for ch in s:
            h = (h * 31 + ord(ch)) & 0xFFFFFFFF
        return h

    scored = []
    for j in judges:
        used = j.current_case_load / j.case_load_capacity
        match = 1 if j.category == case["category"] else 0.72 if case["category"] == "Other" and j.category == "Criminal" else 0.38
        status = {"Available": 1, "Busy": 0.6}.get(j.availability, 0.15)
        if case["severity"] == "Critical" or case["risk"] >= 80:
            fit = {"Supreme Court": 1, "High Court": 0.92}.get(j.court_level, 0.68)
        elif case["severity"] == "High" or case["risk"] >= 60:
            fit = {"High Court": 1, "Supreme Court": 0.92}.get(j.court_level, 0.76)
        else:
            fit = 1 if j.court_level == "District Court" else 0.84
        total = 100 * (match * 0.3 + status * 0.22 + max(0, 1 - used) * 0.18 + min(1, j.years_of_experience / 25) * 0.1
                       + fit * 0.17 + max(0.55, min(1, case["risk"] / 100)) * 0.03)
        score = int(round(total + rolling(f"{case['seed']}:{j.name}") % 11, 6) + 0.5)
        scored.append((-score, int(used * 100 + 0.5), j.name))
    return [name for _, _, name in sorted(scored)]


@pytest.mark.parametrize("limit", [100, 3])
def test_ranking_equals_brute_force(spark, judges, limit):
    cases = [{"case_id": i, "category": c, "severity": s, "risk": r, "seed": f"case {i}"}
             for i, (c, s, r) in enumerate([("Criminal", "Critical", 90), ("Civil", "High", 65), ("Other", "Low", 20), ("Civil", "Low", 85)])]
    frame = spark.createDataFrame(
        [tuple(c.values()) for c in cases], "case_id LONG, category STRING, severity STRING, risk INT, seed STRING")
    got = J.rank_judges(frame, judges, 12, limit=limit).orderBy("case_id", "rank").collect()
    roster = judges.collect()
    for case in cases:
        assert [r.judge_name for r in got if r.case_id == case["case_id"]] == expected_ranking(case, roster)


def test_empty_roster_falls_back(spark, judges):
    cases = spark.createDataFrame([(1, "Criminal", "Low", 20, "a"), (2, "Other", "Low", 20, "b")],
                                  "case_id LONG, category STRING, severity STRING, risk INT, seed STRING")
    got = {r.case_id: r for r in J.assign_judges(cases, judges.filter("false")).collect()}
    assert got[1].judge_name in L.FALLBACK_ROSTER["Criminal"] and got[1].party_label == "Accused"
    assert got[2].judge_name in L.FALLBACK_ROSTER["Other"] and not got[2].requires_public_prosecutor


def test_bookings(spark):
    day = dt.date(2026, 3, 5)
    rows = [("h1", 1, "a", "j1", day, "10:00", "C", "R1"), ("h2", 2, "b", "j1", day, "10:00:00", "C", "R1"),
            ("h3", 3, "a", "j2", day, "10:00", "C", "R1"), ("h4", 4, "c", "j2", day, "11:00", "C", "R1")]
    h = spark.createDataFrame(rows, "id STRING, seq LONG, case_id STRING, judge_id STRING, hearing_date DATE, t STRING, court STRING, room STRING")
    h = h.withColumn("slot", D.slot_prefix("t"))
    assert {(r.id, r.accepted, r.incumbent_case) for r in S.schedule(h).collect()} == {
        ("h1", True, None), ("h2", False, "a"), ("h3", True, None), ("h4", True, None)}
    assert {(r.id, r.other_case) for r in S.room_conflicts(h).collect()} == {("h1", "b"), ("h2", "a"), ("h3", "b")}


def test_seeds_may_be_whole_texts(spark):
    texts = ["", "case 1:Justice A", "Straße 𝒜\n" * 3_000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select(H.rolling31("t").alias("a"), J._seed_hash(X.blank("t")).alias("b"))
    assert all(r.a == r.b for r in rows.collect())
    # The hash of a seed is not an expression over its signs, one array entry each.
    queue = spark.createDataFrame([(1, "Criminal", "High", 50, texts[2])], "case_id INT, category STRING, severity STRING, risk INT, seed STRING")
    judge = [("j1", "A", "High Court", "Criminal", 5, 10, 1, "Available", "")]
    judges = spark.createDataFrame(judge, "id STRING, name STRING, court_level STRING, category STRING, years_of_experience INT, case_load_capacity INT, current_case_load INT, availability STRING, district STRING")
    plan = J.rank_judges(queue, judges)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(split(" not in plan


TEXTS = [
    None, "", " \n", "İncome tax\x0bof article\x0b12", "ARTICLE 12 and the LEASE", "income\x85tax; INCOME.TAX", "no rule here, a loſs", "the writ of mandamus",
    "The court held that 1.5 acres go. Und der Rest?  Judge: X; Issues: a long question of who pays the rest of it. CITED cases: {a} b",
    "in the matter of the whole thing 1999. the v. x v. y v. z sentence is a long one! 12 . 13 \x00 the und ther sch, a long sentence. C-x] a long one goes here now.",
    "é" * 400 + " held that " + "𝒜b " * 300, "a'b' , 'c': 12.5 [x] {y} Filter: zzz; the sentence is here and there, for as long as it takes.",
]


def test_types_by_rules_equal_the_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    for variant, rules in L.CASE_TYPE_RULES.items():
        plain = X.first_rule(F.lower(X.blank("t")), rules, L.CASE_TYPE_DEFAULT[variant])
        typed = rows.select(plain.alias("a"), E.case_type("t", variant).alias("b"))
        # Whole texts go through the rules in Arrow columns.
        assert "ArrowEvalPython" in typed.select("b")._jdf.queryExecution().executedPlan().toString()
        assert all(r.a == r.b for r in typed.collect())
    looks = [("A", r"(?<![a-z])tax\b"), ("B", "[l]ease")]
    assert [r.b for r in rows.select(E.case_type("t", "import", looks).alias("b")).collect()][3:5] == ["A", "B"]


def test_excerpts_equal_the_patterns(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    anchors = ("held that", "the|und", "lease")
    same = (*anchors, r"no\Wsuch")
    got = rows.select(*[E.judgment_excerpt("t", F.lit(""), F.lit("s"), a).alias(n) for n, a in (("a", anchors), ("b", same))]).collect()
    assert all(r.a == r.b for r in got) and got[10].a.startswith("held that 𝒜b") and got[0].a == "s"


def test_summaries_of_odd_texts(spark):
    cues = ((3, "the|und"), (2, "sch"))
    got = [r.s for r in spark.createDataFrame([(t,) for t in TEXTS], "t STRING").coalesce(1).select(E.summary("t", cues).alias("s")).collect()]
    assert got[:3] == [L.SUMMARY_FALLBACK] * 3
    assert got[8] == "; a long question of who pays the rest of it. The court held that 1.5 acres go."
    assert got[9] == "13 the und ther sch, a long sentence. in the matter of the whole thing 1999. C-x a long one goes here now."
    assert got[10] == "é" * 400 + " held that 𝒜b 𝒜b 𝒜b"
    plan = spark.range(1).select(E.summary(F.lit("a")).alias("s"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_texts_are_joined_once_and_after_the_facets(spark, cases):
    raw = cases.select("id", "title", "summary", "why_match", "court", "type", "year", "tags")
    got = K.facet_filter(raw, court="High Court", kind="Civil", query="land petition")
    assert [r.id for r in got.collect()] == ["c2"]
    found = got._jdf.queryExecution().optimizedPlan().toString().split("\n")[1]
    assert "Filter" in found and found.count("concat_ws") == 1 and found.index("high") < found.index("concat_ws")


def test_case_vectors_are_told_in_the_tasks(spark, cases):
    low = ["", "the court court of 1999", "ab é der straße x12", "land " * 900]
    tokens = spark.createDataFrame([(i, t) for i, t in enumerate(low)], "i INT, t STRING").orderBy("i").select(Q._vectors(F.col("t")).alias("v")).collect()
    plain = Q.P.hashed_matrix([r.v.first for r in tokens], [r.v.second for r in tokens], Q.SECOND_WEIGHT, H.DIMS)
    assert (Q._hashed(pa.array(["x", *low]).slice(1)) == plain).all()
    queries = spark.createDataFrame([(1, "murder bail"), (2, "LAND deed")], "query_id LONG, text STRING")
    for offline in (False, True):
        found = Q.search_cases(queries, cases, 3, offline)
        assert [r.id for r in found.where("rank = 1").orderBy("query_id").collect()] == ["c3", "c2"]
        # No case is hashed sign by sign, and light search hashes none.
        assert "aggregate(split(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_long_batches_take_turns():
    texts = pa.array([f"the  case {i}. A sentence of more than a few words und so on." for i in range(2_500)])
    cues = ((3, "the|und"),)
    for work in (P.squashed, lambda t: P.summaries(t, cues), lambda t: P.quoted(t, ["und"], 20), lambda t: P.labels(t, [("A", "case 7")], "B")):
        seen = []
        got = P.by_turns(lambda t: seen.append(len(t)) or work(t), texts)
        assert got.equals(work(texts)) and seen == [1_000, 1_000, 500]
        assert len(P.by_turns(work, texts.slice(0, 0))) == 0
