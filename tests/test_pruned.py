"""Pruned retrieval, rule tables, contenders and quantiles against plain versions."""

import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import bm25 as M
from docketry.operators import chunks as C
from docketry.operators import metering
from docketry.operators import pruned as N
from docketry.operators import retrieve as R
from docketry.operators import roster as J
from docketry.operators import rules as U
from docketry.operators import triage as T
from docketry.plans import blocks as P
from docketry.sources import index_store as S

KEEP = ["court", "year", "type", "final_verdict"]
TOPICS = {"land": "boundary survey plot deed fence acre", "tax": "levy income assessor refund audit duty",
          "theft": "stolen vehicle police witness lock night", "bail": "surety bond release custody hearing appeal"}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Cases on four topics, blocks of eight chunks."""
    rng = random.Random(3)
    rows = []
    for i in range(240):
        topic = list(TOPICS)[i % 4]
        words = [rng.choice(TOPICS[topic].split() + ["court", "order", "the"]) + ("s" if rng.random() < 0.2 else "") for _ in range(150)]
        rows.append((f"c{i}", i, f"Case {topic} {i}", 1, "Judgment" if i % 3 else "Context", " ".join(words), "Court", 2000 + i % 9, topic, ""))
    sections = spark.createDataFrame(rows, "case_id string, ord long, title string, no int, section string, body string, "
                                           "court string, year int, type string, final_verdict string")
    rules = C.ChunkRules(prose="the|court|order")
    chunks = C.with_features(C.chunk_rows(sections, KEEP, rules), rules)
    path = str(tmp_path_factory.mktemp("index") / "index")
    bits, N.BLOCK_BITS = N.with_blocks.__defaults__, 3
    N.with_blocks.__defaults__ = (bits[0], 3)
    try:
        S.save_index(chunks, path, filtered=False, blocks=True)
    finally:
        N.with_blocks.__defaults__ = bits
    return (*S.load_index(spark, path), S.load_blocks(spark, path))


QUESTIONS = ["boundary survey of the plot", "income levy refund", "stolen vehicle at night article 21", "surety bond", "order of the court"]


@pytest.mark.parametrize("most", [4000, 4])
def test_pruned_bm25_equals_scoring_every_chunk(spark, index, most):
    chunks, df, stats, blocks = index
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")
    tokens = X.exploded(asked, X.tokens("text", ["the", "of", "at"]), ["token"], ["query_id"])
    found = N.bm25_top(tokens, chunks, df, stats, blocks, 5, max_queries=most)
    rows = lambda frame: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in frame.collect())
    want = rows(M.best_chunks(tokens, chunks, df, stats, 5))
    assert rows(found.hits) == want and len(want) == 25
    pairs = M.top_chunks(M.bm25(tokens, chunks, df, stats), chunks, 5)
    assert [(q, r, i) for q, r, i, _ in want] == sorted((r.query_id, r["rank"], r.id) for r in pairs.collect())
    report = {r.query_id: (r.scored, r.skipped) for r in found.report.collect()}
    assert {a + b for a, b in report.values()} == {blocks.count()} and report[0][1] > report[0][0]


def test_pruned_pool_equals_scoring_every_chunk(spark, index, most=4000):
    chunks, df, stats, blocks = index
    asked = spark.createDataFrame([(i, t, 2 + i % 3, 0.3) for i, t in enumerate(QUESTIONS)],
                                  "query_id long, text string, top_k int, min_score double")
    rules = R.QueryRules(domain_terms=tuple("boundary income stolen surety order".split()), synonyms={"bond": ["surety", "deed"]})
    found = N.candidate_pool(asked, chunks, df, stats, blocks, rules, max_queries=most)
    want = R.candidate_pool(asked, chunks, df, stats, rules, max_queries=most)
    rows = lambda frame: sorted((r.query_id, r["rank"], r.id, r.title, len(r.terms), round(r.score, 9), r.top_k) for r in frame.collect())
    assert rows(found.hits) == rows(want) and found.hits.count() > 50
    assert found.report.agg(F.sum("skipped")).first()[0] >= 0


def test_no_queries_and_no_hits(spark, index):
    chunks, df, stats, blocks = index
    tokens = spark.createDataFrame([(1, "zzzz")], "query_id long, token string")
    found = N.bm25_top(tokens, chunks, df, stats, blocks, 3)
    assert found.hits.count() == 0 and found.report.first().scored == 0
    assert N.bm25_top(tokens.limit(0), chunks, df, stats, blocks, 3).hits.count() == 0


def test_blocks_share_their_packed_queries():
    """Blocks that most queries ask for are scored together, those of few queries one by one, and unasked pairs never count."""
    rng = np.random.default_rng(7)
    n, size, q = 120, 6, 10
    value = rng.random((n, q))
    queries = pd.DataFrame({"query_id": range(100, 100 + q)})
    for share, most in ((0.9, 1), (1.0, 1), (0.05, n)):
        asked = rng.random((n // size, q)) < share
        asked[0] = True
        packs = []
        prepare = lambda part: packs.append(len(part)) or part["query_id"].to_numpy() - 100
        score = lambda state, rows, floors: value[np.ix_(rows["ord"].to_numpy(), state)]
        batch = pa.table({"ord": np.arange(n), "block": np.arange(n) // size,
                          "asked": [np.packbits(asked[b]).tobytes() for b in np.arange(n) // size]}).to_batches()[0]
        got = N.score_asked(iter([P.Rows(batch)]), queries, prepare, score, 4, ["ord"])
        masked = np.where(np.repeat(asked, size, axis=0), np.round(value, 9), -np.inf)
        want = {(100 + j, o) for j in range(q) for o in np.argsort(-masked[:, j])[:4] if masked[o, j] > -np.inf}
        assert set(zip(got["query_id"], got["ord"])) == want
        assert len(packs) <= most


# ---- rule tables ---------------------------------------------------------------
def best_rule(text, rules, word):
    low = (text or "").lower()
    def inside(t):
        return re.search(r"(?<![A-Za-z0-9_])" + re.escape(t) + r"(?![A-Za-z0-9_])", low) is not None if word else t in low
    hits = [(-sum(inside(t.lower()) for t in terms), k) for k, terms in rules]
    n, k = min(hits, default=(0, None))
    return (k, -n) if n else (None, 0)


@pytest.mark.parametrize("match", ["substring", "word"])
def test_rule_table_equals_brute_force(spark, match):
    rng = random.Random(5)
    letters = "abc é🙂."
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i, make(rng.randrange(0, 40))) for i in range(120)] + [(900, None), (901, ""), (902, "ABC " * 5000)]
    rules = [(k, [make(rng.choice([1, 2, 3, 4, 6])).strip() or "a" for _ in range(rng.randrange(0, 5))]) for k in range(1, 300)]
    rules += [(500, ["abc", "ABC", "abc"]), (501, [])]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(k, t, [f"S{k}"], "Civil", "High", False) for k, t in rules],
                                  "ord int, terms array<string>, sections array<string>, domain string, severity string, public_risk boolean")
    got = {r.doc_id: (r.rule.ord, r.rule_hits) for r in T.match_rules(frame, table, match=match, key="doc_id").collect()}
    assert got == {k: best_rule(t, rules, match == "word") for k, t in texts}
    listed = T.match_rules(frame, [r.asDict() for r in table.collect()], match=match)
    assert {r.doc_id: (r.rule.ord, r.rule_hits) for r in listed.collect()} == got


def test_rule_table_without_key_and_without_rules(spark):
    frame = spark.createDataFrame([("a b",), ("a b",), (None,)], "text string")
    table = spark.createDataFrame([(7, ["b"], ["S"], "Civil", "High", True)], "ord int, terms array<string>, sections array<string>, "
                                  "domain string, severity string, public_risk boolean")
    got = T.match_rules(frame, table)
    assert got.columns == ["text", "rule", "rule_hits"] and sorted(r.rule_hits for r in got.collect()) == [0, 1, 1]
    assert [r.rule.severity for r in T.match_rules(frame, table.limit(0)).collect()] == ["Medium"] * 3
    assert U.term_hits(frame.limit(0).withColumn("k", F.lit(1)), U.rule_terms(table), "k").count() == 0


def test_rule_terms_are_looked_for_in_distinct_units(spark):
    texts = [(1, "theron eau\nof the"), (2, "eau  of"), (3, "heron\tof"), (4, " of "), (5, "xof thex"), (6, "eau\u00a0of"), (7, None)]
    terms = ["hero", "eau\nof", "eau  of", "of", " of", "of ", "of the", " ", "u of", "eau\u00a0o", ""]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(t,) for t in terms], "term string")
    for match in ("substring", "word"):
        got = {tuple(r) for r in U.term_hits(frame, table, "doc_id", match=match).collect()}
        edge = (r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])") if match == "word" else ("", "")
        assert got == {(k, t) for k, x in texts for t in terms if re.search(edge[0] + re.escape(t) + edge[1], x or "")}
    units = spark.createDataFrame([("theron",), ("of",)], "unit string")
    assert [tuple(r) for r in U._unit_hits(units, table.where("term in ('hero', 'heroes')"), 3).collect()] == [("theron", "hero")]


def test_equal_rules_and_rules_of_one_hit_meet_no_texts(spark):
    """Many rules that share a frequent term, and copies of them, give a text one row for that term."""
    rules = [(k, ["an", f"word{k % 50}"]) for k in range(1, 1001)]
    table = spark.createDataFrame(rules, "ord int, terms array<string>")
    kept = U._earliest(U.rule_terms(table))
    assert sorted(r.ord for r in kept.select("ord").distinct().collect()) == list(range(1, 51))
    hits = spark.createDataFrame([(d, "an") for d in range(100)] + [(7, "word9"), (8, "word3")], "doc_id long, term string")
    best = {r.doc_id: tuple(r[1]) for r in U._best_rules(hits, kept, "doc_id").collect()}
    assert best == {d: {7: (2, -9), 8: (2, -3)}.get(d, (1, -1)) for d in range(100)}


# ---- roster --------------------------------------------------------------------
def test_contenders_hold_every_chosen_judge(spark):
    rng = random.Random(9)
    rows = [(f"j{i}", f"Judge {i}", rng.choice(["High Court", "District Court", "Supreme Court", None]), rng.choice(["Criminal", "Civil", "Other"]),
             rng.randrange(40), rng.choice([0, 20, 50]), rng.randrange(60), rng.choice(["Available", "Busy", "On Leave"])) for i in range(900)]
    judges = spark.createDataFrame(rows, "id string, name string, court_level string, category string, years_of_experience int, "
                                         "case_load_capacity int, current_case_load int, availability string")
    cases = spark.createDataFrame([(i, ["Criminal", "Civil", "Other"][i % 3], ["Critical", "High", "Low"][i % 5 % 3], i % 100, f"s{i}")
                                   for i in range(60)], "case_id long, category string, severity string, risk int, seed string")
    told = lambda frame: sorted((r.case_id, r["rank"], r.judge_id, r.score) for r in frame.collect())
    got = told(J.rank_judges(cases, judges, 3))
    kept = J.contenders(J._roster_columns(judges), 3).count()
    original = J.contenders
    J.contenders = lambda roster, k: roster
    try:
        assert told(J.rank_judges(cases, judges, 3)) == got
    finally:
        J.contenders = original
    assert kept < 450


def many_judges(spark, n, seed):
    rng = random.Random(seed)
    rows = [(f"j{i}", "Judge " + "x" * rng.choice([0, 0, 3]) + str(i % (n // 2)), rng.choice(["High Court", "District Court", None]),
             rng.choice(["Criminal", "Civil", "Other"]), rng.randrange(40), rng.choice([0, 20, 50]), rng.randrange(60),
             rng.choice(["Available", "Busy", "On Leave"])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, name string, court_level string, category string, years_of_experience int, "
                                       "case_load_capacity int, current_case_load int, availability string")


@pytest.mark.parametrize("k", [1, 3])
def test_chosen_judges_equal_scoring_all(spark, k):
    """The judges a chooser names hold the best of every case, and only a bounded number is scored for each."""
    judges = many_judges(spark, 3000, 5)
    cases = spark.createDataFrame([(i, ["Criminal", "Civil", "Other"][i % 3], ["Critical", "High", "Low"][i % 5 % 3], i % 100, f"seed {i * i}")
                                   for i in range(400)], "case_id long, category string, severity string, risk int, seed string")
    got = sorted((r.case_id, r["rank"], r.judge_id, r.score) for r in J.rank_judges(cases, judges, k).collect())
    roster = J._roster_columns(judges).orderBy("utilization", "judge_name", "judge_id").toPandas()
    queue = cases.select("case_id", "category", "severity", "risk", J.H.rolling31(F.concat("seed", F.lit(":"))).alias("seed_hash")).toPandas()
    scores = J._score(J._prepare(roster), queue)
    want = []
    for c in range(len(queue)):
        best = sorted(range(len(roster)), key=lambda j: (-scores[c, j], j))[:k]
        want += [(c, n + 1, roster["judge_id"][j], int(scores[c, j])) for n, j in enumerate(best)]
    assert got == want
    chooser = J.Chooser(roster, k)
    assert max(few.shape[1] for _, few in chooser.of(queue)) <= 2 * k * len(chooser.lanes) < len(roster) / 4
    copies = J.pd.concat([roster.assign(judge_id=roster["judge_id"] + f"-{i}") for i in range(8)], ignore_index=True)
    assert J._undominated(copies, k).sum() <= k * len(roster) < len(copies) / 2


# ---- block scoring -------------------------------------------------------------
def test_many_queries_take_turns_and_no_row_is_copied(spark):
    """Queries beyond a block are scored in turns: the plan holds no co-group, and no block reads rows from a shuffle."""
    import numpy as np

    from docketry.plans import blocks as P

    rows = spark.range(500).selectExpr("id AS ord", "id * 37 % 101 AS v")
    queries = spark.range(9).selectExpr("id AS query_id", "id * 13 AS at")
    score = lambda state, part, floors: -np.abs(part["v"].to_numpy(float)[:, None] - state[None, :])
    told = lambda n: sorted(tuple(r) for r in P.top_rows(
        rows, queries, lambda q: q["at"].to_numpy(float), score, 3, ["ord"], max_queries=n).select("query_id", "rank", "ord", "score").collect())
    assert told(4) == told(1) == told(9) and len(told(4)) == 27
    plan = P.top_rows(rows, queries, lambda q: q["at"].to_numpy(float), score, 3, ["ord"], max_queries=2)._jdf.queryExecution().toString()
    assert "CoGroup" not in plan and "Exchange" not in plan


def test_terms_are_found_by_pieces_of_a_word():
    from docketry.plans import blocks as P

    rng = random.Random(3)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(400)] + ["", "abca", "abca"]
    matcher = P.TermMatcher(terms)
    matcher.machine = None
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30)))
        assert matcher.inside(text) == {i for i, t in enumerate(terms) if t in text}


# ---- quantiles -----------------------------------------------------------------
@pytest.mark.parametrize("keep", [0, 50, 10_000])
def test_exact_quantiles(spark, keep):
    rng = random.Random(1)
    values = [rng.expovariate(1) ** 5 for _ in range(3000)] + [7.25] * 2000 + [1e300, -1e300, 0.0, -0.0]
    frame = spark.createDataFrame([(v,) for v in [*values, None, None]], "v double")
    shares = [0.0001, 0.3, 0.5, 0.731, 0.95, 0.9999, 1.0]
    order = sorted(values)
    want = [order[max(1, -(-len(order) * round(s * 10_000) // 10_000)) - 1] for s in shares]
    assert metering.exact_quantiles(frame, "v", shares, keep=keep) == want
    assert metering.exact_quantiles(frame.where("v is null"), "v", [0.5]) == [None]


def test_counting_hits_holds_a_turn_of_pairs(monkeypatch):
    import tracemalloc

    import numpy as np

    from docketry.plans import blocks as P

    rng = np.random.default_rng(5)
    owners = [list(rng.integers(0, 9, n)) for n in (3, 0, 5, 1, 700)]
    rows, items = rng.integers(0, 50, 400), rng.integers(0, 5, 400)
    brute = np.zeros((60, 9))
    for r, i in zip(rows, items):
        for q in owners[i]:
            brute[r, q] += 1
    for pairs in (1, 900, 10**9):
        monkeypatch.setattr(P, "PAIRS", pairs)
        assert np.array_equal(P.owner_counts((rows, items), owners, (60, 9)), brute)
    monkeypatch.setattr(P, "PAIRS", 1_000_000)
    # Two million hits that every one of ten queries asks for.
    hits = np.repeat(np.arange(20_000), 100), np.tile(np.arange(100), 20_000)
    asked = [list(range(10))] * 100
    tracemalloc.start()
    counts = P.owner_counts(hits, asked, (20_000, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (counts == 100).all() and peak < 150_000_000
