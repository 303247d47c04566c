"""Files in and out, seeds, change logs, ordinals."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.operators import changes as G
from docketry.operators import corpus as K
from docketry.operators import insights as N
from docketry.operators import metering as M
from docketry.plans.ordinal import ranked_within, with_ordinal
from docketry.plans.sizing import fits
from docketry.sources import cases as S
from docketry.sources import ops as O
from docketry.sources import pages as P


def test_csv_with_quotes_line_breaks_and_blank_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        'Case Title,Judges Name(s),Issues,Decision,Cited Cases,Citation,Date of Judgment\n'
        '"Ram, ""the"" heir vs State",A B,"bail\nmatter",1,,AIR 2001,5 March 2001\n'
        ',,,,,,\n'
        '"  ",x,,,,,\n'
        'Tax Board vs X,,income tax,,,,unknown\n')
    records = S.read_cases_csv(spark, str(tmp_path / "in.csv"))
    assert records.columns == ["case_title", "judges_name_s", "issues", "decision", "cited_cases", "citation", "date_of_judgment"]
    assert records.count() == 3
    cases = S.import_records(records).orderBy("ord").collect()
    assert [c.title for c in cases] == ['Ram, "the" heir vs State', "Tax Board vs X"]
    assert cases[0].full_text == "A B bail matter 1" and cases[0].decision_date == "2001-03-05"
    assert cases[1].case_type == "Tax" and cases[1].decision_date == "unknown"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    rows = [(f"c{i}", 'A "quoted", title\nline', *["x"] * 9) for i in range(3)]
    from docketry.schemas import RAW_CASE, RAW_CASE_FIELDS

    df = spark.createDataFrame(rows, RAW_CASE)
    S.write_cases(df, str(tmp_path / fmt), fmt)
    if fmt == "csv":
        back = S.read_cases_csv(spark, str(tmp_path / fmt))
    elif fmt == "json":
        back = S.read_cases_json(spark, str(tmp_path / fmt), lines=True)
    else:
        back = spark.read.parquet(str(tmp_path / fmt))
    assert sorted(back.select(RAW_CASE_FIELDS).collect()) == sorted(df.collect())


def test_json_array(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"case_id": "a", "title": "T"}, {"case_id": "b", "extra": 1}]))
    assert {r.case_id: r.title for r in S.read_cases_json(spark, str(tmp_path / "c.json")).collect()} == {"a": "T", "b": None}


def test_snapshot(spark, tmp_path):
    doc = {
        "judges": [{"id": "j1", "name": "B", "courtLevel": "High Court", "specializations": ["Civil"]}, {"id": "j2", "name": "A"}],
        "hearings": [{"id": "h1", "hearingDate": "05-03-2026", "hearingTime": "2:30 PM"}, {"id": "h2", "hearingDate": "04T08:24-05-2026"}],
        "managedCases": [{"id": "m1", "autoAssigned": True, "priorityScore": 62, "updatedAt": 1777863263000}],
        "activityHistory": [{"id": "a1", "type": "search", "date": "2026-05-09T05:20:18.833Z", "results": 5}],
    }
    (tmp_path / "s.json").write_text(json.dumps(doc))
    tables = O.read_ops_snapshot(spark, str(tmp_path / "s.json"))
    assert [r.id for r in O.list_judges(tables["judges"]).collect()] == ["j2", "j1"]
    assert [(r.id, str(r.hearing_day), r.slot) for r in tables["hearings"].orderBy("id").collect()] == [
        ("h1", "2026-03-05", "14:30"), ("h2", "None", "10:00")]
    assert tables["managed_cases"].first().updated_at.year == 2026
    assert tables["activity"].first().event_ts.month == 5


def test_snapshot_lines_hold_many_documents(spark, tmp_path):
    """One document a line: a task reads one at a time, a file may hold any number."""
    docs = [{"judges": [{"id": f"j{i}", "name": "A"}], "hearings": [{"id": f"h{i}-{n}", "hearingDate": "05-03-2026"} for n in range(i)]} for i in range(4)]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(d) for d in docs))
    tables = O.read_ops_snapshot(spark, str(tmp_path / "s.json"), lines=True)
    assert sorted(r.id for r in tables["judges"].collect()) == ["j0", "j1", "j2", "j3"]
    assert sorted(r.id for r in tables["hearings"].collect()) == ["h1-0", "h2-0", "h2-1", "h3-0", "h3-1", "h3-2"]


def test_checked_snapshot_documents_stay_small(spark, tmp_path, monkeypatch):
    """Copies of the tables bring more documents, not larger ones."""
    from checks import record_checks as C

    line = spark.range(6000).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "1L AS l_suppkey", "cast(id % 5 AS int) AS l_linenumber", "timestamp'1998-01-02' AS l_shipdate")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 1L AS s_suppkey, 'S' AS s_name, 3 AS s_nationkey, 1.0D AS s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    made = []
    monkeypatch.setattr(C, "folder", lambda s, name: made.append(str(tmp_path / "out")) or made[-1])
    monkeypatch.setattr(C, "SNAPSHOT_ROWS", 10)
    assert C.snapshot_hearings(spark, str(tmp_path)).count() == 6000
    sizes = spark.read.schema("hearings ARRAY<STRUCT<id: STRING>>").json(made[0]).selectExpr("size(hearings) AS n").collect()
    assert sum(r.n for r in sizes) == 6000 and max(r.n for r in sizes) < 600


def test_seed_modes(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id STRING, n INT, s STRING")
    seed = spark.createDataFrame([("b", 9, None), ("c", 3, "z")], "id STRING, n INT, s STRING")
    assert sorted(O.apply_seed(target, seed).collect()) == [("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")]
    assert sorted(O.apply_seed(target, seed, "refresh", ["n"]).collect()) == [("a", 1, "x"), ("b", 9, "y"), ("c", 3, "z")]


def test_change_log(spark):
    target = spark.createDataFrame([("a", "t1", 1.0), ("b", "t2", 2.0)], "id STRING, title STRING, score DOUBLE")
    log = spark.createDataFrame(
        [("a", 1, "P", None, 5.0), ("b", 2, "D", None, None), ("b", 3, "P", "ghost", None), ("c", 4, "U", "new", None),
         ("c", 5, "P", None, 7.0), ("d", 6, "P", "ghost", 1.0), ("a", 7, "U", "fresh", None)],
        "id STRING, seq LONG, op STRING, title STRING, score DOUBLE")
    got = sorted(G.apply_changes(target, log, ["title", "score"]).collect())
    assert got == [("a", "fresh", None), ("c", "new", 7.0)]
    assert sorted(G.delete(target, log.filter("id = 'a'")).collect()) == [("b", "t2", 2.0)]


def test_ordinals_and_ranks_with_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("k"), (F.col("id") * 7919 % 5003).alias("v"))
    got = with_ordinal(df, [F.col("v")], partitions=7).orderBy("v").collect()
    assert [r.ordinal for r in got] == list(range(5000))
    ranks = ranked_within(df, ["k"], [F.desc("v")]).collect()
    by_key = {}
    for r in sorted(ranks, key=lambda r: (r.k, -r.v)):
        by_key[r.k] = by_key.get(r.k, 0) + 1
        assert r["rank"] == by_key[r.k]


def test_size_guard(spark):
    assert fits(spark.range(10), 10) and not fits(spark.range(11), 10)


def test_corpus_target_and_top_up(spark):
    schema = "ord LONG, title STRING, decision_date STRING, court STRING"
    primary = spark.createDataFrame([(i, f"T{i % 4}", "", "C") for i in range(6)], schema)
    extra = spark.createDataFrame([(i, f"E{i}", "", "C") for i in range(20)], schema)
    got = K.build_corpus(primary, extra, 8).orderBy("ord").collect()
    # 2 missing + 1 spare are taken; 4 distinct primary titles stay
    assert [r.title for r in got] == ["T0", "T1", "T2", "T3", "E0", "E1", "E2"]
    assert [r.case_id for r in got][:2] == ["CASE-000001", "CASE-000002"]
    assert len(K.build_corpus(primary, extra, 3).collect()) == 3


def test_links(spark):
    html = (
        '<a href="/docfragment/77/?q=1">Frag <b>one</b></a><a class="r" href="/doc/12/">A &amp; B on 5 March, 2020</a>'
        '<a href="/doc/13/">Full Document</a><a href="/browse/supremecourt/2020/">2020</a><a href="/browse/supremecourt/2020/">again</a>'
        '<a href="/search/?formInput=x doctypes:supremecourt fromdate:1">m</a>')
    pages = spark.createDataFrame([(1, html), (2, html)], "page_id LONG, html STRING")
    links = P.document_links(pages)
    assert [(r.no, r.href, r.label) for r in links.filter("page_id = 1").orderBy("no").collect()] == [
        (0, "/doc/77/", "Frag one"), (1, "/doc/12/", "A & B on 5 March, 2020")]
    assert P.unseen_links(links).count() == 2
    case = P.links_to_cases(links.filter("page_id = 1 and no = 1")).first()
    assert (case.title, case.decision_date) == ("A & B", "2020-03-05")
    assert [r.url for r in P.listing_links(pages.filter("page_id = 1")).collect()] == ["https://example.org/browse/supremecourt/2020/"]
    assert P.listing_links(pages, "search").count() == 2
    urls = P.expand_page_urls(spark.createDataFrame([("u?x=1",), ("v",)], "url STRING"), 2)
    assert {r.page_url for r in urls.collect()} == {"u?x=1", "u?x=1&pagenum=1", "v", "v?pagenum=1"}


def test_days_trends_and_percentiles(spark):
    rows = [("e1", "search", "land", "2026-03-02 10:00:00"), ("e2", "search", "Land ", "2026-03-02 09:00:00"), ("e3", "view", "x", "2026-03-01 09:00:00"),
            ("e4", "search", "tax", "2026-03-01 08:00:00"), ("e5", "search", "land", "2026-02-01 08:00:00")]
    events = spark.createDataFrame(rows, "id STRING, type STRING, title STRING, t STRING").withColumn("event_ts", F.to_timestamp("t"))
    days = {str(r.day): r.events for r in N.activity_by_day(events).collect()}
    assert days == {"2026-03-02": 2, "2026-03-01": 2, "2026-02-01": 1}
    trends = [(r.topic, r.searches, r.growth) for r in N.trending_topics(events).collect()]
    assert trends == [("Land", 3, 100), ("Tax", 1, 0)]
    months = [(str(r.month), r.searches) for r in N.monthly_searches(events, "2026-03-20", 3).orderBy("month").collect()]
    assert months == [("2026-01-01", 0), ("2026-02-01", 1), ("2026-03-01", 3)]
    log = spark.range(1, 101).select(F.col("id").cast("double").alias("duration_ms"))
    got = M.latency_summary(log).first()
    assert (got.avg, got.p95, got.max) == (50.5, 95.0, 100.0)
    assert M.latency_summary(log, approximate=True).first().p95 == 95.0


def test_import_ids_do_not_depend_on_partitions(spark):
    rows = [(i, f"Case {i}", "", "", f"text {i}", "", "", "") for i in range(40)]
    records = spark.createDataFrame(
        rows, "n INT, case_title STRING, judges_name_s STRING, issues STRING, decision STRING, cited_cases STRING, citation STRING, date_of_judgment STRING")
    got = S.import_records(records.repartition(5), "n").orderBy("ord").collect()
    assert [(r.case_id, r.title) for r in got] == [(f"IN-SC-{i + 1:06d}", f"Case {i}") for i in range(40)]
    unordered = S.import_records(records.drop("n").repartition(7)).collect()
    assert sorted(r.case_id for r in unordered) == [f"IN-SC-{i + 1:06d}" for i in range(40)]


def test_import_bodies_are_squashed_once(spark):
    rows = [(1, " A ", None, "\u00a0 x\ty ", "a\x00\n b  ", ""), (2, "B", "", " \n\x00\u3000", "", None), (3, " ", "", "x", "", "")]
    records = spark.createDataFrame(rows, "n INT, case_title STRING, judges_name_s STRING, issues STRING, decision STRING, cited_cases STRING").withColumns(
        {"citation": F.lit(""), "date_of_judgment": F.lit("")})
    got = S.import_records(records, "n")
    # Untitled rows and those without a sign in the body go after they are numbered.
    assert [(r.ord, r.title, r.full_text) for r in got.collect()] == [(0, "A", "x y a b")]
    plan = got.select("ord", "full_text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(coalesce(decision") == 0 and plan.count("squash(") == 1


def test_a_hot_key_is_joined_where_its_rows_lie(spark, capsys):
    from docketry.plans.hot import join_by_key

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id")
    single = rows.groupBy("k").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    got = join_by_key(rows, single, ["k"], "n", hot_keys=10)
    assert got.count() == 3000 and got.filter("first <> CASE WHEN k = 0 THEN 0 ELSE k END").count() == 0
    # Shuffled joins see the cold keys only.
    cold = rows.join(single.filter("n * 10 > 3000"), "k", "left_anti")
    assert cold.count() == 999
    assert join_by_key(rows.limit(0), single.limit(0), ["k"], "n").collect() == []
