"""Scheduling, change logs, dashboard rollups and metering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.base import Check, table, texts
from docketry.functions import dates as D
from docketry.functions import facets as A
from docketry.operators import changes as G
from docketry.operators import corpus as K
from docketry.operators import insights as I
from docketry.operators import metering as M
from docketry.operators import schedule as H
from docketry.sources import ops as O


def hearings(spark, sf_dir):
    """Line items as hearings: supplier = judge, ship date = day, line number = slot."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"),
        (F.col("l_quantity") * 1).cast("int"),
    )
    return li.select(
        key.alias("id"), (F.col("l_orderkey") * 100_000 + F.col("l_partkey")).alias("seq"),
        F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("judge_id"),
        F.to_date("l_shipdate").alias("hearing_date"), F.format_string("%02d:00", F.col("l_linenumber") + 8).alias("slot"),
        F.concat(F.lit("Court "), (F.col("l_suppkey") % 10).cast("string")).alias("court"),
        F.concat(F.lit("Room "), (F.col("l_partkey") % 3).cast("string")).alias("room"),
        F.when(F.col("l_returnflag") == "A", "Scheduled").when(F.col("l_returnflag") == "R", "Postponed").otherwise("Completed").alias("status"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("note "), F.col("l_partkey"))).alias("notes"),
    )


def slot_conflicts(spark, sf_dir):
    return H.slot_conflicts(hearings(spark, sf_dir)).select(
        "id", "judge_id", "hearing_date", "slot", "incumbent_id", "bookings")


def scheduled(spark, sf_dir):
    return H.schedule(hearings(spark, sf_dir)).select("id", "accepted", "incumbent_case")


def room_conflicts(spark, sf_dir):
    return H.room_conflicts(hearings(spark, sf_dir)).select("id", "case_id", "other_id", "other_case")


def rebooked(spark, sf_dir):
    h = hearings(spark, sf_dir).withColumn("slot", F.lit("10:00")).withColumn(
        "hearing_date", F.trunc("hearing_date", "year"))
    return H.merge_rebookings(h, ["room", "status", "notes"]).select(
        "case_id", "hearing_date", "id", "room", "status", "notes", "bookings")


def month(spark, sf_dir):
    return H.hearings_in_month(hearings(spark, sf_dir), 1997, 5).select("id", "hearing_date")


def upcoming(spark, sf_dir):
    return H.upcoming_hearings(hearings(spark, sf_dir), dt.date(1998, 1, 1), 5).select("id", "hearing_date")


def statuses(spark, sf_dir):
    return H.hearing_status_counts(hearings(spark, sf_dir))


def listed(spark, sf_dir):
    return H.list_hearings(hearings(spark, sf_dir), judge_id=7).select("id", "hearing_date", "slot")


def change_log(spark, sf_dir):
    """Events as changes of a customer: sign-ups replace, clicks, views and purchases patch, errors delete."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"),
        F.when(kind == "signup", "U").when(kind == "error", "D").otherwise("P").alias("op"),
        F.when(kind != "view", kind).alias("status"), F.when(kind != "click", F.col("value")).alias("score"),
    )


def customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("score"))


def replayed(spark, sf_dir):
    return G.apply_changes(customers(spark, sf_dir), change_log(spark, sf_dir), ["status", "score"])


def seeded(spark, sf_dir):
    c = customers(spark, sf_dir)
    seed = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("status"), F.col("s_acctbal").alias("score"))
    return O.apply_seed(c, seed, "refresh", ["score"])


def removed(spark, sf_dir):
    gone = table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(F.col("user_id").alias("id"))
    return G.delete(customers(spark, sf_dir), gone)


def appended(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("upload").alias("type"), F.col("text").alias("title"))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit(None).cast("string").alias("type"), F.col("text").alias("title"))
    return G.append_events(d, c)


def activity(spark, sf_dir):
    """Events as activity: clicks and views are searches, the number in the props the topic."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").alias("event_ts"),
        F.when(F.col("event_type").isin("click", "view"), "search").when(F.col("event_type") == "signup", "upload").otherwise("view").alias("type"),
        F.concat(F.lit(" Topic "), F.get_json_object("props", "$.k")).alias("title"),
        (F.col("event_id") % 8).cast("int").alias("results"),
    )


def by_day(spark, sf_dir):
    return I.activity_by_day(activity(spark, sf_dir))


def timeline(spark, sf_dir):
    return I.activity_timeline(activity(spark, sf_dir)).select("day", "id", "place")


def monthly(spark, sf_dir):
    return I.monthly_searches(activity(spark, sf_dir), dt.datetime(2024, 3, 15))


def trending(spark, sf_dir):
    return I.trending_topics(activity(spark, sf_dir), 5)


def trending_feed(spark, sf_dir):
    return I.trending_topics(activity(spark, sf_dir), 5, feed=100)


def tiers(spark, sf_dir):
    return I.result_tiers(activity(spark, sf_dir))


def latest(spark, sf_dir):
    return I.latest(activity(spark, sf_dir), 100).select("id", "event_ts", "type")


def valid(spark, sf_dir):
    e = activity(spark, sf_dir).withColumn("title", F.when(F.col("id") % 4 > 0, F.col("title")))
    return I.valid_events(e).select("id", "title")


def order_cases(spark, sf_dir):
    """Orders as scored cases."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    score = (F.floor(F.col("o_totalprice")) % 80 + 20).cast("int")
    return o.select(
        k.cast("string").alias("id"), k.alias("ord"), (F.floor(F.col("o_totalprice")) % 54 + 45).cast("int").alias("similarity"),
        score.alias("priority_score"), A.band(score).alias("priority_band"), F.col("o_orderpriority").alias("type"),
        F.when(k % 4 == 0, "Delhi High Court").when(k % 4 == 1, "Supreme Court of India").when(k % 4 == 2, "Madras High Court").otherwise("District Court, Patna").alias("court"),
        F.array(F.col("o_orderstatus"), F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string"))).alias("tags"),
        F.col("o_orderstatus").alias("status"),
        F.when(k % 3 == 0, "Unassigned").when(k % 3 == 1, "").otherwise("Judge A").alias("assigned_judge"),
        (F.col("o_custkey") % 97).cast("double").alias("risk_score"),
    )


def histogram(spark, sf_dir):
    return I.similarity_histogram(order_cases(spark, sf_dir))


def clusters(spark, sf_dir):
    return I.case_clusters(order_cases(spark, sf_dir))


def topics(spark, sf_dir):
    return I.top_topics(order_cases(spark, sf_dir))


def matrix(spark, sf_dir):
    return I.priority_matrix(order_cases(spark, sf_dir))


def signals(spark, sf_dir):
    d = texts(spark, sf_dir).select(F.col("source").alias("title"), F.col("text").alias("summary"))
    return I.severity_signals(d, {"first": "ther|sch", "second": "eau|elle", "third": "una", "fourth": "license|src1"})


def grouped(spark, sf_dir):
    return I.group_cases(order_cases(spark, sf_dir), A.court_location("court"))


def in_band(spark, sf_dir):
    return K.cases_in_band(order_cases(spark, sf_dir), "P1").select("id", "priority_score")


def top_cases(spark, sf_dir):
    return K.top_priority(order_cases(spark, sf_dir), 20).select("id", "priority_score")


def queue(spark, sf_dir):
    return K.case_queue(order_cases(spark, sf_dir)).select("id", "priority_band", "risk_score")


def edges(spark, sf_dir):
    return I.similarity_edges(order_cases(spark, sf_dir))


def kpis(spark, sf_dir):
    return I.insight_kpis(order_cases(spark, sf_dir), activity(spark, sf_dir))


def request_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), "ts", F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/x"), (F.col("event_id") % 7).cast("string")).alias("path"),
        (F.lit(200) + F.col("event_id") % 4 * 100).cast("int").alias("status"), F.col("value").alias("duration_ms"),
        F.col("user_id").alias("client"),
    )


def metrics(spark, sf_dir):
    return M.request_metrics(request_log(spark, sf_dir))


SHARES = (0.01, 0.5, 0.9, 0.95, 0.999, 1.0)


def quantiles(spark, sf_dir):
    return M.latency_quantiles(request_log(spark, sf_dir), SHARES)


def latency(spark, sf_dir):
    return M.latency_summary(request_log(spark, sf_dir)).select(F.round("avg", 4).alias("avg"), "p95", "max")


def audit(spark, sf_dir):
    return M.audit_tail(request_log(spark, sf_dir), 3000).select("id", "ts")


def limited(spark, sf_dir):
    return M.rate_limit(request_log(spark, sf_dir), 2, 6 * 3_600_000).select("client", "id", "allowed", "retry_after_ms")


def limited_busy(spark, sf_dir):
    """One client holds a third of all requests; windows are short beside its traffic."""
    e = request_log(spark, sf_dir).withColumn("client", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("client")))
    return M.rate_limit(e, 3, 3_600_000).select("client", "id", "allowed", "retry_after_ms")


def slots(spark, sf_dir):
    k = F.col("o_orderkey")
    hour, minute = (k % 13).cast("string"), F.lpad((k % 60).cast("string"), 2, "0")
    raw = F.when(k % 5 == 0, F.concat(hour, F.lit(":"), minute)).when(k % 5 == 1, F.concat(hour, F.lit(":"), minute, F.lit(" PM"))).when(
        k % 5 == 2, F.concat(hour, F.lit(":"), minute, F.lit("am"))).when(k % 5 == 3, "noon").otherwise("")
    day = F.when(k % 3 == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("04T08:24-05-2026")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.slot(raw).alias("slot"), D.hearing_date(day).alias("day"), D.date_dmy(day).alias("dmy"),
        D.decision_date(F.date_format("o_orderdate", "d MMMM, yyyy")).alias("decided"))


HEARINGS = """
hearings AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), l_quantity::INT) AS id,
  l_orderkey * 100000 + l_partkey AS seq, l_orderkey AS case_id, l_suppkey AS judge_id, l_shipdate::DATE AS hearing_date,
  lpad((l_linenumber + 8)::VARCHAR, 2, '0') || ':00' AS slot, 'Court ' || (l_suppkey % 10) AS court, 'Room ' || (l_partkey % 3) AS room,
  CASE l_returnflag WHEN 'A' THEN 'Scheduled' WHEN 'R' THEN 'Postponed' ELSE 'Completed' END AS status,
  CASE WHEN l_partkey % 2 = 0 THEN 'note ' || l_partkey END AS notes FROM lineitem)"""
SLOTS = HEARINGS + """,
slots AS (SELECT *, first_value(id) OVER w AS incumbent_id, first_value(case_id) OVER w AS incumbent_case,
  count(*) OVER (PARTITION BY judge_id, hearing_date, slot) AS bookings
  FROM hearings WINDOW w AS (PARTITION BY judge_id, hearing_date, slot ORDER BY seq, id))"""
ACTIVITY = """
activity AS (SELECT event_id AS id, ts AS event_ts, CASE WHEN event_type IN ('click', 'view') THEN 'search'
  WHEN event_type = 'signup' THEN 'upload' ELSE 'view' END AS type, ' Topic ' || (props::JSON->>'k') AS title, (event_id % 8)::INT AS results FROM events)"""


def trend(source):
    return f"""
f AS (SELECT *, row_number() OVER (ORDER BY event_ts DESC, id DESC) - 1 AS spot, count(*) OVER () AS n, lower(trim(title)) AS topic
  FROM {source} WHERE type = 'search' AND title <> ''),
c AS (SELECT topic, count(*) AS searches, count(*) FILTER (WHERE spot < n // 2) AS cur, count(*) FILTER (WHERE spot >= n // 2) AS prev FROM f GROUP BY topic)
SELECT upper(topic[1]) || topic[2:] AS topic, searches, CASE WHEN prev = 0 THEN 100 ELSE greatest(0, floor(
  ((CASE WHEN cur > 0 THEN cur ELSE searches END) - prev)::DOUBLE / prev * 100 + 0.5)) END::INT AS growth FROM c ORDER BY searches DESC, c.topic LIMIT 5"""


BAND = "CASE WHEN s >= 85 THEN 'P0' WHEN s >= 70 THEN 'P1' WHEN s >= 50 THEN 'P2' ELSE 'P3' END"
ORDERS = f"""
cases AS (SELECT *, {BAND} AS band FROM (SELECT *, (floor(o_totalprice)::BIGINT % 54 + 45)::INT AS similarity,
  (floor(o_totalprice)::BIGINT % 80 + 20)::INT AS s FROM orders))"""
SPINE = "spine(no, range) AS (VALUES (0, '90-100%'), (1, '80-89%'), (2, '70-79%'), (3, '60-69%'), (4, '50-59%'), (5, '<50%'))"
LOG = """
log AS (SELECT event_id AS id, ts, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
  '/api/' || event_type || '/:id/x' || (event_id % 7) AS path, (2 + event_id % 4) || 'xx' AS status_class, value FROM events)"""


def limiter(client, limit, window):
    """One row per request in time order; the window state is carried along."""
    return f"""
WITH RECURSIVE e AS (SELECT {client} AS client, event_id AS id, epoch_us(ts) // 1000 AS t,
  row_number() OVER (PARTITION BY {client} ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (
  SELECT client, id, n, t, t AS start, 1 AS used, true AS allowed FROM e WHERE n = 1 UNION ALL
  SELECT e.client, e.id, e.n, e.t, CASE WHEN e.t - r.start >= {window} THEN e.t ELSE r.start END,
    CASE WHEN e.t - r.start >= {window} THEN 1 ELSE least({limit}, r.used + 1) END,
    e.t - r.start >= {window} OR r.used < {limit} FROM r JOIN e ON e.client = r.client AND e.n = r.n + 1)
SELECT client, id, allowed, CASE WHEN allowed THEN 0 ELSE greatest(1, start + {window} - t) END::BIGINT AS retry_after_ms FROM r"""


CHECKS = [
    Check("hearing_slot_conflicts", slot_conflicts, f"""
WITH {SLOTS} SELECT id, judge_id, hearing_date, slot, incumbent_id, bookings FROM slots WHERE id <> incumbent_id"""),
    Check("hearing_schedule", scheduled, f"""
WITH {SLOTS} SELECT id, id = incumbent_id AS accepted, CASE WHEN id <> incumbent_id THEN incumbent_case END AS incumbent_case FROM slots"""),
    Check("hearing_room_conflicts", room_conflicts, f"""
WITH {HEARINGS}, own AS (SELECT hearing_date, slot, court, room, case_id, min_by(id, (seq, id)) AS id, min((seq, id)) AS k FROM hearings GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY hearing_date, slot, court, room ORDER BY k, case_id) AS n FROM own)
SELECT h.id, h.case_id, CASE WHEN a.case_id <> h.case_id THEN a.id ELSE b.id END AS other_id,
  CASE WHEN a.case_id <> h.case_id THEN a.case_id ELSE b.case_id END AS other_case
FROM hearings h JOIN r a USING (hearing_date, slot, court, room) JOIN r b USING (hearing_date, slot, court, room) WHERE a.n = 1 AND b.n = 2"""),
    Check("hearing_rebookings", rebooked, f"""
WITH {HEARINGS} SELECT case_id, date_trunc('year', hearing_date)::DATE AS hearing_date, min_by(id, (seq, id)) AS id, max_by(room, (seq, id)) AS room,
  max_by(status, (seq, id)) AS status, max_by(notes, (seq, id)) FILTER (WHERE notes IS NOT NULL) AS notes, count(*) AS bookings
FROM hearings GROUP BY case_id, date_trunc('year', hearing_date)::DATE"""),
    Check("hearing_month", month, f"""
WITH {HEARINGS} SELECT id, hearing_date FROM hearings WHERE year(hearing_date) = 1997 AND month(hearing_date) = 5"""),
    Check("hearing_upcoming", upcoming, f"""
WITH {HEARINGS} SELECT id, hearing_date FROM hearings WHERE hearing_date >= DATE '1998-01-01' ORDER BY hearing_date, seq LIMIT 5"""),
    Check("hearing_status_counts", statuses, f"WITH {HEARINGS} SELECT status, count(*) AS hearings FROM hearings GROUP BY status"),
    Check("hearing_listing", listed, f"WITH {HEARINGS} SELECT id, hearing_date, slot FROM hearings WHERE judge_id = 7"),
    Check("change_replay", replayed, """
WITH log AS (
  SELECT c_custkey AS id, -1 AS seq, 'U' AS op, c_mktsegment AS status, c_acctbal AS score FROM customer UNION ALL
  SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'U' WHEN 'error' THEN 'D' ELSE 'P' END,
    CASE WHEN event_type <> 'view' THEN event_type END, CASE WHEN event_type <> 'click' THEN value END FROM events),
base AS (SELECT * FROM log WHERE op IN ('U', 'D') QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1),
later AS (SELECT b.id, max_by(l.status, l.seq) FILTER (WHERE l.status IS NOT NULL) AS status, max_by(l.score, l.seq) FILTER (WHERE l.score IS NOT NULL) AS score
  FROM base b JOIN log l ON l.id = b.id AND l.seq >= b.seq WHERE b.op = 'U' GROUP BY b.id)
SELECT id, status, score FROM later"""),
    Check("seed_refresh", seeded, """
WITH s AS (SELECT s_suppkey * 20 AS id, s_name AS status, s_acctbal AS score FROM supplier)
SELECT coalesce(c_custkey, id) AS id, CASE WHEN c_custkey IS NULL THEN status ELSE c_mktsegment END AS status,
  coalesce(score, c_acctbal) AS score FROM customer FULL JOIN s ON id = c_custkey"""),
    Check("change_delete", removed, """
SELECT c_custkey AS id, c_mktsegment AS status, c_acctbal AS score FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')"""),
    Check("activity_append", appended, """
SELECT doc_id AS id, 'upload' AS type, text AS title FROM documents UNION ALL
SELECT conv_id * 1000 + turn, 'view', text FROM conversations"""),
    Check("activity_by_day", by_day, f"WITH {ACTIVITY} SELECT event_ts::DATE AS day, count(*) AS events FROM activity GROUP BY 1"),
    Check("activity_timeline", timeline, f"""
WITH {ACTIVITY} SELECT event_ts::DATE AS day, id, row_number() OVER (PARTITION BY event_ts::DATE ORDER BY event_ts DESC, id DESC) AS place FROM activity"""),
    Check("monthly_searches", monthly, f"""
WITH {ACTIVITY}, m AS (SELECT unnest(generate_series(DATE '2023-10-01', DATE '2024-03-01', INTERVAL 1 MONTH))::DATE AS month)
SELECT month, count(id) AS searches FROM m LEFT JOIN activity ON type = 'search' AND date_trunc('month', event_ts)::DATE = month GROUP BY month"""),
    Check("trending_topics", trending, f"WITH {ACTIVITY}, {trend('activity')}"),
    Check("trending_topics_feed", trending_feed, f"""
WITH {ACTIVITY}, feed AS (SELECT * FROM activity ORDER BY event_ts DESC, id DESC LIMIT 100), {trend('feed')}"""),
    Check("result_tiers", tiers, f"""
WITH {ACTIVITY}, {SPINE}, t AS (SELECT CASE WHEN results >= 5 THEN 0 WHEN results = 4 THEN 1 WHEN results = 3 THEN 2 WHEN results = 2 THEN 3 ELSE 4 END AS no,
  results FROM activity WHERE type = 'search' AND results > 0)
SELECT spine.no, range, coalesce(sum(results), 0)::BIGINT AS results FROM spine LEFT JOIN t USING (no) GROUP BY ALL"""),
    Check("activity_latest", latest, f"WITH {ACTIVITY} SELECT id, event_ts, type FROM activity ORDER BY event_ts DESC, id DESC LIMIT 100"),
    Check("activity_valid", valid, f"WITH {ACTIVITY} SELECT id, title FROM activity WHERE id % 4 > 0"),
    Check("similarity_histogram", histogram, f"""
WITH {ORDERS}, {SPINE}, t AS (SELECT CASE WHEN similarity >= 90 THEN 0 WHEN similarity >= 80 THEN 1 WHEN similarity >= 70 THEN 2
  WHEN similarity >= 60 THEN 3 WHEN similarity >= 50 THEN 4 ELSE 5 END AS no FROM cases)
SELECT spine.no, range, count(t.no) AS cases FROM spine LEFT JOIN t USING (no) GROUP BY ALL"""),
    Check("case_clusters", clusters, """
SELECT o_orderpriority AS type, count(*) AS cases FROM orders GROUP BY 1 ORDER BY cases DESC, type LIMIT 5"""),
    Check("case_topics", topics, """
SELECT topic, count(*) AS cases FROM (SELECT unnest([o_orderstatus, 'c' || (o_custkey % 9)]) AS topic FROM orders) GROUP BY 1 ORDER BY cases DESC, topic LIMIT 6"""),
    Check("priority_matrix", matrix, f"""
WITH {ORDERS}, labels(band, label, threshold) AS (VALUES ('P0', 'Critical', 85), ('P1', 'High', 70), ('P2', 'Medium', 50), ('P3', 'Low', 0))
SELECT band, label, threshold, count(o_orderkey) AS cases, floor(count(o_orderkey)::DOUBLE / (SELECT count(*) FROM orders) * 100 + 0.5)::INT AS percent
FROM labels LEFT JOIN cases USING (band) GROUP BY ALL"""),
    Check("severity_signals", signals, """
SELECT count(*) FILTER (WHERE regexp_matches(t, 'ther|sch')) AS first, count(*) FILTER (WHERE regexp_matches(t, 'eau|elle')) AS second,
  count(*) FILTER (WHERE regexp_matches(t, 'una')) AS third, count(*) FILTER (WHERE regexp_matches(t, 'license|src1')) AS fourth
FROM (SELECT lower(source || text) AS t FROM documents)"""),
    Check("case_groups", grouped, """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'Delhi' WHEN 1 THEN 'National' WHEN 2 THEN 'Madras' ELSE 'Patna' END AS "group", count(*) AS cases FROM orders GROUP BY 1"""),
    Check("cases_in_band", in_band, f"WITH {ORDERS} SELECT o_orderkey::VARCHAR AS id, s AS priority_score FROM cases WHERE band = 'P1'"),
    Check("top_priority_cases", top_cases, f"""
WITH {ORDERS} SELECT o_orderkey::VARCHAR AS id, s AS priority_score FROM cases ORDER BY s DESC, o_orderkey LIMIT 20"""),
    Check("work_queue", queue, f"""
WITH {ORDERS} SELECT o_orderkey::VARCHAR AS id, band AS priority_band, (o_custkey % 97)::DOUBLE AS risk_score FROM cases WHERE o_orderkey % 3 < 2"""),
    Check("similarity_edges", edges, f"""
WITH {ORDERS}, n AS (SELECT o_orderkey AS k, similarity AS s FROM cases WHERE similarity >= 70), v AS (SELECT DISTINCT s FROM n),
near AS (SELECT v.s, n.k, least(v.s, n.s) AS w FROM v, n QUALIFY row_number() OVER (PARTITION BY v.s ORDER BY least(v.s, n.s) DESC, n.k) <= 13)
SELECT a.k::VARCHAR AS source, b.k::VARCHAR AS target, b.w AS weight FROM n a JOIN near b ON b.s = a.s AND b.k <> a.k
QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY b.w DESC, b.k) <= 12"""),
    Check("insight_kpis", kpis, f"""
WITH {ACTIVITY}, t AS (SELECT lower(trim(title)) AS topic, count(*) AS n FROM activity WHERE type = 'search' GROUP BY 1 ORDER BY n DESC, topic LIMIT 1),
c AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, k LIMIT 1)
SELECT (SELECT count(*) FROM orders) AS cases_indexed, (SELECT count(*) FROM activity WHERE type = 'search') AS search_volume,
  (SELECT upper(topic[1]) || topic[2:] FROM t) AS top_topic, (SELECT k FROM c) AS largest_cluster, (SELECT n FROM c) AS largest_cluster_cases"""),
    Check("request_metrics", metrics, f"""
WITH {LOG}, g AS (SELECT 'total' AS dimension, '' AS value, count(*) AS requests, avg(value) AS a, max(value) AS m FROM log UNION ALL
  SELECT 'method', method, count(*), avg(value), max(value) FROM log GROUP BY method UNION ALL
  SELECT 'status_class', status_class, count(*), avg(value), max(value) FROM log GROUP BY status_class UNION ALL
  SELECT * FROM (SELECT 'path', path, count(*) AS n, avg(value), max(value) FROM log GROUP BY path ORDER BY n DESC, path LIMIT 20))
SELECT dimension, value, requests, round(a, 2) AS avg_ms, round(m, 2) AS max_ms FROM g"""),
    Check("latency_quantiles", quantiles, " UNION ALL ".join(
        f"SELECT {s}::DOUBLE AS share, quantile_disc(value, {s}) AS value FROM events" for s in SHARES)),
    Check("latency_summary", latency, "SELECT round(avg(value), 4) AS avg, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events"),
    Check("audit_tail", audit, "SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 3000"),
    Check("rate_limit", limited, limiter("user_id", 2, 6 * 3_600_000)),
    Check("rate_limit_busy_client", limited_busy, limiter("CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END", 3, 3_600_000)),
    Check("hearing_dates_and_slots", slots, """
WITH o AS (SELECT *, o_orderkey AS k, o_orderkey % 13 AS h, lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS m FROM orders)
SELECT o_orderkey, CASE k % 5 WHEN 0 THEN lpad(h::VARCHAR, 2, '0') || ':' || m WHEN 1 THEN (CASE WHEN h < 12 THEN h + 12 ELSE h END) || ':' || m
    WHEN 2 THEN lpad((CASE WHEN h = 12 THEN 0 ELSE h END)::VARCHAR, 2, '0') || ':' || m ELSE '10:00' END AS slot,
  CASE WHEN k % 3 < 2 THEN o_orderdate::DATE END AS day, CASE WHEN k % 3 < 2 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE '04T08:24-05-2026' END AS dmy,
  strftime(o_orderdate, '%Y-%m-%d') AS decided FROM o"""),
]
