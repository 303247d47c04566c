"""Sources, sinks, the stored index and the streaming twins, over tables written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import activity_checks as A
from checks import index_checks as N
from checks.base import Check, table, texts
from docketry.functions import dates as D
from docketry.operators import corpus as K
from docketry.plans.tables import stored
from docketry.session import checkpoint_dir
from docketry.sources import cases as S
from docketry.sources import index_store as P
from docketry.sources import ops as O
from docketry.sources import request_log as Q
from docketry.streaming import limiter as L
from docketry.streaming import traffic as T


def shared(spark, name):
    """A new path in the shared folder."""
    base = spark.sparkContext.getCheckpointDir() or checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drained(stream, mode="append"):
    """Run a stream over what is there now; its rows, or with ``complete`` those of its last batch."""
    spark = stream.sparkSession
    out, state = shared(spark, "stream-out"), shared(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def import_ids(spark, sf_dir):
    """Documents as judgment records in sixteen partitions: ids are dense whatever the partitions."""
    d = texts(spark, sf_dir).repartition(16)
    records = d.select(
        "doc_id", F.concat(F.lit(" Case "), "doc_id").alias("case_title"), F.lit("").alias("judges_name_s"),
        F.lit("").alias("issues"), F.col("text").alias("decision"), F.lit(None).cast("string").alias("cited_cases"),
        F.lit("c").alias("citation"), F.lit("").alias("date_of_judgment"))
    return S.import_records(records, "doc_id").select("case_id", "ord", "title", F.md5("full_text").alias("body"))


def raw_cases(spark, sf_dir):
    """Documents as raw cases whose bodies hold quotes, commas and line breaks."""
    from docketry.schemas import RAW_CASE_FIELDS

    body = F.concat(F.lit('a "quoted", b\n'), "text", F.lit(',"z"'))
    given = {"case_id": F.col("doc_id").cast("string"), "title": F.concat(F.lit('T, "'), "source", F.lit('"')), "full_text": body,
             "court": F.col("source"), "citation": F.lit("c")}
    return texts(spark, sf_dir).select(*[given.get(c, F.lit("x")).alias(c) for c in RAW_CASE_FIELDS])


def told(cases):
    return cases.select("case_id", "title", "court", F.md5("full_text").alias("body"))


def cases_csv(spark, sf_dir):
    path = shared(spark, "cases-csv")
    S.write_cases(raw_cases(spark, sf_dir), path, "csv")
    return told(S.read_cases_csv(spark, path))


def cases_json(spark, sf_dir):
    path = shared(spark, "cases-json")
    S.write_cases(raw_cases(spark, sf_dir), path, "json")
    return told(S.read_cases_json(spark, path, lines=True))


def csv_headers(spark, sf_dir):
    """A header with blanks, capitals and signs; a row of blanks is dropped."""
    path = shared(spark, "headers-csv")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias(" Case No. "), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("Name (full)"))
    c.union(spark.createDataFrame([(None, "   ")], c.schema)).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_cases_csv(spark, path, multi_line=False).select(F.col("case_no").cast("bigint").alias("case_no"), "name_full")


def index_reload(spark, sf_dir):
    path = shared(spark, "index")
    P.save_index(N.chunks(spark, sf_dir), path)
    chunks, df, stats = P.load_index(spark, path)
    return chunks.select(
        "id", "case_id", stats.select("n_chunks").scalar().alias("n_chunks"), F.size("tokens").alias("n_tokens"),
        F.size("token_freq").alias("n_counted"), "length", F.round("norm", 4).alias("norm"))


def case_lookup(spark, sf_dir):
    return K.get_case(A.order_cases(spark, sf_dir), "7").select("id", "similarity")


def log_lines(spark, sf_dir):
    """The request log as JSON lines, in as many files as there are partitions, with a line that is no record."""
    path = shared(spark, "request-log")
    r = A.request_log(spark, sf_dir).select(
        "ts", F.col("id").cast("string").alias("requestId"), "method", "path", "status", F.col("duration_ms").alias("durationMs"),
        F.col("client").cast("string").alias("client"))
    lines = r.select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(spark.createDataFrame([("not a record",)], "value string")).write.text(path)
    return path


def request_log_read(spark, sf_dir):
    return Q.read_request_log(spark, log_lines(spark, sf_dir)).select(
        F.col("request_id").cast("bigint").alias("id"), "ts", "method", "path", "status", F.col("duration_ms").alias("value"), "client")


def metrics_stream(spark, sf_dir):
    log = Q.read_request_log(spark, log_lines(spark, sf_dir), stream=True)
    rows = drained(T.metrics_stream(log, "1 day"), "complete")
    return rows.select("window_start", "method", "status_class", "path_key", "requests", F.round("avg_ms", 7).alias("avg_ms"))


def activity_ingest_stream(spark, sf_dir):
    """Every notice twice: each id comes out once."""
    path = shared(spark, "notices")
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "search").when(F.col("event_type") == "signup", "upload").when(
        F.col("event_type") == "error", "other").otherwise("view")
    notice = e.select(F.col("event_id").cast("string").alias("id"), kind.alias("kind"), "ts", F.create_map(
        F.lit("query"), F.col("event_type"), F.lit("results"), (F.col("event_id") % 8).cast("string")).alias("payload"))
    notice.union(notice).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    rows = drained(T.activity_stream(Q.read_activity(spark, path, stream=True)))
    return rows.select(F.col("id").cast("bigint").alias("id"), "type", "title", "results")


def rate_limit_stream(spark, sf_dir):
    for key, value in L.STATE_STORE.items():
        spark.conf.set(key, value)
    log = stored(A.request_log(spark, sf_dir).select("client", "id", F.col("ts").cast("timestamp").alias("ts")), "limits")
    path = log.inputFiles()[0].rsplit("/", 1)[0]
    live = spark.readStream.schema(log.schema).parquet(path)
    rows = drained(L.rate_limit_stream(live, 2, 6 * 3_600_000))
    return rows.select(F.col("client").cast("bigint").alias("client"), "id", "allowed", "retry_after_ms")


def live_log(spark, sf_dir):
    """The requests as a stream of parquet files."""
    for key, value in L.STATE_STORE.items():
        spark.conf.set(key, value)
    path = shared(spark, "requests")
    log = A.request_log(spark, sf_dir).select("client", "id", F.col("ts").cast("timestamp").alias("ts"))
    log.write.parquet(path)
    return spark.readStream.schema(log.schema).parquet(path)


def rate_limit_stream_expiring(spark, sf_dir):
    rows = drained(L.rate_limit_stream_expiring(live_log(spark, sf_dir), 2, 6 * 3_600_000))
    return rows.select(F.col("client").cast("bigint").alias("client"), "id", "allowed", "retry_after_ms")


def slot_guard_stream(spark, sf_dir):
    """Hearings of one day a year, asked for a month ahead."""
    for key, value in L.STATE_STORE.items():
        spark.conf.set(key, value)
    path = shared(spark, "requests")
    h = A.hearings(spark, sf_dir).select(
        F.col("judge_id").cast("string").alias("judge_id"), F.trunc("hearing_date", "year").alias("hearing_date"), "slot", "id",
        F.col("case_id").cast("string").alias("case_id"), "seq").withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.col("hearing_date").cast("timestamp")) - 30 * 86_400))
    h.write.parquet(path)
    rows = drained(L.schedule_stream_expiring(spark.readStream.schema(h.schema).parquet(path)))
    return rows.select("id", "accepted", "incumbent_case")


def metrics_stream_late(spark, sf_dir):
    """A tenth of the events arrives in a second run; those behind the watermark of the first are counted."""
    path, state, out = shared(spark, "arrivals"), shared(spark, "stream-state"), shared(spark, "late")
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in (F.col("event_id") % 10 != 3, F.col("event_id") % 10 == 3):
        e.where(part).write.mode("append").parquet(path)
        spark.readStream.schema(e.schema).parquet(path).writeStream.foreachBatch(T.late_sink(out, "1 day")).option(
            "checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/late").drop("version")


def metrics_stream_sliding(spark, sf_dir):
    log = Q.read_request_log(spark, log_lines(spark, sf_dir), stream=True)
    rows = drained(T.metrics_stream(log, "1 day", "12 hours"), "complete")
    return rows.select("window_start", "method", "status_class", "path_key", "requests", F.round("avg_ms", 7).alias("avg_ms"))


def metrics_stream_session(spark, sf_dir):
    log = Q.read_request_log(spark, log_lines(spark, sf_dir), stream=True)
    rows = drained(T.metrics_stream(log, session_gap="3 hours"), "complete")
    return rows.select("window_start", "window_end", "method", "status_class", "path_key", "requests", "max_ms")


def rule_table(spark, sf_dir):
    """Nations as rules, written as JSON lines and read as a rule table."""
    path = shared(spark, "rules")
    n = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("ord"), F.array(F.lower("n_name")).alias("terms"),
        F.array(F.concat(F.lit("R "), "n_regionkey")).alias("sections"), F.lit("Civil").alias("domain"),
        F.lit("High").alias("severity"), (F.col("n_nationkey") % 2 == 0).alias("public_risk"))
    n.write.json(path)
    return O.read_rules(spark, path).select("ord", F.array_join("terms", "|").alias("terms"), F.array_join("sections", "|").alias("sections"), "public_risk")


def decision_dates(spark, sf_dir):
    """Order dates written in twelve ways."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    ways = ["yyyy/MM/dd", "MMMM d yyyy", "MMM d, yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d MMMM, yyyy", "EEEE, MMMM d, yyyy", "d-MMM-yyyy",
            "M/d/yyyy", "M-d-yyyy", "yyyy-M-d", "EEE d MMM yyyy"]
    k = F.col("o_orderkey") % (len(ways) + 1)
    shown = F.lit("  undated ")
    for i, way in enumerate(ways):
        shown = F.when(k == i, F.date_format("d", way)).otherwise(shown)
    return o.select("o_orderkey", D.decision_date(shown).alias("decided"))


def seed_ignore(spark, sf_dir):
    seed = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("status"), F.col("s_acctbal").alias("score"))
    return O.apply_seed(A.customers(spark, sf_dir), seed)


RAW = """SELECT doc_id::VARCHAR AS case_id, 'T, "' || source || '"' AS title, source AS court,
  md5('a "quoted", b' || chr(10) || text || ',"z"') AS body FROM documents"""

CHECKS = [
    Check("import_ids", import_ids, f"""
SELECT 'IN-SC-' || lpad(n::VARCHAR, 6, '0') AS case_id, n - 1 AS ord, 'Case ' || doc_id AS title, md5({N.sq('text')}) AS body
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents)"""),
    Check("cases_csv", cases_csv, RAW),
    Check("cases_json", cases_json, RAW),
    Check("csv_headers", csv_headers, "SELECT c_custkey AS case_no, c_name AS name_full FROM customer"),
    Check("index_reload", index_reload, f"""
WITH {N.CHUNKS}, kept AS (SELECT * FROM chunks WHERE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 80
  AND NOT regexp_matches(lower(text), 'case title extracted|cited-cases metadata|https?://')),
{N.hashed("(SELECT id, title || ' ' || text AS body FROM chunks)", "id", "body", 0.45, "cv")}
SELECT id, doc_id::VARCHAR AS case_id, count(*) OVER () AS n_chunks, coalesce(n_tokens, 0)::INT AS n_tokens, coalesce(n_tokens, 0)::INT AS n_counted,
  coalesce(length, 0)::INT AS length, round(coalesce(norm, 0), 4) AS norm FROM kept LEFT JOIN lengths USING (id) LEFT JOIN cv_norm ON key = id"""),
    Check("case_lookup", case_lookup,
          "SELECT o_orderkey::VARCHAR AS id, (floor(o_totalprice) % 54 + 45)::INT AS similarity FROM orders WHERE o_orderkey = 7"),
    Check("request_log_read", request_log_read, """
SELECT event_id AS id, date_trunc('millisecond', ts) AS ts, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
  '/api/' || event_type || '/' || user_id || '/x' || (event_id % 7) AS path, (200 + event_id % 4 * 100)::INT AS status, value,
  user_id::VARCHAR AS client FROM events"""),
    Check("metrics_stream", metrics_stream, f"""
WITH {A.LOG} SELECT ts::DATE::TIMESTAMP AS window_start, method, status_class, path AS path_key, count(*) AS requests,
  round(avg(value), 7) AS avg_ms FROM log GROUP BY ALL"""),
    Check("activity_ingest_stream", activity_ingest_stream, """
SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') THEN 'search' WHEN event_type = 'signup' THEN 'upload' ELSE 'view' END AS type,
  CASE WHEN event_type IN ('click', 'view') THEN event_type WHEN event_type = 'signup' THEN 'Uploaded Document' ELSE 'Case View' END AS title,
  CASE WHEN event_type IN ('click', 'view') THEN (event_id % 8)::INT WHEN event_type = 'signup' THEN 0 END AS results
FROM events WHERE event_type <> 'error'"""),
    Check("rate_limit_stream", rate_limit_stream, A.limiter("user_id", 2, 6 * 3_600_000)),
    Check("rate_limit_stream_expiring", rate_limit_stream_expiring, A.limiter("user_id", 2, 6 * 3_600_000)),
    Check("slot_guard_stream", slot_guard_stream, f"""
WITH {A.HEARINGS}, y AS (SELECT *, first_value(id) OVER w AS first_id, first_value(case_id) OVER w AS first_case FROM hearings
  WINDOW w AS (PARTITION BY judge_id, date_trunc('year', hearing_date), slot ORDER BY seq, id))
SELECT id, id = first_id AS accepted, CASE WHEN id <> first_id THEN first_case::VARCHAR END AS incumbent_case FROM y"""),
    Check("metrics_stream_late", metrics_stream_late, """
WITH newest AS (SELECT max(ts) AS t FROM events WHERE event_id % 10 <> 3)
SELECT ts::DATE::TIMESTAMP AS window_start, count(*) AS late FROM events, newest
WHERE event_id % 10 = 3 AND ts < t - INTERVAL 10 MINUTE GROUP BY ALL"""),
    Check("metrics_stream_sliding", metrics_stream_sliding, f"""
WITH {A.LOG}, w AS (SELECT *, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM log),
each AS (SELECT *, unnest([s, s - INTERVAL 12 HOUR]) AS window_start FROM w)
SELECT window_start, method, status_class, path AS path_key, count(*) AS requests, round(avg(value), 7) AS avg_ms FROM each GROUP BY ALL"""),
    Check("metrics_stream_session", metrics_stream_session, f"""
WITH {A.LOG}, m AS (SELECT *, date_trunc('millisecond', ts) AS shown FROM log),
g AS (SELECT *, lag(shown) OVER (PARTITION BY method, status_class, path ORDER BY shown) AS before FROM m),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR shown > before + INTERVAL 3 HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY method, status_class, path ORDER BY shown ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT min(shown) AS window_start, max(shown) + INTERVAL 3 HOUR AS window_end, method, status_class, path AS path_key, count(*) AS requests,
  max(value) AS max_ms FROM n GROUP BY method, status_class, path, no"""),
    Check("rule_table", rule_table, """
SELECT n_nationkey::INT AS ord, lower(n_name) AS terms, 'R ' || n_regionkey AS sections, n_nationkey % 2 = 0 AS public_risk FROM nation"""),
    Check("decision_dates", decision_dates, """
SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 11 THEN 'undated' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS decided FROM orders"""),
    Check("seed_ignore", seed_ignore, """
SELECT c_custkey AS id, c_mktsegment AS status, c_acctbal AS score FROM customer UNION ALL
SELECT s_suppkey * 20, s_name, s_acctbal FROM supplier WHERE s_suppkey * 20 NOT IN (SELECT c_custkey FROM customer)"""),
]
