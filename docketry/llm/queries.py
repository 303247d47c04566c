"""One query per operator over the whole given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import (
    conversations, fingerprints, language, near_dedup, packing, pieces, pii, quality, quality_rules, suffix_dedup, url_filter, vptree,
    whitening)
from docketry.session import ship

# Rows of text that Spark hands to a Python worker at once: bounds its memory for long texts.
TEXT_ROWS = 1000
BATCH_BYTES = "16m"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = fingerprints.near_classes(docs).withColumnRenamed("id", "doc_id")
    edited = fingerprints.edit_next(docs, raw=True).withColumnRenamed("id", "doc_id")
    # A text without words is a class of its own.
    return fingerprints.hexed(edited.join(classes, "doc_id", "left")).withColumns({
        "class_id": F.coalesce("class_id", "doc_id"), "n_links": F.coalesce("n_links", F.lit(0))})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of a document: its source, language and size class, and the sites of all pages that show it."""
    ready(spark)
    page = table(spark, sf_dir, "pages").select(_page_document().alias("shown"), "url").where("shown is not null")
    labels = url_filter.host_of(F.col("url"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", "lang", F.log2(F.col("n_chars") + 1).cast("int").alias("size"))
    # Only the narrow site columns are joined, after the texts have become numbers.
    site = page.select("shown", F.substring_index(labels, ".", -2).alias("domain"), F.substring_index(labels, ".", 1).alias("head"))
    good = table(spark, sf_dir, "labels").select("doc_id", F.col("quality") == 1)
    found = quality.co_train(docs, good, ["source", "lang", "size"], pages=site)
    return found.withColumnRenamed("id", "doc_id").withColumn("good", F.col("score") >= 0.5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed_documents(docs, tokenizer("byte_bpe_50k.json"), digest=True).withColumnRenamed("id", "doc_id")


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
             ("allow", "org", "/fr/")]


def _page_document():
    """The document that a page shows: the number at the end of its path."""
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    return number.try_cast("bigint")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number ends its path: that document's label is the page's."""
    ready(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    known = pages.select("url", _page_document().alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return url_filter.judge(pages, url_filter.mine(known), URL_RULES).withColumnRenamed("id", "page_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with a passage of 50 words or more that another document has too."""
    ready(spark)
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def told(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.start, s.end)), ",")

    def length(spans: str):
        return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s.end - s.start)

    return found.select(
        F.col("id").alias("doc_id"), F.col("twin").alias("twin_doc_id"), F.size("spans").alias("n_spans"),
        length("spans").alias("n_words"), length("cuts").alias("n_cut_words"), told("spans").alias("spans"),
        told("cuts").alias("cuts"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as a digest, and whether decoding them gives the text back."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    model = tokenizer("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(docs, model), model)
    return pieces.digests(both).select(
        "doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate("text", pieces.BLANK, " ")).alias("exact"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, kind)) for kind in pii.KINDS]
    counts = [(F.size("base") - rest).cast("bigint").alias(f"n_{kind}") for kind, rest in zip(pii.KINDS, counts, strict=True)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"),
                        pii.told(F.col("spans")).alias("spans"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~out).select("lang", "text", "doc_id"))
    return language.predict(docs.select("doc_id", "text", out.alias("held_out")), model).drop("text")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    found = near_dedup.near_components(
        table(spark, sf_dir, "documents").select("doc_id", "text"), near_dedup.NearDedup(shingle=4))
    return found.withColumnRenamed("id", "doc_id")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))
    return found.withColumnRenamed("id", "vec_id")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows as given but for one in twenty each that goes, is emptied, loses its sentence ends, comes twice or is a user's."""
    blank = F.lit(" ")
    told = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    case = F.crc32(key) % 20
    told = told.withColumn("case", case).withColumns({
        "text": F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("case") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1)
    return told.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    turns = table(spark, sf_dir, "conversations")
    return conversations.audit(damaged(turns), also=turns.select("conv_id").distinct())


def _conversation_repair_sql() -> str:
    return rf"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
        cased AS (
            SELECT *, xor(list_reduce([4294967295::ubigint] || list_transform(string_split(key, ''), lambda c: ascii(c)::ubigint),
                lambda crc, byte: list_reduce([xor(crc, byte)] || [0::ubigint, 0, 0, 0, 0, 0, 0, 0],
                    lambda v, _: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::ubigint) ELSE v >> 1 END)),
                4294967295::ubigint) % 20 AS case_no FROM given),
        rows AS (
            SELECT conv_id, turn, CASE WHEN case_no = 4 THEN 'user' ELSE role END AS role,
                CASE case_no WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(CASE case_no WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM cased),
        placed AS (
            SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before_role
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy)),
        judged AS (
            SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^ 	-
]') AS blank,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
                NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
                before_role IS NOT NULL AND before_role || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
            FROM placed),
        told AS (
            SELECT conv_id, i, role, text, r, blank, seen AND NOT blank AS duplicate, cut AND NOT blank AND NOT seen AS truncated,
                illegal, turn FROM judged),
        totals AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
                count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(i) AS n
            FROM told GROUP BY conv_id),
        moves(state, r, edit, next_state, price, inserted) AS (
            VALUES (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''),
                (3, 'u', 'K', 2, 0, ''), (0, NULL, 'R', 2, 1, ''), (1, NULL, 'R', 2, 1, ''), (2, NULL, 'R', 3, 1, ''),
                (3, NULL, 'R', 2, 1, ''), (0, 'a', 'IK', 3, 5, 'user:'), (1, 'a', 'IK', 3, 5, 'user:'),
                (2, 'u', 'IK', 2, 5, 'assistant:'), (3, 'a', 'IK', 3, 5, 'user:'), (0, NULL, 'IR', 3, 6, 'user:'),
                (1, NULL, 'IR', 3, 6, 'user:'), (2, NULL, 'IR', 2, 6, 'assistant:'), (3, NULL, 'IR', 3, 6, 'user:')),
        paths AS (
            SELECT conv_id, n, 0::bigint AS i, 0 AS state, 0 AS cost, '' AS audit, []::varchar[] AS out FROM totals
            UNION ALL
            SELECT conv_id, n, i, state, cost, audit, out FROM (
                SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
                    SELECT p.conv_id, p.n, p.i + 1 AS i, coalesce(m.next_state, p.state) AS state,
                        p.cost + CASE WHEN m.edit IS NULL THEN 2 ELSE m.price + CASE WHEN t.truncated THEN 5 ELSE 0 END END AS cost,
                        p.audit || coalesce(m.edit, 'D') AS audit,
                        CASE WHEN m.edit IS NULL THEN p.out ELSE p.out || CASE WHEN m.inserted = '' THEN []::varchar[]
                            ELSE [m.inserted] END || [CASE WHEN m.edit LIKE '%K' THEN t.role WHEN m.next_state = 2 THEN 'user'
                            ELSE 'assistant' END || ':' || t.text] END AS out
                    FROM paths AS p JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1
                    JOIN (SELECT * FROM moves UNION ALL SELECT s, NULL, NULL, NULL, NULL, NULL FROM range(4) AS g(s)) AS m
                        ON m.state = p.state AND (m.edit IS NULL OR NOT t.blank AND NOT t.duplicate AND (m.r IS NULL OR m.r = t.r))))
            WHERE best = 1),
        ended AS (
            SELECT conv_id, cost + [0, 10, 5, 0][state + 1] AS cost, audit || ['', 'II', 'I', ''][state + 1] AS audit,
                out || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END AS out
            FROM paths WHERE i = n),
        chosen AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS best FROM ended),
        result AS (
            SELECT t.*, c.cost, c.audit, sha256(array_to_string(c.out, chr(10))) AS repaired_sha256
            FROM totals AS t JOIN chosen AS c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.best = 1),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::bigint AS cost,
            coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM ids LEFT JOIN result ON result.conv_id IS NOT DISTINCT FROM ids.conv_id"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usable vector and component."""
    ready(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    shares = F.array(*[F.lit(float(share)) for share in model.explained]).cast("array<double>")
    told = whitening.transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return told.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.withColumn("failed", F.array_join("failed", ","))


def _quality_rules_sql() -> str:
    rules = [*quality_rules.BASE, *quality_rules.RULES]
    stop_words = ", ".join("'" + word + "'" for word in quality_rules._stop_words())
    bullets = ", ".join("'" + sign + "'" for sign in quality_rules.BULLETS)
    failed = ", ".join(f"CASE WHEN NOT ({rule.sql()}) THEN '{rule.name}' END" for rule in rules)
    base = " OR ".join(f"NOT ({rule.sql()})" for rule in quality_rules.BASE)
    return rf"""
        WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
        parts AS (
            SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS words,
                list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^ 	-
]')) AS lines
            FROM texts),
        windows AS (
            SELECT k, unnest(range(1, len(words) - 3)) AS p, unnest(list_transform(
                range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' '))) AS w
            FROM parts),
        twice AS (SELECT k, p, count(*) OVER (PARTITION BY k, w) AS n FROM windows),
        steps AS (SELECT k, lead(p) OVER (PARTITION BY k ORDER BY p) - p AS step FROM twice WHERE n > 1),
        repeats AS (SELECT k, sum(least(5, coalesce(step, 5)))::bigint AS n FROM steps GROUP BY k),
        measured AS (
            SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[ 	-
]', '', 'g')) AS word_chars,
                len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '!')) AS n_loud,
                len(list_filter(words, lambda word: word IN ({stop_words}))) AS n_stop_words,
                len(regexp_extract_all(text, '\p{{L}}+')) AS n_letter_runs, len(lines) AS n_lines,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                len(list_filter(lines, lambda line: substring(ltrim(line), 1, 1) IN ({bullets}))) AS n_bullet_lines,
                len(list_filter(lines, lambda line: rtrim(line) LIKE '%...' OR rtrim(line) LIKE '%…')) AS n_ellipsis_lines,
                coalesce(repeats.n, 0) AS n_repeat_words
            FROM parts LEFT JOIN repeats USING (k))
        SELECT *, {base} AS base_failed, array_to_string(list_filter([{failed}], lambda name: name IS NOT NULL), ',') AS failed,
            failed = '' AS kept
        FROM measured"""


QUERIES = [
    Query("op11_conversation_repair", op11_conversation_repair, _conversation_repair_sql()),
    Query("op12_whitening", op12_whitening),
    Query("op13_quality_rules", op13_quality_rules, _quality_rules_sql()),
    Query("op2_quality", op2_quality),
    Query("op3_packing", op3_packing),
    Query("op1_fingerprints", op1_fingerprints),
    Query("op4_url_filter", op4_url_filter),
    Query("op5_suffix_dedup", op5_suffix_dedup),
    Query("op6_pieces", op6_pieces),
    Query("op7_pii", op7_pii),
    Query("op8_language", op8_language),
    Query("op9_near_dedup", op9_near_dedup),
    Query("op10_nearest", op10_nearest),
]
