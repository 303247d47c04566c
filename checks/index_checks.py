"""Tokens, chunks, frequencies, BM25, hashed vectors and retrieval over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Check, fill, first_case, in_list, sq, table, texts, trim_ws
from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators import bm25 as M
from docketry.operators import chunks as C
from docketry.operators import pruned as N
from docketry.operators import retrieve as R
from docketry.plans.tables import folder, stored
from docketry.sources.index_store import load_blocks, load_index, save_index

STOP = L.STOP_WORDS
# Words that occur in the documents stand in for the domain's prose markers and terms.
PROSE = "the|and|that|with|der|die|und|que|les|des|del|los"
RULES = C.ChunkRules(prose=PROSE)
QUERY_RULES = R.QueryRules(
    domain_terms=("der", "die", "que", "des", "und", "elle", "ment", "tion", "thon", "thes"),
    synonyms={"der": ["von", "den"], "elle": ["eau"], "thon": ["ther", "thth"], "tion": ["ment"]},
)
SQL_SYNONYMS = "VALUES ('der','von'), ('der','den'), ('elle','eau'), ('thon','ther'), ('thon','thth'), ('tion','ment')"


def sections(spark, sf_dir):
    d = texts(spark, sf_dir)
    return d.select(
        F.col("doc_id").cast("string").alias("case_id"), F.col("doc_id").alias("ord"),
        F.concat(F.lit("Case "), F.col("source"), F.lit(" "), F.substring_index(X.squash("text"), " ", 1)).alias("title"),
        F.lit(1).alias("no"), F.lit("Judgment").alias("section"), F.col("text").alias("body"),
        F.col("source").alias("court"), F.lit(2024).alias("year"), F.col("lang").alias("type"),
        F.lit("").alias("final_verdict"),
    )


KEEP = ["court", "year", "type", "final_verdict"]


def chunks(spark, sf_dir):
    return C.with_features(C.chunk_rows(sections(spark, sf_dir), KEEP, RULES), RULES)


def query_rows(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def doc_tokens(spark, sf_dir):
    t = X.tokens("text", STOP)
    return texts(spark, sf_dir).select(
        "doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens")
    )


def doc_token_freq(spark, sf_dir):
    freq = X.frequencies(X.without(X.words("text"), STOP))
    return X.exploded(texts(spark, sf_dir), freq, ["token", "tf"], ["doc_id"])


def doc_windows(spark, sf_dir):
    return X.exploded(texts(spark, sf_dir), C.windows_of("text"), ["pos", "text"], ["doc_id"], positions=True)


def chunk_table(spark, sf_dir):
    return chunks(spark, sf_dir).select(
        "id", "case_id", "ord", "text", F.size("tokens").alias("n_tokens"), "length", F.round("norm", 4).alias("norm")
    )


def chunk_clean(spark, sf_dir):
    c = C.chunk_rows(sections(spark, sf_dir), KEEP, RULES)
    return c.select("id", C.clean_chunk("text", PROSE).alias("clean_text"))


def token_df(spark, sf_dir):
    return C.token_df(chunks(spark, sf_dir))


def index_stats(spark, sf_dir):
    return C.index_stats(chunks(spark, sf_dir)).withColumn("avg_chunk_length", F.round("avg_chunk_length", 4))


def saved_chunks(spark, sf_dir):
    return C.saved_filter(C.chunk_rows(sections(spark, sf_dir), KEEP, RULES)).select("id", "case_id")


def index(spark, sf_dir, columns=(*[c for c in R.CARRY if c != "terms"], "token_freq", "length", "sparse")):
    """Index tables with the columns the query reads."""
    built = stored(chunks(spark, sf_dir).select(*columns), "chunks")
    return built, C.token_df(built), C.index_stats(built)


def bm25_top5(spark, sf_dir):
    built, df, stats = index(spark, sf_dir, ("id", "ord", "length", "token_freq"))
    q = X.exploded(query_rows(spark, sf_dir), X.tokens("text", STOP), ["token"], ["query_id"])
    return M.best_chunks(q, built, df, stats, 5).select("query_id", "rank", "id", F.round("score", 4).alias("bm25"))


def bm25_pairs(spark, sf_dir):
    """Every pair by joins, and the rank limit after it."""
    built, df, stats = index(spark, sf_dir, ("id", "ord", "length", "token_freq"))
    q = X.exploded(query_rows(spark, sf_dir), X.tokens("text", STOP), ["token"], ["query_id"])
    return M.top_chunks(M.bm25(q, built, df, stats), built, 5).select(
        "query_id", "rank", "id", F.round("bm25", 4).alias("bm25")
    )


def stored_index(spark, sf_dir):
    """The index as it is saved and loaded, with block summaries."""
    path = folder(spark, "index")
    save_index(chunks(spark, sf_dir), path, filtered=False, blocks=True)
    return *load_index(spark, path), load_blocks(spark, path)


def bm25_pruned(spark, sf_dir):
    built, df, stats, blocks = stored_index(spark, sf_dir)
    q = X.exploded(query_rows(spark, sf_dir), X.tokens("text", STOP), ["token"], ["query_id"])
    return N.bm25_top(q, built, df, stats, blocks, 5).hits.select("query_id", "rank", "id", F.round("score", 4).alias("bm25"))


def retrieval_pool_pruned(spark, sf_dir):
    built, df, stats, blocks = stored_index(spark, sf_dir)
    found = N.candidate_pool(query_rows(spark, sf_dir), built, df, stats, blocks, QUERY_RULES)
    return found.hits.select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def hashed_vectors(spark, sf_dir):
    t = X.tokens("text", STOP)
    parts = X.exploded(
        texts(spark, sf_dir),
        F.concat(
            F.transform(H.buckets(t, H.SEED_A), lambda b: F.struct(b.alias("bucket"), F.lit(1.0).alias("w"))),
            F.transform(H.buckets(t, H.SEED_B), lambda b: F.struct(b.alias("bucket"), F.lit(0.45).alias("w"))),
        ),
        ["e"], ["doc_id"],
    )
    return parts.groupBy("doc_id", F.col("e.bucket").cast("int").alias("bucket")).agg(
        F.round(F.sum("e.w"), 4).alias("weight")
    )


def hash_buckets(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", H.bucket_of("text", 11).alias("bucket"))


def embedding_cosine(spark, sf_dir):
    """Cosine of every dense vector with the mean vector of its label."""
    e = table(spark, sf_dir, "embeddings")
    means = (
        e.select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at").agg(F.avg("x").alias("x"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))
    )
    return e.join(F.broadcast(means), "label").select(
        "vec_id", "label", F.round(H.cosine(F.col("embedding"), F.col("mean")), 4).alias("cosine")
    )


def gated_queries(spark, sf_dir):
    f = R.query_features(query_rows(spark, sf_dir), QUERY_RULES)
    return f.select(
        "query_id", F.size("tokens").alias("n_tokens"), F.size("expanded").alias("n_expanded"),
        F.size("phrases").alias("n_phrases"), F.array_join(F.sort_array("expanded"), " ").alias("expanded"),
    )


def pool_of(spark, sf_dir):
    built, df, stats = index(spark, sf_dir)
    return R.candidate_pool(query_rows(spark, sf_dir), built, df, stats, QUERY_RULES)


def retrieval_pool(spark, sf_dir):
    return pool_of(spark, sf_dir).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


def retrieval_candidates(spark, sf_dir):
    return R.cap_per_case(pool_of(spark, sf_dir)).select("query_id", "pos", "id", "case_id")


def retrieval_sources(spark, sf_dir):
    built, df, stats = index(spark, sf_dir)
    r = R.retrieve(query_rows(spark, sf_dir), built, df, stats, QUERY_RULES, diversity=False)
    return r.sources.select("query_id", "source_no", "case_id", "clean_title", "score")


def retrieval_confidence(spark, sf_dir):
    built, df, stats = index(spark, sf_dir)
    r = R.retrieve(query_rows(spark, sf_dir), built, df, stats, QUERY_RULES, diversity=False)
    return r.confidence


def retrieval_reranked(spark, sf_dir):
    built, df, stats = index(spark, sf_dir)
    r = R.retrieve(query_rows(spark, sf_dir), built, df, stats, QUERY_RULES)
    return r.hits.select("query_id", "pos", "id", F.round("score", 4).alias("score"))


def asked(spark, sf_dir):
    """The queries, a blank one and one that no domain term occurs in."""
    more = spark.createDataFrame([(-1, "  \n"), (-2, "zzzz qqqq"), (-3, None)], "query_id BIGINT, text STRING")
    return query_rows(spark, sf_dir).select(F.col("query_id").cast("bigint").alias("query_id"), "text").unionByName(more)


def retrieval_answers(spark, sf_dir):
    """The shipped pipeline, re-rank included: one row per query."""
    built, df, stats = index(spark, sf_dir)
    return R.retrieve(asked(spark, sf_dir), built, df, stats, QUERY_RULES).answers


def retrieval_outcomes(spark, sf_dir):
    built, df, stats = index(spark, sf_dir)
    return R.outcome_class(R.retrieve(query_rows(spark, sf_dir), built, df, stats, QUERY_RULES, diversity=False).hits)


# ---- SQL -----------------------------------------------------------------------
TEXT = sq("text")
DOC_WORDS = fill(
    r"""
doc_words AS (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM documents)
), kept AS (SELECT * FROM doc_words WHERE token NOT IN (<<stop>>))""",
    stop=in_list(STOP),
)

WINDOWS = fill(
    r"""
split AS (SELECT doc_id, source, text AS full_text, string_split(<<text>>, ' ') AS w FROM documents),
cut AS (
  SELECT doc_id, source, full_text, w,
    unnest(range(0, 1 + greatest(0, ceil((len(w) - 110) / 86.0)::INT))) AS k FROM split
), filled AS (
  SELECT doc_id, source, full_text, k, array_to_string(w[k * 86 + 1 : k * 86 + 110], ' ') AS text FROM cut
), windows AS (
  SELECT doc_id, 'Case ' || source || ' ' || split_part(<<full>>, ' ', 1) AS title,
    row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, text
  FROM filled WHERE length(text) >= 60
)""",
    text=TEXT, full=sq("full_text"),
)

CHUNKS = WINDOWS + fill(
    r""",
s0 AS (SELECT *, regexp_replace(<<text>>, '(?i)decision\s*:\s*\d+', '', 'g') AS t FROM windows),
s1 AS (SELECT * REPLACE (CASE WHEN length(t) - length(replace(t, ';', '')) >= 2 THEN
    array_to_string(list_filter(list_transform(string_split(t, ';'), lambda p: <<part>>),
      lambda p: length(p) > 40 AND regexp_matches(p, '(?i)\b(<<prose>>)\b')), '. ') ELSE t END AS t) FROM s0),
s2 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(?i)\bsection\s+\d+[a-z]?\s+(?:of\s+)?[\w\s]{0,30}(?:act|code|cpc|crpc)\s*[;,]?', '', 'g'),
    '(?i)\border\s+[ivxlcdm\d]+\s+rule\s+\d+', '', 'g'),
    '(?i)\bfilter\s*:\s*[\w\s]+', '', 'g'),
    '(?i)case title extracted from cited[- ]cases metadata:?[^.;]*', '', 'g'),
    '(?i)https?://\S+', '', 'g') AS t) FROM s1),
s3 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(?im)^(title|source|judges?|issues?|decision|citation)\s*:', '', 'g'),
    '(?i)section\s+\d+[a-z]?\s+in\s+the\s+[^;.]+[;.]', '', 'g'),
    '\{[^}]*\}', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '(?i)\(cid:[^)]+\)', ' ', 'g') AS t) FROM s2),
s4 AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(regexp_replace(t, '(?m)Judges:.*$', '', 'g'),
    '\s+', ' ', 'g'), ';+', ';', 'g')) AS t) FROM s3),
s5 AS (SELECT doc_id, title, pos, text, lower(<<text>>) AS raw,
    CASE WHEN length(t) < 60 THEN '' ELSE t END AS clean FROM s4),
chunks AS (
  SELECT 'rag-' || doc_id || '-judgment-' || (pos + 1) AS id, doc_id, title,
    (doc_id * 4194304 + 1048576 + pos)::BIGINT AS ord, text, clean
  FROM (SELECT *, lower(clean) AS c FROM s5)
  WHERE NOT (raw = '' OR length(raw) - length(replace(raw, ';', '')) >= 3
    OR regexp_matches(raw, 'decision\s*:\s*\d') OR len(regexp_extract_all(raw, '\bsection\b')) > 3
    OR c = '' OR contains(c, 'case title extracted') OR contains(c, 'cited-cases metadata')
    OR contains(c, 'extracted from cited') OR regexp_matches(c, '^(case title|title:|source:|judges:)|https?://')
    OR length(c) < 85 OR regexp_matches(c, '^decision:\s*\d+\s*cited cases:')
    OR len(list_filter(regexp_split_to_array(c, '\s+'), lambda w: regexp_matches(w, '[a-z]{3,}'))) < 12)
), chunk_words AS (
  SELECT id, ord, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT id, ord, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM chunks)
), tf AS (
  SELECT id, ord, token, count(*)::INT AS tf, min(pos) AS pos FROM chunk_words
  WHERE token NOT IN (<<stop>>) GROUP BY ALL
), lengths AS (SELECT id, sum(tf)::INT AS length, count(*)::INT AS n_tokens FROM tf GROUP BY id),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
stats AS (SELECT count(*) AS n_chunks, avg(coalesce(length, 0)) AS mean FROM chunks LEFT JOIN lengths USING (id))""",
    text=TEXT, part=trim_ws("p"), prose=PROSE, stop=in_list(STOP),
)


def hashed(source: str, key: str, text: str, weight: float, name: str = "vec") -> str:
    """CTEs ``<name>``: key, bucket, w of the distinct kept tokens of ``text``."""
    return fill(
        r"""
<<n>>_tok AS (
  SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY pos) AS nth
  FROM (SELECT key, token, min(pos) AS pos
        FROM (SELECT <<key>> AS key, unnest(w) AS token, unnest(range(len(w))) AS pos
              FROM (SELECT <<key>>, regexp_extract_all(lower(<<text>>), '[a-z0-9]{3,}') AS w FROM <<source>>))
        WHERE token NOT IN (<<stop>>) GROUP BY key, token)
), <<n>>_vocab AS (SELECT DISTINCT token FROM <<n>>_tok),
<<n>>_hash AS (
  SELECT token,
    list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 192 AS a,
    list_reduce(list_prepend(16777619::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 192 AS b
  FROM <<n>>_vocab
), <<n>> AS (
  SELECT key, bucket::INT AS bucket, sum(w) AS w FROM (
    SELECT key, a AS bucket, 1.0::DOUBLE AS w FROM <<n>>_tok JOIN <<n>>_hash USING (token)
    UNION ALL
    SELECT key, b, <<weight>>::DOUBLE FROM <<n>>_tok JOIN <<n>>_hash USING (token))
  GROUP BY ALL
), <<n>>_norm AS (SELECT key, sqrt(sum(w * w)) AS norm FROM <<n>> GROUP BY key)""",
        n=name, key=key, source=source, text=text, weight=str(weight), stop=in_list(STOP),
    )


QUERIES = fill(
    r"""
q_text AS (SELECT item_id AS query_id, <<text>> AS text FROM benchmark),
q_tok AS (
  SELECT query_id, token, min(pos) AS pos FROM (
    SELECT query_id, unnest(w) AS token, unnest(range(len(w))) AS pos
    FROM (SELECT query_id, regexp_extract_all(lower(text), '[a-z0-9]{3,}') AS w FROM q_text))
  WHERE token NOT IN (<<stop>>) GROUP BY ALL
), gated AS (
  SELECT query_id, lower(text) AS text FROM q_text WHERE text <> '' AND (
    regexp_matches(lower(text), '\b(vs\.?|versus|article\s+\d+|section\s+\d+|fir|ipc|crpc|writ|appeal|petition)\b')
    OR query_id IN (SELECT query_id FROM q_tok WHERE token IN (<<terms>>)))
), synonyms(token, extra) AS (<<synonyms>>),
q_exp AS (
  SELECT DISTINCT query_id, token FROM (
    SELECT query_id, token FROM q_tok UNION ALL
    SELECT query_id, extra FROM q_tok JOIN synonyms USING (token))
  WHERE query_id IN (SELECT query_id FROM gated)
), q_long AS (
  SELECT query_id, unnest(w) AS a, unnest(list_concat(w[2:], ['']))  AS b FROM (
    SELECT query_id, list_filter(regexp_extract_all(text, '[a-z0-9]{4,}'), lambda x: x NOT IN (<<stop>>)) AS w FROM gated)
), q_phr AS (SELECT query_id, a || ' ' || b AS phrase FROM q_long WHERE b <> ''),
q_n AS (
  SELECT query_id, (SELECT count(*) FROM q_tok t WHERE t.query_id = g.query_id)::INT AS n_tokens,
    (SELECT count(*) FROM q_exp t WHERE t.query_id = g.query_id)::INT AS n_expanded,
    (SELECT count(*) FROM q_phr t WHERE t.query_id = g.query_id)::INT AS n_phrases FROM gated g
)""",
    text=TEXT, stop=in_list(STOP), terms=in_list(QUERY_RULES.domain_terms), synonyms=SQL_SYNONYMS,
)

POOL = (
    CHUNKS + "," + QUERIES + ","
    + hashed("(SELECT id, title || ' ' || text AS body FROM chunks)", "id", "body", 0.45, "cv") + ","
    + hashed("gated", "query_id", "text", 0.45, "qv")
    + r""",
dots AS (
  SELECT q.key AS query_id, c.key AS id, sum(q.w * c.w) AS dot FROM qv q JOIN cv c USING (bucket) GROUP BY ALL
), cosine AS (
  SELECT query_id, id, CASE WHEN a.norm = 0 OR b.norm = 0 THEN 0 ELSE dot / (a.norm * b.norm) END AS cos
  FROM dots JOIN qv_norm a ON a.key = query_id JOIN cv_norm b ON b.key = id
), lexical AS (
  SELECT query_id, id, count(*) AS overlap,
    sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.4
        / (tf + 1.4 * (0.25 + 0.75 * greatest(1, length) / greatest(1, mean)))) AS bm25
  FROM q_exp JOIN tf USING (token) JOIN df USING (token) JOIN lengths USING (id), stats GROUP BY ALL
), exact AS (
  SELECT query_id, id, count(*) AS hits FROM q_tok JOIN tf USING (token)
  WHERE query_id IN (SELECT query_id FROM gated) GROUP BY ALL
), in_title AS (
  SELECT query_id, id, count(*) AS hits FROM q_tok JOIN chunks ON contains(lower(title), token)
  WHERE query_id IN (SELECT query_id FROM gated) GROUP BY ALL
), phrases AS (
  SELECT query_id, id, count(*) AS hits FROM q_phr JOIN chunks ON contains(lower(text), phrase) GROUP BY ALL
), scored AS (
  SELECT g.query_id, c.id, c.doc_id, c.ord, c.title, c.text,
    round(least(0.995, (1 - exp(-2.2 * (0.5 * coalesce(cos, 0) + 0.32 * coalesce(bm25, 0) / (coalesce(bm25, 0) + 6)
      + 0.1 * coalesce(overlap, 0) / greatest(1, n_expanded) + 0.03 * coalesce(i.hits, 0) / greatest(1, n_tokens)))
      + 0.22 * coalesce(e.hits, 0) / greatest(1, n_tokens)
      + least(0.14, 0.05 * least(coalesce(p.hits, 0), 3, n_phrases)))), 9) AS score
  FROM gated g JOIN chunks c ON true JOIN q_n n USING (query_id)
  LEFT JOIN cosine o ON o.query_id = g.query_id AND o.id = c.id
  LEFT JOIN lexical l ON l.query_id = g.query_id AND l.id = c.id
  LEFT JOIN exact e ON e.query_id = g.query_id AND e.id = c.id
  LEFT JOIN in_title i ON i.query_id = g.query_id AND i.id = c.id
  LEFT JOIN phrases p ON p.query_id = g.query_id AND p.id = c.id
), pool AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM scored
  WHERE score >= 0.22 QUALIFY rank <= 24
), capped AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth FROM pool QUALIFY nth <= 2
), candidates AS (
  SELECT * EXCLUDE (nth), row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM capped QUALIFY pos <= 12
), hits AS (
  SELECT * EXCLUDE (pos, any_above), row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM (
    SELECT *, max((score > 0.4)::INT) OVER (PARTITION BY query_id) AS any_above FROM candidates WHERE pos <= 4)
  WHERE any_above = 0 OR score > 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 3
), titled AS (
  SELECT *, trim(regexp_replace(regexp_replace(title, '[\s\x{A0}]+', ' ', 'g'), '[^a-zA-Z0-9. ]', '', 'g')) AS clean_title FROM hits
), by_title AS (
  SELECT *, min(pos) OVER (PARTITION BY query_id, clean_title) AS place FROM titled WHERE clean_title <> ''
  QUALIFY row_number() OVER (PARTITION BY query_id, clean_title ORDER BY pos DESC) = 1
), by_case AS (
  SELECT *, min(place) OVER (PARTITION BY query_id, doc_id) AS first_place FROM by_title
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, place) = 1
), sources AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_place)::INT AS source_no FROM by_case
  QUALIFY source_no <= 5
)"""
)

# The greedy re-rank as recursion: of the candidates left, the one with the best gain joins the list.
# It takes the place of the plain hits; titles and sources follow as before.
HEAD, REST = POOL.split("), hits AS (")
RERANKED = HEAD.replace("candidates AS (", "candidates AS MATERIALIZED (") + """), held AS MATERIALIZED (
  SELECT DISTINCT id, token FROM candidates JOIN tf USING (id)
), sizes AS (SELECT id, count(*) AS n FROM held GROUP BY id),
shared AS (
  SELECT a.query_id, a.pos, b.pos AS other, count(*) AS n FROM candidates a JOIN held x ON x.id = a.id
  JOIN held y USING (token) JOIN candidates b ON b.query_id = a.query_id AND b.id = y.id GROUP BY ALL
), near AS (
  SELECT a.query_id, a.pos, list(CASE WHEN s.n IS NULL THEN 0.0::DOUBLE ELSE s.n / (na.n + nb.n - s.n) END ORDER BY b.pos) AS sims
  FROM candidates a JOIN candidates b USING (query_id) LEFT JOIN sizes na ON na.id = a.id LEFT JOIN sizes nb ON nb.id = b.id
  LEFT JOIN shared s ON s.query_id = a.query_id AND s.pos = a.pos AND s.other = b.pos GROUP BY ALL
), choice AS MATERIALIZED (SELECT query_id, pos, score, sims FROM candidates JOIN near USING (query_id, pos)),
walk AS (
  SELECT DISTINCT query_id, []::BIGINT[] AS chosen FROM choice UNION ALL
  SELECT query_id, list_append(any_value(chosen), list_sort(list({'g': -gain, 'p': pos}))[1].p) FROM (
    SELECT w.query_id, chosen, c.pos,
      0.78::DOUBLE * score - (1::DOUBLE - 0.78::DOUBLE) * coalesce(list_max(list_transform(chosen, lambda p: sims[p])), 0) AS gain
    FROM walk w JOIN choice c ON c.query_id = w.query_id WHERE len(chosen) < 4 AND NOT list_contains(chosen, c.pos)) GROUP BY query_id
), ranked AS (
  SELECT query_id, unnest(chosen) AS pos, unnest(range(1, len(chosen) + 1)) AS place FROM walk
  QUALIFY len(chosen) = max(len(chosen)) OVER (PARTITION BY query_id)
), best AS (
  SELECT c.* EXCLUDE (pos), place, max((score > 0.4)::INT) OVER (PARTITION BY query_id) AS any_above
  FROM ranked JOIN candidates c USING (query_id, pos)
), hits AS (
  SELECT * EXCLUDE (place, any_above), row_number() OVER (PARTITION BY query_id ORDER BY place) AS pos FROM best
  WHERE any_above = 0 OR score > 0.4 QUALIFY pos <= 3
), titled AS (""" + REST.split("), titled AS (")[1]

OUTCOMES = first_case("all_text", [(n, p) for n, p in L.OUTCOME_RULES], "'undetermined'")

BM25_TOP5 = f"""
WITH {CHUNKS}, {QUERIES}, scores AS (
  SELECT query_id, id, ord, sum(ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.4
        / (tf + 1.4 * (0.25 + 0.75 * greatest(1, length) / greatest(1, mean)))) AS bm25
  FROM q_tok JOIN tf USING (token) JOIN df USING (token) JOIN lengths USING (id), stats GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, ord)::INT AS rank, id,
  round(bm25, 4) AS bm25 FROM scores QUALIFY rank <= 5"""

CHECKS = [
    Check("doc_tokens", doc_tokens, f"""
WITH {DOC_WORDS}, firsts AS (SELECT doc_id, token, min(pos) AS pos FROM kept GROUP BY ALL)
SELECT d.doc_id, count(token)::INT AS n_tokens, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS tokens
FROM documents d LEFT JOIN firsts USING (doc_id) GROUP BY d.doc_id"""),
    Check("doc_token_freq", doc_token_freq,
          f"WITH {DOC_WORDS} SELECT doc_id, token, count(*)::INT AS tf FROM kept GROUP BY ALL"),
    Check("doc_windows", doc_windows, f"WITH {WINDOWS} SELECT doc_id, pos::INT AS pos, text FROM windows"),
    Check("chunk_table", chunk_table,
          "WITH " + CHUNKS + ","
          + hashed("(SELECT id, title || ' ' || text AS body FROM chunks)", "id", "body", 0.45, "cv") + """
SELECT id, doc_id::VARCHAR AS case_id, ord, text, coalesce(n_tokens, 0)::INT AS n_tokens,
  coalesce(length, 0)::INT AS length, round(coalesce(norm, 0), 4) AS norm
FROM chunks LEFT JOIN lengths USING (id) LEFT JOIN cv_norm ON key = id"""),
    Check("chunk_clean_text", chunk_clean, f"WITH {CHUNKS} SELECT id, clean AS clean_text FROM chunks"),
    Check("chunk_token_df", token_df, f"WITH {CHUNKS} SELECT token, df FROM df"),
    Check("chunk_index_stats", index_stats,
          f"WITH {CHUNKS} SELECT 192 AS dims, n_chunks, round(mean, 4) AS avg_chunk_length FROM stats"),
    Check("chunk_saved_filter", saved_chunks, f"""
WITH {CHUNKS} SELECT id, doc_id::VARCHAR AS case_id FROM chunks
WHERE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 80
  AND NOT regexp_matches(lower(text), 'case title extracted|cited-cases metadata|https?://')"""),
    Check("bm25_top5", bm25_top5, BM25_TOP5),
    Check("bm25_pairs", bm25_pairs, BM25_TOP5),
    Check("bm25_pruned", bm25_pruned, BM25_TOP5),
    Check("hashed_vectors", hashed_vectors,
          "WITH " + hashed("documents", "doc_id", "text", 0.45)
          + " SELECT key AS doc_id, bucket, round(w, 4) AS weight FROM vec"),
    Check("hash_buckets", hash_buckets, """
SELECT doc_id, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)),
  lambda h, c: (h * 31 + c) & 4294967295) % 11)::INT AS bucket FROM documents"""),
    Check("embedding_cosine", embedding_cosine, """
WITH parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
means AS (SELECT label, dim, avg(x) AS m FROM parts GROUP BY ALL)
SELECT vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 4) AS cosine
FROM parts JOIN means USING (label, dim) GROUP BY vec_id, label"""),
    Check("gated_queries", gated_queries, f"""
WITH {QUERIES} SELECT query_id, n_tokens, n_expanded, n_phrases,
  (SELECT string_agg(token, ' ' ORDER BY token) FROM q_exp e WHERE e.query_id = n.query_id) AS expanded FROM q_n n"""),
    Check("retrieval_pool", retrieval_pool,
          f"WITH {POOL} SELECT query_id, rank::INT AS rank, id, round(score, 4) AS score FROM pool"),
    Check("retrieval_pool_pruned", retrieval_pool_pruned,
          f"WITH {POOL} SELECT query_id, rank::INT AS rank, id, round(score, 4) AS score FROM pool"),
    Check("retrieval_candidates", retrieval_candidates,
          f"WITH {POOL} SELECT query_id, pos::INT AS pos, id, doc_id::VARCHAR AS case_id FROM candidates"),
    Check("retrieval_sources", retrieval_sources, f"""
WITH {POOL} SELECT query_id, source_no, doc_id::VARCHAR AS case_id, clean_title, round(score, 4) AS score FROM sources"""),
    Check("retrieval_confidence", retrieval_confidence, f"""
WITH {POOL}, n AS (SELECT query_id, count(*) AS n FROM sources GROUP BY 1)
SELECT h.query_id, coalesce(any_value(n), 0)::BIGINT AS n_sources, least(99, greatest(40, floor(round(
  (avg(score) * 0.9 + least(1, coalesce(any_value(n), 0) / 4.0) * 0.1) * 100, 6) + 0.5)))::INT AS confidence
FROM hits h LEFT JOIN n USING (query_id) GROUP BY h.query_id"""),
    Check("retrieval_outcomes", retrieval_outcomes, f"""
WITH {POOL}, joined AS (SELECT query_id, lower(string_agg(text, ' ' ORDER BY pos)) AS all_text FROM hits GROUP BY 1)
SELECT query_id, {OUTCOMES} AS outcome FROM joined"""),
    Check("retrieval_reranked", retrieval_reranked,
          f"WITH RECURSIVE {RERANKED} SELECT query_id, pos::INT AS pos, id, round(score, 4) AS score FROM hits"),
    Check("retrieval_answers", retrieval_answers, f"""
WITH RECURSIVE {RERANKED}, n AS (SELECT query_id, count(*) AS n FROM sources GROUP BY 1),
sure AS (SELECT h.query_id, coalesce(any_value(n), 0)::BIGINT AS n_sources, least(99, greatest(40, floor(round(
  (avg(score) * 0.9 + least(1, coalesce(any_value(n), 0) / 4.0) * 0.1) * 100, 6) + 0.5)))::INT AS confidence
FROM hits h LEFT JOIN n USING (query_id) GROUP BY h.query_id),
asked AS (SELECT query_id::BIGINT AS query_id, text <> '' AS typed, query_id IN (SELECT query_id FROM gated) AS inside FROM q_text
  UNION ALL VALUES (-1, false, false), (-2, true, false), (-3, false, false)),
told AS (SELECT a.query_id, CASE WHEN NOT typed THEN 'blank' WHEN NOT inside THEN 'out_of_domain' WHEN confidence IS NULL THEN 'no_hits'
  ELSE 'grounded' END AS state, n_sources, confidence FROM asked a LEFT JOIN sure s ON s.query_id = a.query_id)
SELECT query_id, state, state = 'grounded' AS grounded, coalesce(n_sources, 0) AS n_sources, coalesce(confidence, 0) AS confidence FROM told"""),
]
