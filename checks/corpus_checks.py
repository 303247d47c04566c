"""Enrichment, assembly, listings, keywords, summaries, search and related cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Check, count_in, first_case, fill, in_list, sq, table, texts, trim_ws
from docketry.functions import enrich as E
from docketry.functions import facets as A
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators import corpus as K
from docketry.operators import related as D
from docketry.operators import search as S
from docketry.plans.tables import stored

# Words of the generated texts stand in for the legal lists.
PRIORITY = L.PriorityRules(
    urgency=("the ", "der ", "que ", "tion", "ment", "license"), impact=("and ", "und ", "les ", "des ", "thes"),
    deadline=("with", "von ", "elle", "eau"), compliance=("ing", "ung", "que", "los ", "oir"),
    citation="src", severity=((32, "ther|sch"), (30, "eux|das"), (26, "una|ver"), (18, "thth|ein"), (8, "ing|ier")),
)
VERDICTS = (
    ("Case Allowed / In Favor", "ther|und|elle"), ("Case Dismissed / Rejected", "the|que|une"),
    ("Conviction Recorded", "der|los"), ("Acquittal Recorded", "and|les"),
)
ANCHORS = ("ther", "und", "elle", "thth", "los", "ing")
TAGS = (("the", "Equality"), ("eau", "Life & Liberty"), ("der ", "Tax"), ("que ", "Criminal"), ("los", "Service Law"))
CUES = ((3, "the|que|und"), (3, "eau|sch|ment"), (2, "ther|ung|los"))
RULES = K.EnrichRules(PRIORITY, VERDICTS, ANCHORS, TAGS, CUES)


def raw_cases(spark, sf_dir):
    """Documents in the shape of raw cases: the first line is the title, the second names the
    issues, the last the decision."""
    body = F.col("text")
    n = F.col("doc_id")
    line = lambda at: X.squash(F.get(F.split(body, "\n"), F.lit(at)))
    return texts(spark, sf_dir).select(
        F.concat(F.lit("D-"), n.cast("string")).alias("case_id"), n.alias("ord"),
        line(0).alias("title"),
        F.when(n % 3 == 0, "Supreme Court of India").when(n % 3 == 1, F.concat(F.col("lang"), F.lit(" High Court"))).otherwise(
            F.concat(F.lit("District Court "), F.col("source"))).alias("court"),
        F.when(n % 4 == 0, "").otherwise(F.col("lang")).alias("jurisdiction"),
        F.when(n % 7 == 0, "").otherwise(F.concat((F.lit(1995) + n % 30).cast("string"), F.lit("-03-04"))).alias("decision_date"),
        F.when(n % 5 == 0, "").otherwise(F.concat(F.col("source"), F.lit(" 12, "), F.col("lang"), F.lit(" SCR 3"))).alias("citation"),
        F.when(n % 6 == 0, "").when(n % 6 == 1, "criminal matter").when(n % 6 == 2, "Family").otherwise(F.col("lang")).alias("case_type"),
        F.lit("").alias("summary"), body.alias("full_text"),
        line(1).alias("issues"),
        F.when(n % 2 == 0, X.squash(F.substring_index(body, "\n", -1))).otherwise("").alias("decision"),
    )


def cases(spark, sf_dir):
    return K.enrich_cases(raw_cases(spark, sf_dir), RULES)


def case_text(spark, sf_dir):
    return cases(spark, sf_dir).select("id", "summary", "judgment", "raw_judgment", "final_verdict")


def case_scores(spark, sf_dir):
    return cases(spark, sf_dir).select(
        "id", "year", "type", "similarity", "priority_score", "priority_band", "why_match",
        F.array_join("tags", "|").alias("tags"),
    )


def documents_as_records(spark, sf_dir):
    """Text and language make the key; copies of a document share it."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.lit("").alias("decision_date"),
        F.col("lang").alias("court"), "source",
    )


def deduped(spark, sf_dir):
    return K.dedupe_cases(documents_as_records(spark, sf_dir)).select("ord", "title", "court")


def reindexed(spark, sf_dir):
    d = K.dedupe_cases(documents_as_records(spark, sf_dir))
    return K.reindex(d).select("case_id", F.col("ord").alias("position"), "title")


def assembled(spark, sf_dir):
    d = documents_as_records(spark, sf_dir)
    target = d.count() * 9 // 10
    late = F.substring("source", 4, 10).cast("int") >= 10
    return K.build_corpus(d.filter(~late), d.filter(late), target).select("case_id", "title", "court", "source")


def keywords(spark, sf_dir):
    found = K.top_keywords(texts(spark, sf_dir), 14, ("with", "that"))
    return X.exploded(found, F.col("keywords"), ["place", "word"], ["doc_id"], positions=True)


def summaries(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", E.summary("text", CUES).alias("summary"))


def displayed(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", E.display_text("text").alias("shown"))


def verdict_classes(spark, sf_dir):
    rules = [("Convicted", "sch|eux"), ("Dismissed", "die|une|thth"), ("Allowed", "und|que|with")]
    c = E.verdict_class("text", rules)
    return texts(spark, sf_dir).select("doc_id", c.alias("verdict"), E.final_verdict(c, F.lit("")).alias("worded"))


def document_facts(spark, sf_dir):
    """Type, signal, citations, provisions and highlights of each document."""
    rules = [("Criminal", "thes|sch"), ("Tax", "eau|ment"), ("Civil", "tion")]
    signals = [(2, "the|und"), (2, "que|der"), (2, "eau"), (2, "ther|sich"), (1, "license")]
    t = F.col("text")
    return texts(spark, sf_dir).select(
        "doc_id", E.case_type(t, "document", rules).alias("suspected_type"), E.domain_signal(t, signals).alias("signal"),
        F.array_join(E.citation_years(t), ",").alias("years"),
        F.array_join(E.citation_reporters(t, ["THE", "SRC", "EAU", "LICENSE"]), ",").alias("reporters"),
        F.array_join(E.highlights(t, [("ther", "a"), ("eux", "b"), ("los ", "c"), ("ung", "d")], ["none"]), ",").alias("highlights"),
        E.verdict_signal(t, [(3, "the"), (3, "der|die"), (4, "que"), (2, "eau|ther")]).alias("verdict_points"),
    )


def citation_table(spark, sf_dir):
    """Documents with phrases made of their own keys in front, so that every kind of value varies."""
    k = F.col("doc_id")
    phrase = F.concat(
        F.lit("Whether section "), k % 40 + 1, F.lit("A of the rules binds party "), k % 7, F.lit("; AIR "), k % 60 + 1950, F.lit(" SC, article "),
        k % 30, F.lit(" and ipc "), k % 90 + 300, F.lit(". "))
    docs = texts(spark, sf_dir).select("doc_id", F.concat(F.when(k % 3 == 0, F.lit("")).otherwise(phrase), "text").alias("text"))
    return K.citation_table(docs).filter(F.col("kind").isin("reference", "year", "reporter", "issue"))


def facet_columns(spark, sf_dir):
    c = cases(spark, sf_dir)
    places = ("src1", "src7", "src12", "en ", "fr")
    return c.select(
        "id", A.court_level("court").alias("level"), A.court_location("court", places).alias("place"),
        A.type_bucket("type").alias("bucket"), A.judge_category("type").alias("category"),
        A.jurisdiction_tag("tags").alias("jurisdiction"),
        A.match_level(F.col("similarity") / 100).alias("level_server"),
        A.match_level(F.col("similarity") / 100, "client").alias("level_client"),
    )


def faceted(spark, sf_dir):
    return K.facet_filter(cases(spark, sf_dir), court="High Court", kind="Specialized Cases", query="the and").select(
        "id", "court", "type"
    )


def listed(spark, sf_dir):
    return K.list_cases(cases(spark, sf_dir), "Supreme Court of India", "General").select("id", "priority_score")


def facet_values(spark, sf_dir):
    return K.facets(cases(spark, sf_dir), ("src1", "src7", "en "))


def titles(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", E.case_title("text").alias("title"))


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def search_rows(spark, sf_dir):
    c = stored(cases(spark, sf_dir).drop("raw_judgment"), "cases")
    return S.search_cases(questions(spark, sf_dir), c, 5)


def searched(spark, sf_dir):
    return search_rows(spark, sf_dir).select(
        "query_id", "rank", "id", F.round("rank_score", 4).alias("rank_score"), "shown_similarity", "match_level"
    )


def searched_blank(spark, sf_dir):
    """Blank and missing search texts among real ones."""
    blank = spark.createDataFrame([(-1, " \n"), (-2, None)], "query_id BIGINT, text STRING")
    asked = questions(spark, sf_dir).select(F.col("query_id").cast("bigint").alias("query_id"), "text").unionByName(blank)
    return S.search_cases(asked, cases(spark, sf_dir), 5).filter("query_id < 0").select(
        F.col("query_id"), "rank", "id", "shown_similarity")


def searched_offline(spark, sf_dir):
    return S.search_cases(questions(spark, sf_dir), cases(spark, sf_dir), 5, offline=True).select(
        "query_id", "rank", "id", F.round("rank_score", 4).alias("rank_score")
    )


def explained(spark, sf_dir):
    hits = search_rows(spark, sf_dir).join(
        F.broadcast(questions(spark, sf_dir).withColumnRenamed("text", "query_text")), "query_id"
    )
    return S.explain_matches(hits, ("with", "that")).select(
        "query_id", "id", F.array_join("matched_terms", "|").alias("matched_terms"), "why_matched"
    )


REL_TYPES = [("Criminal", "thes|sch"), ("Tax", "zzz"), ("En", "thon|thre"), ("Fr", "eau|elle")]
REL_SIGNALS = [(2, "the|und|que"), (1, "der")]


def user_documents(spark, sf_dir):
    """Turns of the conversations are the uploaded documents."""
    return texts(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit("upload").alias("file_name"), "text"
    )


def signals_of(spark, sf_dir):
    return D.document_signals(user_documents(spark, sf_dir), REL_TYPES, REL_SIGNALS, ("with",))


def related(spark, sf_dir):
    c = stored(cases(spark, sf_dir).drop("raw_judgment"), "cases")
    return D.related_cases(signals_of(spark, sf_dir), c).select(
        "doc_id", "rank", "id", "score", "overlap", "similarity", "reason"
    )


def sections(spark, sf_dir):
    c = stored(cases(spark, sf_dir).drop("raw_judgment"), "cases")
    signals = stored(signals_of(spark, sf_dir), "signals")
    return D.section_table(signals, D.related_cases(signals, c), c).select(
        "doc_id", "section_no", "section", "suspected_type", F.array_join("highlights", "|").alias("highlights"),
        F.size("matches").alias("n_matches"),
    )


def analysed(spark, sf_dir):
    c = stored(cases(spark, sf_dir).drop("raw_judgment"), "cases")
    signals = stored(signals_of(spark, sf_dir), "signals")
    table_rows = D.section_table(signals, D.related_cases(signals, c), c)
    return D.collect_matches(table_rows).select("doc_id", "title", "section", "match_no", "similarity")


# ---- SQL -----------------------------------------------------------------------
def word(body: str) -> str:
    return rf"(?i)\b({body})\b"


RAW = fill(
    r"""
raw AS (
  SELECT doc_id AS ord, 'D-' || doc_id AS id, <<first>> AS title,
    CASE doc_id % 3 WHEN 0 THEN 'Supreme Court of India' WHEN 1 THEN lang || ' High Court'
      ELSE 'District Court ' || source END AS court,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS jurisdiction,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1995 + doc_id % 30 END AS decided,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || ' 12, ' || lang || ' SCR 3' END AS citation,
    CASE doc_id % 6 WHEN 0 THEN 'General' WHEN 1 THEN 'criminal matter' WHEN 2 THEN 'Family' ELSE lang END AS type,
    text, t, <<second>> AS issues, CASE WHEN doc_id % 2 = 0 THEN <<last>> ELSE '' END AS decision
  FROM (SELECT *, <<t>> AS t FROM documents)
)""",
    t=sq("text"), first=sq("split_part(text, chr(10), 1)"), second=sq("split_part(text, chr(10), 2)"),
    last=sq("string_split(text, chr(10))[-1]"),
)


def summary_ctes(name: str, source: str, key: str, text: str, cues) -> str:
    """CTE ``<name>``: key and summary of a text column."""
    points = " + ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {n} ELSE 0 END" for n, p in cues)
    return fill(
        r"""
<<n>>_0 AS (SELECT <<key>> AS key, <<text>> AS t FROM <<source>>),
<<n>>_1 AS (SELECT key, CASE WHEN regexp_matches(t, '(?i)cited|decision|judge|issue|filter|[{}\[\]'']') THEN
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(?i)Cited\s+Cases\s*:\s*\{[^}]*\}?', ' ', 'g'), '(?i)\bDecision\s*:\s*[01](?:\.0)?\b', ' ', 'g'),
    '(?i)\bJudges?\s*:\s*[^\n;]*', ' ', 'g'), '(?i)\bIssues?\s*:\s*', ' ', 'g'), '(?i)\bfilter\s*:\s*[^;]*', ' ', 'g'),
    '''\s*:\s*\d+\.?\d*', ' ', 'g'), '[{}\[\]]', ' ', 'g'), '''\s*,\s*''', ' ', 'g') ELSE t END AS t FROM <<n>>_0),
<<n>>_2 AS (SELECT key, <<t>> AS t FROM <<n>>_1),
<<n>>_3 AS (SELECT key, unnest(s) AS s, unnest(range(len(s))) AS i FROM (
  SELECT key, string_split(regexp_replace(t, '([.!?])<<ws>>+', '\1' || chr(1), 'g'), chr(1)) AS s FROM <<n>>_2 WHERE length(t) >= 20)),
<<n>>_4 AS (SELECT key, i, trim(s) AS s, lower(trim(s)) AS low FROM <<n>>_3),
<<n>>_5 AS (SELECT key, s, row_number() OVER (PARTITION BY key ORDER BY <<points>>
    - CASE WHEN regexp_matches(low, '\b\d+\.\d+\b') THEN 2 ELSE 0 END
    - CASE WHEN regexp_matches(low, 'v\.\s') AND len(regexp_extract_all(low, 'v\.')) >= 3 THEN 2 ELSE 0 END DESC, i) AS r
  FROM <<n>>_4 WHERE length(s) > 25 AND NOT regexp_matches(s, '(?i)^in\s+the\s+\w+.*?\d{4}\s*$|cited\s+cases|^\s*decision\s*:\s*\d|^\s*\d+\s*$|^\s*[{}''":,\d.\s]+\s*$|^c-\w?\]\s*|^\s*filter\s*:')),
<<n>>_6 AS (SELECT key, trim(substr(string_agg(s, ' ' ORDER BY r), 1, 420)) AS s FROM <<n>>_5 WHERE r <= 3 GROUP BY key),
<<n>> AS (SELECT key, CASE WHEN length(t) < 20 THEN <<fallback>> WHEN s IS NOT NULL THEN s
    WHEN length(plain) < 30 THEN <<fallback>> ELSE plain END AS summary
  FROM (SELECT *, trim(regexp_replace(substr(t, 1, 260), '[{}''"]', '', 'g')) AS plain FROM <<n>>_2) LEFT JOIN <<n>>_6 USING (key))""",
        n=name, key=key, text=text, source=source, points=points, t=sq("t"), ws=r"[\s\x{A0}\x{2028}\x{3000}]",
        fallback="'" + L.SUMMARY_FALLBACK + "'",
    )


anchor_hits = ", ".join(
    f"nullif(regexp_extract(t, '(?s){word(a)}.{{0,320}}', 0), '')" for a in ANCHORS
)


def share(terms) -> str:
    return f"least(100, floor(({count_in('p', terms)})::DOUBLE / {len(terms)} * 100 + 0.5))"


severity_case = "CASE " + " ".join(
    f"WHEN regexp_matches(p, '\\b({body})\\b') THEN {n}" for n, body in PRIORITY.severity) + " ELSE 0 END"
late_verdict = (
    r"CASE WHEN regexp_matches(summary, '(?i)\ballowed|granted\b') THEN 'Case Allowed / In Favor' "
    r"WHEN regexp_matches(summary, '(?i)\bdismissed|rejected\b') THEN 'Case Dismissed / Rejected' "
    "ELSE 'Judgement reserved / Mixed outcome' END"
)
verdict_rules = [
    (VERDICTS[0][0], r"^(?:1|1\.0)$|(?i)\bdecision\s*:\s*1(?:\.0)?\b"),
    (VERDICTS[1][0], r"^(?:0|0\.0)$|(?i)\bdecision\s*:\s*0(?:\.0)?\b"),
    *[(label, word(body)) for label, body in VERDICTS],
]
WORDED = (
    "CASE WHEN regexp_matches(lower(v), 'conviction|convicted') THEN 'Conviction Recorded' "
    "WHEN regexp_matches(lower(v), 'acquittal|acquitted') THEN 'Acquittal Recorded' "
    "WHEN regexp_matches(lower(v), 'remand') THEN 'Matter Remanded' "
    "WHEN regexp_matches(lower(v), 'disposed') THEN 'Matter Disposed' "
    "WHEN regexp_matches(lower(v), 'dismissed|rejected|declined|denied|failed') THEN <<kind>> || ' Dismissed' "
    "WHEN regexp_matches(lower(v), 'allowed|granted|in favor|successful') THEN <<kind>> || ' Allowed' "
    "ELSE coalesce(nullif(v, ''), 'Judgement unavailable') END"
)
KIND = (
    r"CASE WHEN regexp_matches(lower(title), '\bappeal\b') THEN 'Appeal' "
    r"WHEN regexp_matches(lower(title), '\b(petition|writ|slp)\b') THEN 'Petition' "
    r"WHEN regexp_matches(lower(title), '\bapplication\b') THEN 'Application' ELSE 'Case' END"
)

CASES = (
    RAW + "," + summary_ctes("sm", "raw", "ord", "CASE WHEN text <> '' THEN text ELSE title END", CUES)
    + fill(r""",
judged AS (
  SELECT ord, CASE WHEN length(<<d>>) > 2 THEN substr(<<d>>, 1, 320)
    WHEN t = '' THEN 'Judgment text unavailable.'
    ELSE trim(substr(coalesce(<<anchors>>, t), 1, 320)) END AS raw_judgment FROM raw
),""", d=sq("decision"), anchors=anchor_hits)
    + summary_ctes("jm", "judged", "ord", "raw_judgment", CUES)
    + fill(r""",
cases AS (
  SELECT raw.ord, id, title, court, type, citation, jurisdiction, raw_judgment, sm.summary, jm.summary AS judgment,
    CASE WHEN decided IS NULL THEN 2000 ELSE decided END::INT AS year,
    greatest(45, least(98, 55 + least(20, floor(length(issues)::DOUBLE / 50 + 0.5))
      + least(10, floor(length(decision)::DOUBLE / 40 + 0.5))
      + least(8, len(list_filter(string_split(citation, ','), lambda x: x <> '')) * 2)
      + CASE WHEN length(title) > 30 THEN 4 ELSE 0 END))::INT AS similarity,
    greatest(20, least(99, floor(round(0.3e0 * <<u>> + 0.25e0 * <<i>> + 0.2e0 * <<dl>>
      + 0.15e0 * (60 + least(40, len(regexp_extract_all(citation, '(?i)src')) * 8)) + 0.1e0 * <<cp>>
      + coalesce(greatest(0, decided - 2000) * 0.15e0, 0) + <<sev>>, 6) + 0.5)))::INT AS priority_score,
    'Matched on ' || concat_ws(', ', CASE WHEN issues <> '' THEN 'issue overlap' END,
      CASE WHEN decision <> '' THEN 'similar outcome pattern' END, CASE WHEN citation <> '' THEN 'citation support' END)
      || ' in the source judgment metadata.' AS why,
    issues, decision, <<verdict>> AS v
  FROM (SELECT *, lower(issues || ' ' || decision || ' ' || title) AS p FROM raw) raw
  JOIN judged USING (ord) JOIN sm ON sm.key = ord JOIN jm ON jm.key = ord
), tag_rows AS (
  SELECT ord, tag, n FROM (
    SELECT ord, unnest([coalesce(nullif(jurisdiction, ''), 'India'), CASE WHEN citation <> '' THEN 'Cited' END,
      <<tags>>]) AS tag, unnest(range(<<nt>>)) AS n FROM cases) WHERE tag IS NOT NULL
), tagged AS (
  SELECT ord, CASE WHEN len(l) < 2 THEN list_append(l, 'General') ELSE l[1:4] END AS tags
  FROM (SELECT ord, list(tag ORDER BY n) AS l FROM tag_rows GROUP BY ord)
), enriched AS (
  SELECT cases.*, tags, array_to_string(tags, ' ') AS tag_text, <<worded>> AS final_verdict,
    CASE WHEN issues = '' AND decision = '' AND citation = '' THEN
      'Matched on legal narrative similarity from title and summary context.' ELSE why END AS why_match,
    CASE WHEN priority_score >= 85 THEN 'P0' WHEN priority_score >= 70 THEN 'P1' WHEN priority_score >= 50 THEN 'P2' ELSE 'P3' END AS band
  FROM cases JOIN tagged USING (ord)
)""",
        u=share(PRIORITY.urgency), i=share(PRIORITY.impact), dl=share(PRIORITY.deadline), cp=share(PRIORITY.compliance),
        sev=severity_case,
        verdict=f"CASE WHEN {sq('raw_judgment')} = '' THEN 'Judgement unavailable' ELSE "
        + first_case(sq("raw_judgment"), verdict_rules, late_verdict.replace("summary", "sm.summary")) + " END",
        tags=", ".join(f"CASE WHEN contains(lower(issues), '{t}') THEN '{tag}' END" for t, tag in TAGS),
        nt=str(2 + len(TAGS)), worded=WORDED.replace("<<kind>>", KIND))
)

SEARCH = (
    "WITH " + CASES
    + fill(r""",
blobs AS (
  SELECT ord, id, similarity, priority_score,
    lower(title || ' ' || summary || ' ' || judgment || ' ' || final_verdict || ' ' || why_match || ' ' || tag_text || ' ' || citation) AS blob,
    lower(title || ' ' || summary || ' ' || why_match || ' ' || tag_text) AS short,
    <<bonus>> AS bonus, title, summary, judgment, tag_text
  FROM enriched
), asks AS (SELECT item_id AS query_id, lower(<<trim>>) AS q FROM benchmark),
terms AS (SELECT query_id, unnest(list_filter(regexp_split_to_array(q, '<<ws>>+'), lambda x: x <> '')) AS term FROM asks),
toks AS (
  SELECT 'c' || id AS key, unnest(regexp_extract_all(blob, '[a-z0-9]{3,}')) AS token FROM blobs UNION ALL
  SELECT 'q' || query_id, unnest(regexp_extract_all(q, '[a-z0-9]{3,}')) FROM asks
), tok_hash AS (
  SELECT token,
    list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 192 AS a,
    list_reduce(list_prepend(16777619::BIGINT, list_transform(string_split(token, ''), lambda c: ascii(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 192 AS b FROM (SELECT DISTINCT token FROM toks)
), vec AS (
  SELECT key, bucket, sum(w) AS w FROM (
    SELECT key, a AS bucket, 1.0e0 AS w FROM toks JOIN tok_hash USING (token) UNION ALL
    SELECT key, b, 0.5e0 FROM toks JOIN tok_hash USING (token)) GROUP BY ALL
), norm AS (SELECT key, sqrt(sum(w * w)) AS n FROM vec GROUP BY key),
dots AS (SELECT a.key AS qk, b.key AS ck, sum(a.w * b.w) AS dot FROM vec a JOIN vec b USING (bucket)
  WHERE starts_with(a.key, 'q') AND starts_with(b.key, 'c') GROUP BY ALL),
hits AS (SELECT query_id, id, count(*) AS n FROM terms JOIN blobs ON contains(blob, term) GROUP BY ALL),
scored AS (
  SELECT query_id, q, b.*, round(14 * coalesce(n, 0) + 85 * coalesce(dot / (x.n1 * y.n2), 0)
    + similarity * 0.35e0 + priority_score * 0.2e0 + bonus, 9) AS score
  FROM asks JOIN blobs b ON q <> '' LEFT JOIN hits USING (query_id, id)
  LEFT JOIN dots ON qk = 'q' || query_id AND ck = 'c' || id
  LEFT JOIN (SELECT key, n AS n1 FROM norm) x ON x.key = qk LEFT JOIN (SELECT key, n AS n2 FROM norm) y ON y.key = ck
), found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord)::INT AS rank FROM scored
  WHERE score > 0 QUALIFY rank <= 5
)""",
        trim=trim_ws("text"), ws=r"[\s\x{A0}]",
        bonus=" + ".join(
            rf"CASE WHEN regexp_matches(lower(judgment), '\b({p})\b') THEN {n} ELSE 0 END" for n, p in L.VERDICT_SIGNALS))
)

RELATED = (
    "WITH " + CASES
    + fill(r""",
docs AS (SELECT conv_id * 1000 + turn AS doc_id, text, lower('upload ' || text) AS named FROM conversations),
signals AS (
  SELECT doc_id, text, upper(text) AS up, <<type>> AS kind FROM docs
  WHERE text <> '' AND (CASE WHEN regexp_matches(named, '\b(the|und|que)\b') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(named, '\bder\b') THEN 1 ELSE 0 END) >= 2
), words AS (
  SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(i)) AS r FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
      SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM signals)) WHERE word <> 'with' GROUP BY doc_id, word
), keywords AS (SELECT doc_id, word FROM words WHERE r <= 14),
years AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(up, '\b(?:19|20)\d{2}\b')) AS y FROM signals),
hay AS (SELECT *, lower(title || ' ' || summary || ' ' || tag_text || ' ' || why_match || ' ' || citation) AS h FROM enriched),
ovl AS (SELECT doc_id, id, count(*) AS n FROM keywords JOIN hay ON contains(h, word) GROUP BY ALL),
scored AS (
  SELECT s.doc_id, c.id, c.ord, c.title, c.type, coalesce(n, 0) AS overlap,
    CASE WHEN y.y IS NOT NULL THEN 8 ELSE 0 END + 10 * (<<reporters>>) AS boost,
    similarity * 0.6e0 + priority_score * 0.2e0 AS base
  FROM signals s JOIN hay c ON kind = 'General' OR contains(lower(type), lower(kind))
  LEFT JOIN ovl o ON o.doc_id = s.doc_id AND o.id = c.id
  LEFT JOIN years y ON y.doc_id = s.doc_id AND y.y = c.year::VARCHAR
), best AS (
  SELECT *, round(8 * overlap + base + boost, 6) AS score,
    row_number() OVER (PARTITION BY doc_id ORDER BY round(8 * overlap + base + boost, 9) DESC, ord)::INT AS rank
  FROM scored QUALIFY rank <= 3
)""",
        type=first_case("named", REL_TYPES, "'General'"),
        reporters=" + ".join(f"(contains(up, '{r}') AND contains(upper(citation), '{r}'))::INT" for r in L.REPORTERS))
)

def marks(pool, defaults):
    found = ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{label}' END" for k, label in pool)
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL)[1:5], '|'), ''), '{'|'.join(defaults)}')"


CHECKS = [
    Check("case_scores", case_scores, f"""
WITH {CASES} SELECT id, year, type, similarity, priority_score, band AS priority_band, why_match,
  array_to_string(tags, '|') AS tags FROM enriched"""),
    Check("case_texts", case_text, f"""
WITH {CASES} SELECT id, summary, judgment, raw_judgment, final_verdict FROM enriched"""),
    Check("case_dedupe", deduped, """
SELECT doc_id AS ord, text AS title, lang AS court FROM documents WHERE text <> ''
QUALIFY row_number() OVER (PARTITION BY lower(text), lower(lang) ORDER BY doc_id) = 1"""),
    Check("case_reindex", reindexed, """
WITH d AS (SELECT doc_id, text AS title FROM documents WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(text), lower(lang) ORDER BY doc_id) = 1)
SELECT 'CASE-' || lpad(n::VARCHAR, 6, '0') AS case_id, n - 1 AS position, title
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM d)"""),
    Check("corpus_assembly", assembled, """
WITH n AS (SELECT count(*) AS total, count(*) * 9 // 10 AS target,
    count(*) FILTER (WHERE substr(source, 4)::INT < 10) AS have FROM documents),
extra AS (SELECT * FROM documents WHERE substr(source, 4)::INT >= 10
  QUALIFY row_number() OVER (ORDER BY doc_id) <= (SELECT (target - have) + ceil((target - have) * 0.2) FROM n)),
merged AS (SELECT 0 AS s, * FROM documents WHERE substr(source, 4)::INT < 10 UNION ALL SELECT 1, * FROM extra),
kept AS (SELECT *, text AS title FROM merged WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(text), lower(lang) ORDER BY s, doc_id) = 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY s, doc_id) AS k FROM kept)
SELECT 'CASE-' || lpad(k::VARCHAR, 6, '0') AS case_id, title, lang AS court, source FROM numbered, n WHERE k <= target"""),
    Check("document_keywords", keywords, """
WITH w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(i) AS i FROM w WHERE word NOT IN ('with', 'that') GROUP BY ALL)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) - 1)::INT AS place, word FROM c QUALIFY place < 14"""),
    Check("document_summaries", summaries,
          "WITH " + summary_ctes("sm", "documents", "doc_id", "text", CUES) + " SELECT key AS doc_id, summary FROM sm"),
    Check("document_display_text", displayed, fill(r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)Cited\s+Cases\s*:\s*\{[^}]*\}?', '', 'g'), '(?i)\bCited\s+Cases\s*:', '', 'g'),
    '(?i)\bDecision\s*:\s*[01](?:\.0)?\b', '', 'g'), '(?i)\bJudges?\s*:\s*[^.;\n]*', '', 'g'),
    '(?i)\bIssues?\s*:\s*', '', 'g'), '(?i)\bfilter\s*:\s*[^;.]*', '', 'g'), '''\s*:\s*\d+\.?\d*', '', 'g'),
    '[{}\[\]]', '', 'g'), '''\s*,\s*''', ', ', 'g'), '(?i)\bc-\w?\]', '', 'g') AS t FROM documents),
e AS (SELECT doc_id, <<trim>> AS t FROM (SELECT doc_id, regexp_replace(t, '<<ws>>{2,}', ' ', 'g') AS t FROM d))
SELECT doc_id, CASE WHEN length(t) < 20 THEN '' ELSE t END AS shown FROM e""",
        trim=trim_ws("t"), ws=r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")),
    Check("document_verdicts", verdict_classes, f"""
WITH d AS (SELECT doc_id, '' AS title, {sq("text")} AS t FROM documents),
e AS (SELECT doc_id, title, CASE WHEN t = '' THEN 'Unknown' ELSE {first_case('t', [
    ("Allowed", verdict_rules[0][1]), ("Dismissed", verdict_rules[1][1]), ("Convicted", word("sch|eux")),
    ("Dismissed", word("die|une|thth")), ("Allowed", word("und|que|with"))], "'Unknown'")} END AS v FROM d)
SELECT doc_id, v AS verdict, {WORDED.replace("<<kind>>", KIND)} AS worded FROM e"""),
    Check("document_facts", document_facts, fill(r"""
WITH y AS (SELECT doc_id, string_agg(y, ',' ORDER BY i) AS years FROM (
  SELECT doc_id, y, min(i) AS i FROM (SELECT doc_id, unnest(w) AS y, unnest(range(len(w))) AS i FROM (
    SELECT doc_id, regexp_extract_all(upper(text), '\b(?:19|20)\d{2}\b') AS w FROM documents)) GROUP BY ALL) GROUP BY 1)
SELECT doc_id, <<type>> AS suspected_type,
  CASE WHEN regexp_matches(low, '\b(the|und)\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, '\b(que|der)\b') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(low, '\beau\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, '\b(ther|sich)\b') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(low, '\blicense\b') THEN 1 ELSE 0 END AS signal, coalesce(years, '') AS years,
  concat_ws(',', CASE WHEN contains(upper(text), 'THE') THEN 'THE' END, CASE WHEN contains(upper(text), 'SRC') THEN 'SRC' END,
    CASE WHEN contains(upper(text), 'EAU') THEN 'EAU' END, CASE WHEN contains(upper(text), 'LICENSE') THEN 'LICENSE' END) AS reporters,
  coalesce(nullif(concat_ws(',', CASE WHEN contains(low, 'ther') THEN 'a' END, CASE WHEN contains(low, 'eux') THEN 'b' END,
    CASE WHEN contains(low, 'los ') THEN 'c' END, CASE WHEN contains(low, 'ung') THEN 'd' END), ''), 'none') AS highlights,
  CASE WHEN regexp_matches(low, '\bthe\b') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(low, '\b(der|die)\b') THEN 3 ELSE 0 END
  + CASE WHEN regexp_matches(low, '\bque\b') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(low, '\b(eau|ther)\b') THEN 2 ELSE 0 END AS verdict_points
FROM (SELECT *, lower(text) AS low FROM documents) LEFT JOIN y USING (doc_id)""",
        type=first_case("low", [("Criminal", "thes|sch"), ("Tax", "eau|ment"), ("Civil", "tion")], "'General'"))),
    Check("citation_table", citation_table, r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Whether section ' || (doc_id % 40 + 1) || 'A of the rules binds party ' || (doc_id % 7)
    || '; AIR ' || (doc_id % 60 + 1950) || ' SC, article ' || (doc_id % 30) || ' and ipc ' || (doc_id % 90 + 300) || '. ' END || text AS t FROM documents),
r AS (SELECT doc_id, 'reference' AS kind, unnest(list_concat(regexp_extract_all(lower(t), '\b(?:article|section)\s+\d+[a-z]?\b'),
    regexp_extract_all(lower(t), '\b(?:ipc|crpc)\s*\d+[a-z]?\b'))) AS m FROM d)
SELECT DISTINCT doc_id, kind, regexp_replace(m, '^([a-z]+)\s*(.*)$', '\1-\2') AS value FROM r
UNION ALL SELECT DISTINCT doc_id, 'year', unnest(regexp_extract_all(upper(t), '\b(?:19|20)\d{2}\b')) FROM d
UNION ALL SELECT doc_id, 'reporter', x FROM d, (VALUES ('AIR'), ('SCC'), ('SCR'), ('CRILJ'), ('ALL ER')) v(x) WHERE contains(upper(t), x)
UNION ALL SELECT DISTINCT doc_id, 'issue', upper(s[1]) || s[2:] || '.' FROM (
  SELECT doc_id, trim(regexp_replace(unnest(regexp_extract_all(lower(t), 'whether\s+[^.;,]{10,120}')), '\s+', ' ', 'g')) AS s FROM d)"""),
    Check("case_facet_columns", facet_columns, f"""
WITH {CASES} SELECT id,
  CASE WHEN contains(lower(court), 'supreme') THEN 'Supreme Court' WHEN contains(lower(court), 'high') THEN 'High Court'
    WHEN contains(lower(court), 'district') THEN 'District Court' ELSE 'Other Court' END AS level,
  CASE WHEN contains(lower(court), 'src1') THEN 'Src1' WHEN contains(lower(court), 'src7') THEN 'Src7'
    WHEN contains(lower(court), 'src12') THEN 'Src12' WHEN contains(lower(court), 'en ') THEN 'En '
    WHEN contains(lower(court), 'fr') THEN 'Fr' WHEN contains(lower(court), 'supreme') THEN 'National' ELSE 'Unspecified' END AS place,
  {first_case('lower(type)', [('Criminal', 'criminal|ipc|crime|offence'), ('Civil', 'civil|property|contract|family')], "'Specialized Cases'")} AS bucket,
  {first_case('lower(type)', [('Criminal', 'criminal|ipc|crime|offence'), ('Civil', 'civil|property|contract|family')], "'Other'")} AS category,
  coalesce(list_filter(tags, lambda t: t NOT IN ({in_list(L.NON_JURISDICTION_TAGS)}))[1], 'India') AS jurisdiction,
  CASE WHEN similarity >= 80 THEN 'High Match' WHEN similarity >= 60 THEN 'Moderate Match' WHEN similarity >= 40 THEN 'Low Match' ELSE 'Very Low Match' END AS level_server,
  CASE WHEN similarity >= 85 THEN 'High' WHEN similarity >= 60 THEN 'Medium' ELSE 'Low' END AS level_client
FROM enriched"""),
    Check("case_facet_filter", faceted, f"""
WITH {CASES} SELECT id, court, type FROM enriched
WHERE contains(lower(court), 'high') AND NOT contains(lower(court), 'supreme')
  AND NOT regexp_matches(lower(type), 'criminal|ipc|crime|offence|civil|property|contract|family')
  AND contains(lower(concat_ws(' ', title, summary, why_match, court, type, year::VARCHAR, tag_text)), 'the')
  AND contains(lower(concat_ws(' ', title, summary, why_match, court, type, year::VARCHAR, tag_text)), 'and')"""),
    Check("case_listing", listed, f"""
WITH {CASES} SELECT id, priority_score FROM enriched WHERE court = 'Supreme Court of India' AND type = 'General'"""),
    Check("case_facet_values", facet_values, f"""
WITH {CASES} SELECT DISTINCT 'court' AS facet, court AS value FROM enriched WHERE lower(court) <> 'supreme court of india'
UNION ALL SELECT DISTINCT 'location', CASE WHEN contains(lower(court), 'src1') THEN 'Src1' WHEN contains(lower(court), 'src7') THEN 'Src7'
  WHEN contains(lower(court), 'en ') THEN 'En ' WHEN contains(lower(court), 'supreme') THEN 'National' ELSE 'Unspecified' END FROM enriched"""),
    Check("document_titles", titles, fill(r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<<ws>>+', ' ', 'g'), '\.\.\.$', '')) AS t FROM documents),
w AS (SELECT doc_id, t, array_to_string(list_transform(string_split(t, ' '), lambda w: CASE
    WHEN lower(w) IN (<<small>>) THEN lower(w) WHEN regexp_full_match(w, '[A-Z]{2,}') THEN w
    ELSE replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:]) END), ' ') AS j FROM t)
SELECT doc_id, CASE WHEN t = '' THEN 'Untitled Case' ELSE replace(upper(j[1]), 'ẞ', 'SS') || j[2:] END AS title FROM w""",
        small=in_list(L.TITLE_VERSUS + L.TITLE_SMALL_WORDS),
        ws=r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]")),
    Check("case_search", searched, f"""
{SEARCH} SELECT query_id, rank, id, round(score, 4) AS rank_score,
  least(99, greatest(40, floor(score + 0.5)))::INT AS shown_similarity,
  CASE WHEN s >= 0.8 THEN 'High Match' WHEN s >= 0.6 THEN 'Moderate Match' WHEN s >= 0.4 THEN 'Low Match' ELSE 'Very Low Match' END AS match_level
FROM (SELECT *, CASE WHEN score / 100 > 1 THEN score / 10000 ELSE score / 100 END AS s FROM found)"""),
    Check("case_search_blank", searched_blank, f"""
{SEARCH} SELECT q.query_id, row_number() OVER (PARTITION BY q.query_id ORDER BY ord)::INT AS rank, id, similarity::INT AS shown_similarity
FROM (VALUES (-1::BIGINT), (-2::BIGINT)) q(query_id), (SELECT * FROM blobs ORDER BY ord LIMIT 5)"""),
    Check("case_search_offline", searched_offline, f"""
{SEARCH}, light AS (SELECT query_id, id, count(*) AS n FROM terms JOIN blobs ON contains(short, term) GROUP BY ALL),
ranked AS (SELECT query_id, id, round(20 * coalesce(n, 0) + similarity + priority_score * 0.4e0, 9) AS s,
  row_number() OVER (PARTITION BY query_id ORDER BY round(20 * coalesce(n, 0) + similarity + priority_score * 0.4e0, 9) DESC, ord)::INT AS rank
  FROM asks JOIN blobs ON q <> '' LEFT JOIN light USING (query_id, id) QUALIFY rank <= 5)
SELECT query_id, rank, id, round(s, 4) AS rank_score FROM ranked"""),
    Check("case_search_explained", explained, fill(r"""
<<search>>, texts AS (SELECT query_id, id, text AS qt, title || ' ' || summary || ' ' || judgment || ' ' || tag_text AS ct
  FROM found JOIN (SELECT item_id AS query_id, text FROM benchmark) USING (query_id)),
phr AS (SELECT query_id, id, list_concat(list_concat(regexp_extract_all(b, '(?i)\barticle\s+\d+[a-z]?\b'), regexp_extract_all(b, '(?i)\bsection\s+\d+[a-z]?\b')),
    list_concat(regexp_extract_all(b, '(?i)\b[a-z][a-z\s]{2,40}\s+act\b'), regexp_extract_all(b, '(?i)\b[a-z][a-z\s]{2,30}\s+law\b'))) AS l
  FROM (SELECT *, qt || ' ' || ct AS b FROM texts)),
tok AS (SELECT query_id, id, regexp_extract_all(lower(qt), '[a-z0-9]{4,}') AS a, regexp_extract_all(lower(ct), '[a-z0-9]{4,}') AS c FROM texts),
alls AS (
  SELECT query_id, id, 0 AS part, unnest(l) AS term, unnest(range(len(l))) AS i FROM phr UNION ALL
  SELECT query_id, id, 1, w, i FROM (SELECT query_id, id, c, unnest(a) AS w, unnest(range(len(a))) AS i FROM tok)
  WHERE list_contains(c, w) AND w NOT IN ('with', 'that')),
picked AS (SELECT query_id, id, trim(regexp_replace(term, '\s+', ' ', 'g')) AS term, min(part * 1000000 + i) AS spot FROM alls GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY spot) AS r FROM picked QUALIFY r <= 6),
line AS (SELECT f.query_id, f.id, coalesce(string_agg(term, '|' ORDER BY r), '') AS terms, string_agg(term, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS lead
  FROM found f LEFT JOIN top t ON t.query_id = f.query_id AND t.id = f.id GROUP BY ALL)
SELECT query_id, id, terms AS matched_terms, 'This case matches due to ' || CASE WHEN lead IS NULL THEN 'similar legal issues and factual patterns'
  ELSE 'shared legal terms (' || lead || ')' END || ', comparable statutory context, and aligned judgement outcomes.' AS why_matched FROM line""",
        search=SEARCH)),
    Check("related_cases", related, f"""
{RELATED} SELECT doc_id, rank, id, score, overlap::INT AS overlap, least(99, greatest(45, floor(score + 0.5)))::INT AS similarity,
  CASE WHEN boost > 0 AND overlap > 0 THEN 'Matched by overlapping legal terms (' || overlap || ' keyword hits), case-type similarity, and citation overlap.'
    WHEN boost > 0 THEN 'Matched by citation overlap and case-type similarity (' || type || ').'
    WHEN overlap > 0 THEN 'Matched by overlapping legal terms (' || overlap || ' keyword hits) and case-type similarity.'
    ELSE 'Matched by case-type similarity (' || type || ') and baseline legal relevance.' END AS reason FROM best"""),
    Check("document_sections", sections, fill(r"""
<<related>>, f AS (SELECT conv_id * 1000 + turn AS doc_id, text, lower(text) AS low, lower('upload ' || text) AS named FROM conversations),
g AS (SELECT f.*, <<type>> AS kind, (CASE WHEN regexp_matches(named, '\b(the|und|que)\b') THEN 2 ELSE 0 END
    + CASE WHEN regexp_matches(named, '\bder\b') THEN 1 ELSE 0 END) >= 2 AS fits,
    (SELECT count(*) FROM best b WHERE b.doc_id = f.doc_id)::INT AS n FROM f),
r AS (SELECT doc_id, 1 AS section_no, 'Facts' AS section, kind, 'upload|' || kind || '|PDF text extracted' AS h, n FROM g UNION ALL
  SELECT doc_id, 2, 'Issues', kind, CASE WHEN fits THEN <<issues>> ELSE 'No legal/case indicators detected in uploaded content' END, n FROM g UNION ALL
  SELECT doc_id, 3, 'Relief Sought', kind, CASE WHEN fits THEN <<relief>> ELSE 'No legal relief pattern detected' END, n FROM g)
SELECT doc_id, section_no, section, kind AS suspected_type, h AS highlights, n AS n_matches FROM r""",
        related=RELATED, type=first_case("named", REL_TYPES, "'General'"),
        issues=marks(L.ISSUE_HIGHLIGHTS, L.ISSUE_DEFAULTS), relief=marks(L.RELIEF_HIGHLIGHTS, L.RELIEF_DEFAULTS))),
    Check("document_matches", analysed, f"""
{RELATED} SELECT doc_id, title, 'Facts' AS section, (rank - 1)::INT AS match_no, least(99, greatest(45, floor(score + 0.5)))::INT AS similarity
FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, title ORDER BY rank) = 1"""),
]
