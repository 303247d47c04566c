"""Links, clean text and page addresses of stored pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Check, table, texts
from docketry.functions import facets as A
from docketry.functions import text as X
from docketry.sources import pages as G

RULES = G.LinkRules(
    fragment=r"/([A-Z][a-z]+)", document=r"/[a-z]+[^\"']*", browse=r"/[a-z]{3,5}[^\"'#]*",
    skip_label=r"(?i)^(der|the)$", base="https://example.org/browse/",
)


def links(spark, sf_dir):
    return G.document_links(texts(spark, sf_dir, "pages"), RULES).select("page_id", "no", "href", "label")


def clean_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", X.markup_text("html").alias("text"))


def browse_urls(spark, sf_dir):
    return G.listing_links(texts(spark, sf_dir, "pages"), "browse", RULES)


def new_links(spark, sf_dir):
    found = G.document_links(texts(spark, sf_dir, "pages"), RULES)
    plain = table(spark, sf_dir, "pages").filter(F.col("url").startswith("http://")).select("page_id")
    seen = found.join(plain, "page_id", "left_semi")
    return G.unseen_links(found, seen)


def page_urls(spark, sf_dir):
    return G.expand_page_urls(table(spark, sf_dir, "pages").select("page_id", "url"), 3).select(
        "page_id", "page_num", "page_url"
    )


def path_templates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", A.path_template(F.regexp_extract("url", r"^https?://[^/]+([^?]*)", 1)).alias("path_key")
    )


def listing_cases(spark, sf_dir):
    named = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(
            F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" on "),
            (F.col("page_id") % 28 + 1).cast("string"), F.lit(" March, "), (F.lit(1990) + F.col("page_id") % 30).cast("string"),
        ).alias("label"),
    )
    return G.links_to_cases(named).select("page_id", "title", "decision_date", "case_type", "summary")


CLEAN = (
    r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({x}, '&amp;', '&'), '&quot;', '\"'), "
    r"'&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '<[^>]+>', ' ', 'g'), "
    r"'[\s\x{{0B}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"
)


def clean(x: str) -> str:
    return CLEAN.format(x=x).replace('\\"', '"')


FOUND = rf"""
frag AS (SELECT page_id, unnest(a) AS href, unnest(b) AS label, unnest(range(len(a))) AS i FROM (SELECT page_id,
  regexp_extract_all(html, '(?i)<a[^>]*href=["''](/([A-Z][a-z]+))["''][^>]*>([\s\S]*?)</a>', 2) AS a,
  regexp_extract_all(html, '(?i)<a[^>]*href=["''](/([A-Z][a-z]+))["''][^>]*>([\s\S]*?)</a>', 3) AS b FROM pages)),
docs AS (SELECT page_id, unnest(a) AS href, unnest(b) AS label, unnest(range(len(a))) AS i FROM (SELECT page_id,
  regexp_extract_all(html, '(?i)<a[^>]*href=["''](/[a-z]+[^"'']*)["''][^>]*>([\s\S]*?)</a>', 1) AS a,
  regexp_extract_all(html, '(?i)<a[^>]*href=["''](/[a-z]+[^"'']*)["''][^>]*>([\s\S]*?)</a>', 2) AS b FROM pages)),
both_kinds AS (
  SELECT page_id, 0 AS kind, i, '/doc/' || href || '/' AS href, {clean('label')} AS label FROM frag UNION ALL
  SELECT page_id, 1, i, {clean('href')}, {clean('label')} FROM docs
), found AS (
  SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY kind, i) - 1)::INT AS no, href, label FROM both_kinds
  WHERE href <> '' AND label <> '' AND NOT (kind = 1 AND regexp_matches(label, '(?i)^(der|the)$'))
)"""

CHECKS = [
    Check("page_links", links, f"WITH {FOUND} SELECT page_id, no, href, label FROM found"),
    Check("page_text", clean_pages, f"SELECT page_id, {clean('html')} AS text FROM pages"),
    Check("page_listing_urls", browse_urls, r"""
WITH h AS (SELECT page_id, unnest(a) AS href, unnest(range(len(a))) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '(?i)href=["''](/[a-z]{3,5}[^"''#]*)["'']', 1) AS a FROM pages)),
d AS (SELECT page_id, trim(href) AS href, min(i) AS i FROM h GROUP BY ALL)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS no, 'https://example.org' || href AS url
FROM d WHERE href <> ''"""),
    Check("page_new_links", new_links, f"""
WITH {FOUND}, firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, no) = 1)
SELECT href, page_id, no, label FROM firsts WHERE href NOT IN (SELECT href FROM found JOIN pages USING (page_id) WHERE starts_with(url, 'http://'))"""),
    Check("page_number_urls", page_urls, """
SELECT page_id, n::INT AS page_num, CASE WHEN n = 0 THEN url WHEN contains(url, '?') THEN url || '&pagenum=' || n
  ELSE url || '?pagenum=' || n END AS page_url FROM pages, range(3) r(n)"""),
    Check("page_path_templates", path_templates, r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?]*)', 1) AS p FROM pages),
parts AS (SELECT page_id, p, unnest(string_split(p, '/')[2:]) AS x, unnest(range(1, len(string_split(p, '/')))) AS i FROM p)
SELECT page_id, coalesce(string_agg('/' || CASE WHEN regexp_full_match(x, '[0-9]+') OR regexp_full_match(x, '[A-Za-z0-9_-]{10,}')
  THEN ':id' ELSE x END, '' ORDER BY i), '/') AS path_key FROM p LEFT JOIN parts USING (page_id) GROUP BY page_id"""),
    Check("page_listing_cases", listing_cases, rf"""
WITH t AS (SELECT page_id, {clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages),
c AS (SELECT page_id, CASE WHEN title = '' THEN 'on ' || (page_id % 28 + 1) || ' March, ' || (1990 + page_id % 30) ELSE title END AS title,
  CASE WHEN title = '' THEN '' ELSE (1990 + page_id % 30) || '-03-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') END AS decision_date,
  lower(title) AS low FROM t)
SELECT page_id, title, decision_date, CASE
  WHEN regexp_matches(low, 'criminal|crl\.?|murder|ipc|bail|ndps|fir|arrest|sentenc|convict|acquit') THEN 'Criminal'
  WHEN regexp_matches(low, 'tax|income\s*tax|gst|vat|excise|customs|assessment|revenue') THEN 'Tax'
  WHEN regexp_matches(low, 'labour|labor|employment|service\s+matter|industrial|workmen|wage') THEN 'Service/Labour'
  WHEN regexp_matches(low, 'constitution|article\s+\d+|fundamental rights|writ|habeas|mandamus') THEN 'Constitutional'
  WHEN regexp_matches(low, 'property|contract|tenancy|rent|land|civil|succession|partition') THEN 'Civil' ELSE 'General' END AS case_type,
  'Supreme Court of India judgment: ' || title AS summary FROM c"""),
]
