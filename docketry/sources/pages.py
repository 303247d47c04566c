"""Stored listing pages: links, absolute addresses, case records, page expansion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import dates as D
from docketry.functions import enrich as E
from docketry.functions import text as X


@dataclass(frozen=True)
class LinkRules:
    """Path shapes of a site. Each pattern is a regex for the inside of ``href``."""

    # fixed values: link shapes
    fragment: str = r"/docfragment/([0-9]+)/?[^\"']*"
    document: str = r"/doc/[0-9]+/?[^\"']*"
    browse: str = r"/browse/supremecourt/[^\"'#]*"
    search: str = (
        r"/search/\?formInput=[^\"'#]*(?:doctypes:supremecourt|doctypes%3A%20supremecourt|"
        r"doctypes%3Asupremecourt)[^\"'#]*"
    )
    skip_label: str = r"(?i)^full\s+document$"
    base: str = "https://example.org/browse/"


def _anchor(href: str) -> str:
    return rf"(?i)<a[^>]*href=[\"']({href})[\"'][^>]*>([\s\S]*?)</a>"


def document_links(pages: DataFrame, rules: LinkRules = LinkRules()) -> DataFrame:
    """``page_id, no, href, label``: fragment anchors first, then document anchors,
    each in page order."""

    def anchors(pattern: str, part: int, label: int) -> Column:
        regex = F.lit(_anchor(pattern))
        return F.arrays_zip(
            F.regexp_extract_all("html", regex, F.lit(part)).alias("href"),
            F.regexp_extract_all("html", regex, F.lit(label)).alias("label"),
        )

    # The fragment pattern has one group of its own, the document number.
    fragments = F.transform(
        anchors(rules.fragment, 2, 3),
        lambda a: F.when(
            X.markup_text(a["href"]) != "",
            F.struct(
                F.concat(F.lit("/doc/"), X.markup_text(a["href"]), F.lit("/")).alias("href"),
                X.markup_text(a["label"]).alias("label"),
            ),
        ).otherwise(F.struct(F.lit("").alias("href"), F.lit("").alias("label"))),
    )
    documents = F.filter(
        F.transform(
            anchors(rules.document, 1, 2),
            lambda a: F.struct(X.markup_text(a["href"]).alias("href"), X.markup_text(a["label"]).alias("label")),
        ),
        lambda a: ~a["label"].rlike(rules.skip_label),
    )
    both = F.filter(F.concat(fragments, documents), lambda a: (a["href"] != "") & (a["label"] != ""))
    return X.exploded(pages, both, ["no", "a"], ["page_id"], positions=True).select(
        "page_id", "no", F.col("a.href").alias("href"), F.col("a.label").alias("label")
    )


def absolute_url(href: Column, base: str) -> Column:
    """Resolve a root-relative address against the host of ``base``."""
    scheme, rest = base.split("://", 1)
    return F.when(href.rlike("^[a-z]+://"), href).otherwise(
        F.concat(F.lit(f"{scheme}://{rest.split('/', 1)[0]}"), href)
    )


def listing_links(pages: DataFrame, kind: str = "browse", rules: LinkRules = LinkRules()) -> DataFrame:
    """Distinct listing addresses per page, in order of first appearance."""
    pattern = rf"(?i)href=[\"']({getattr(rules, kind)})[\"']"
    hrefs = F.array_distinct(
        F.filter(F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), lambda h: F.trim(h)), lambda h: h != "")
    )
    return X.exploded(pages, hrefs, ["no", "href"], ["page_id"], positions=True).select(
        "page_id", "no", absolute_url(F.col("href"), rules.base).alias("url")
    )


def unseen_links(links: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """First appearance of each address over all pages, minus those already seen.

    ``min_by`` combines before the shuffle: an address linked from a third of the
    pages costs one row per task.
    """
    first = links.groupBy("href").agg(
        F.min(F.struct("page_id", "no", "label")).alias("f")
    ).select("href", "f.page_id", "f.no", "f.label")
    return first if seen is None else first.join(seen.select("href"), "href", "left_anti")


def links_to_cases(links: DataFrame) -> DataFrame:
    """Listing labels to raw cases; a trailing `` on 5 March, 2020`` becomes the date."""
    tail = rf"(?i){X.SPACE}+on{X.SPACE}+([0-9]{{1,2}}{X.SPACE}+[A-Za-z]+,{X.SPACE}*[0-9]{{4}}){X.SPACE}*$"
    return (
        links.withColumn("__label", X.markup_text("label"))
        .withColumn("__date", F.regexp_extract("__label", tail, 1))
        .withColumn(
            "title",
            F.when(F.col("__date") != "", X.trim_wide(F.regexp_replace("__label", tail, ""))).otherwise(F.col("__label")),
        )
        .select(
            *[c for c in links.columns],
            "title",
            F.lit("Supreme Court of India").alias("court"),
            F.lit("India").alias("jurisdiction"),
            F.when(F.col("__date") == "", "").otherwise(
                D.decision_date(F.regexp_replace("__date", rf",{X.SPACE}*", ", "))
            ).alias("decision_date"),
            F.lit("").alias("citation"),
            E.case_type("title").alias("case_type"),
            F.concat(F.lit("Supreme Court of India judgment: "), F.col("title")).alias("summary"),
            F.concat(F.col("title"), F.lit(". Judgment of the Supreme Court of India.")).alias("full_text"),
        )
    )


def expand_page_urls(urls: DataFrame, n: int, column: str = "url") -> DataFrame:
    """Each listing address once per page number: the first page as it is, later ones
    with a page parameter."""
    glue = F.when(F.col(column).contains("?"), "&").otherwise("?")
    return urls.withColumn("page_num", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "page_url",
        F.when(F.col("page_num") == 0, F.col(column)).otherwise(
            F.concat(F.col(column), glue, F.lit("pagenum="), F.col("page_num"))
        ),
    )
