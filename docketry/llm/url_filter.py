"""URL filters: given host rules, and association rules mined from labelled URLs.

Spark's FP-growth mines combinations of URL tokens that occur with bad labels. Rules with
enough support and confidence block; they are matched by an inverted index: a rule is
filed under its rarest token, meets the URLs that have this token, and fits those that
have all of its tokens. URLs without a fitting rule are allowed.

Null and empty URLs have no tokens and are allowed. Repeated URLs get equal verdicts.
Without labelled URLs, or with fewer than the least number, nothing is mined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.plans.tables import stored

BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRules:
    least: int = 5             # labelled URLs with all of a rule's tokens and a bad label, whatever the table's size
    support: float | None = None   # a share of the labelled URLs in place of that number
    confidence: float = 0.6


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct(size, rule, verdict)`` of the longest of ``(verdict, host, path)`` rules that fits, or null."""
    fits = []
    for verdict, own, prefix in rules:
        inside = (host == own) | host.endswith("." + own)
        fits.append(F.when(inside & path.startswith(prefix), F.struct(
            F.lit(len(own + prefix)).alias("size"), F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, domain, path segments (numbers as ``#``), parameters."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shapes = F.transform(segments, lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]*)"), F.lit(1)),
                        lambda x: F.concat(F.lit("arg="), x))
    scheme = F.concat(F.lit("scheme="), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    parts = F.concat(
        F.array(scheme, F.concat(F.lit("domain="), domain)),
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("host="), x)), shapes, names)
    return F.when(host != "", F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, p: UrlRules = UrlRules()) -> DataFrame:
    """``items, confidence, support``: pruned rules ``items -> bad`` from ``labelled`` (url, bad)."""
    rows = labelled.toDF("url", "bad").where("url is not null and bad is not null")
    baskets = rows.select(F.when(F.col("bad"), F.concat(tokens(F.col("url")), F.array(F.lit(BAD)))).otherwise(
        tokens(F.col("url"))).alias("items")).where(F.size("items") > 0)
    baskets = stored(baskets, "url-baskets")
    n = baskets.count()
    if not n or p.support is None and n < p.least:
        return baskets.select("items", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)
    # FPGrowth rounds share times rows up: half a row less gives the number itself.
    share = min((p.least - 0.5) / n, 1.0) if p.support is None else p.support
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=p.confidence).fit(baskets)
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support")


def learned(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, fit``: for every distinct URL that a rule fits, its best rule (confidence, support, tokens)."""
    rules = stored(rules, "url-rules")
    used = rules.select(F.explode("items").alias("token")).distinct()
    own = urls.toDF("url").where("url is not null").distinct().withColumn("has", tokens(F.col("url")))
    # Rarest token by its number of URLs; only tokens that rules use are counted.
    counts = own.select(F.explode("has").alias("token")).join(used, "token", "left_semi").groupBy("token").agg(
        F.count("*").alias("n"))
    filed = rules.select(F.posexplode("items").alias("no", "token"), "items", "confidence", "support").join(counts, "token")
    whole = filed.groupBy("items", "confidence", "support").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"), F.count("*").alias("found")).where(
        F.col("found") == F.size("items"))
    index = stored(whole.select("token", "items", "confidence", "support"), "url-index")
    met = own.select("url", "has", F.explode("has").alias("token")).join(index, "token").where(
        F.size(F.array_except("items", "has")) == 0)
    return met.groupBy("url").agg(F.max(F.struct("confidence", "support", "items")).alias("fit"))


def judge(pages: DataFrame, rules: DataFrame, given: list[tuple[str, str, str]]) -> DataFrame:
    """``id, host, path, rule, verdict, learned, confidence`` for every row of ``pages`` (two columns: id, url)."""
    pages = pages.toDF("id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    fits = learned(pages.select("url"), rules).withColumnRenamed("url", "__url")
    joined = pages.withColumn("given", given_rule(F.col("host"), F.col("path"), given)).join(
        fits, F.col("url") == F.col("__url"), "left")
    return joined.select(
        "id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", F.when(F.col("fit").isNotNull(), "block"), F.lit("allow")).alias("verdict"),
        F.array_join("fit.items", " ").alias("learned"), F.col("fit.confidence").alias("confidence"))
