"""Matching texts with a table of rules of any number of rows.

``match_rule_table`` ships rules in blocks to the texts (see ``rule_scan``). ``term_hits`` gives the pairs of a
text and a term themselves, and ``_best_rules`` the best rules of such pairs, by joins.

A term without white space lies inside one unit, a run of a text without white space, so terms are looked
for in the distinct units of all texts, and a text has the terms of its units. There, a term can only lie in a
unit that holds all its q-grams, so it is filed under the gram that fewest units hold. A term with white
space is looked for in texts that hold the characters around its first blank, if all its parts lie in units.

Of rules with the same terms only the earliest counts. A rule with one hit can only win as the best rule of
that term; one with more is found by a term that is not its most frequent one. Nothing is collected; rules
and texts meet in joins that Spark may broadcast when the rules turn out to be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators.rule_scan import best_rules
from docketry.plans.tables import stored

GRAM = 3
# Characters of a term's parts that are looked at on both sides of its first blank
AROUND = 2
BLANK = r"\x20\t-\r"
RULE_FIELDS = ["ord", "sections", "domain", "severity", "public_risk"]


def grams(text: Column, size: int) -> Column:
    """Distinct pieces of ``size`` characters; a text has one empty piece."""
    if size == 0:
        return F.array(F.lit(""))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def rule_terms(rules: DataFrame) -> DataFrame:
    """``ord, term, times``: lower-cased terms, a repeated one counted as often as it is listed."""
    terms = rules.select("ord", F.explode("terms").alias("term")).where("term is not null")
    return terms.groupBy("ord", F.lower("term").alias("term")).agg(F.count(F.lit(1)).alias("times"))


def _filed(terms: DataFrame, text_grams: DataFrame, size: int) -> DataFrame:
    """``term, gram``: the gram of each term that fewest units hold. A term with a gram that no unit holds is left out."""
    pieces = terms.select(
        "term", F.explode(F.when(F.length("term") >= size, grams(F.col("term"), size)).otherwise(F.array("term"))).alias("gram"))
    counts = text_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    return pieces.join(counts, "gram", "left").groupBy("term").agg(
        F.min(F.struct("texts", "gram")).alias("rarest"), F.count(F.when(F.col("texts").isNull(), 1)).alias("absent")).where(
        "absent = 0").select("term", F.col("rarest.gram").alias("gram"))


def _inside(text: Column, term: Column, match: str) -> Column:
    if match == "substring":
        return F.contains(text, term)
    return F.rlike(text, F.concat(F.lit(X.EDGE_L + r"\Q"), term, F.lit(r"\E" + X.EDGE_R)))


def _unit_hits(units: DataFrame, terms: DataFrame, size: int) -> DataFrame:
    """``unit, term`` for every term, none of them empty, that lies in a unit."""
    pieces = F.when(F.length("term") >= size, grams(F.col("term"), size)).otherwise(F.array("term"))
    wanted = stored(terms.select(F.explode(pieces).alias("gram")).distinct(), "term-grams")
    sizes = sorted({row[0] for row in wanted.select(F.length("gram")).distinct().collect()})
    if not sizes:
        return units.limit(0).withColumn("term", F.lit(""))
    held = X.exploded(units, F.concat(*[grams(F.col("unit"), n) for n in sizes]), ["gram"], ["unit"])
    unit_grams = stored(held.join(wanted, "gram", "left_semi"), "unit-grams")
    return unit_grams.join(_filed(terms, unit_grams, size), "gram").where(F.contains("unit", "term")).select("unit", "term")


def _around(before: int, after: int) -> str:
    return f"[^{BLANK}]{{{before}}}[{BLANK}][^{BLANK}]{{{after}}}"


def _spanning_hits(low: DataFrame, terms: DataFrame, key: str, match: str) -> DataFrame:
    """``key, term`` for terms with white space, filed under the characters around their first blank."""
    before = F.regexp_extract("term", f"^([^{BLANK}]*)", 1)
    after = F.regexp_extract("term", f"^[^{BLANK}]*[{BLANK}]([^{BLANK}]*)", 1)
    ends = terms.select(
        "term", F.least(F.length(before), F.lit(AROUND)).alias("before"), F.least(F.length(after), F.lit(AROUND)).alias("after"),
        F.length(before).alias("at"))
    filed = stored(ends.select(
        "term", "before", "after",
        F.substring("term", F.col("at") - F.col("before") + 1, F.col("before") + F.col("after") + 1).alias("gram")), "crossings")
    shapes = sorted((r[0], r[1]) for r in filed.select("before", "after").distinct().collect())
    if not shapes:
        return low.select(key).limit(0).withColumn("term", F.lit(""))
    found = F.concat(*[
        F.array_distinct(F.regexp_extract_all("__low", F.lit(f"(?s)(?=({_around(*shape)}))."), F.lit(1))) for shape in shapes])
    lists = X.exploded(low, found, ["gram"], [key]).join(filed, "gram").groupBy(key).agg(F.collect_list("term").alias("__terms"))
    return X.exploded(low.join(lists, key), F.filter("__terms", lambda t: _inside(F.col("__low"), t, match)), ["term"], [key])


def term_hits(texts: DataFrame, terms: DataFrame, key: str, column: str = "text", match: str = "substring",
              size: int = GRAM) -> DataFrame:
    """``key, term`` for every distinct term of ``terms`` that lies in a text. ``match='word'`` asks for whole words.

    ``key`` is unique in ``texts``.
    """
    parts = F.filter(F.split("term", f"[{BLANK}]+"), lambda p: p != "")
    single = stored(
        terms.select("term").distinct().select("term", parts.alias("parts"), F.rlike("term", F.lit(f"[{BLANK}]")).alias("spanning")), "terms")
    low = texts.select(key, F.lower(X.blank(column)).alias("__low"))
    units = X.exploded(low, F.array_distinct(F.split("__low", f"[{BLANK}]+")), ["unit"], [key]).where("unit != ''")
    wanted = single.select(F.explode("parts").alias("term")).distinct()
    found = stored(_unit_hits(stored(units.select("unit").distinct(), "units"), wanted, size), "unit-hits")

    whole = found.join(single.where("not spanning").select("term"), "term", "left_semi")
    if match != "substring":
        whole = whole.where(_inside(F.col("unit"), F.col("term"), match))
    lists = whole.groupBy("unit").agg(F.collect_list("term").alias("terms"))
    inside = units.join(lists, "unit").select(key, F.explode("terms").alias("term")).distinct()

    seen = found.select(F.col("term").alias("part")).distinct()
    missing = single.where("spanning").select("term", F.explode("parts").alias("part")).join(seen, "part", "left_anti").select("term")
    spanning = single.where("spanning").select("term").join(missing, "term", "left_anti")
    empty = low.join(single.where("term = ''").select("term"), _inside(F.col("__low"), F.col("term"), match)).select(key, "term")
    return inside.unionByName(_spanning_hits(low, spanning, key, match)).unionByName(empty)


def _earliest(terms: DataFrame) -> DataFrame:
    """The terms of the rules that have no earlier rule with the same terms."""
    lists = terms.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("term", "times"))).alias("listed"))
    return lists.groupBy("listed").agg(F.min("ord").alias("ord")).select("ord", F.inline("listed"))


def _best_rules(hits: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``key, best`` with ``best`` = (hits, -ord) of the rule with most hits, the earliest on ties."""
    live = stored(terms.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("texts")), "term"), "live-terms")
    back = (-F.col("ord")).alias("back")
    alone = live.groupBy("term").agg(F.max(F.struct(F.col("times").alias("n"), back)).alias("best"))
    most = live.groupBy("ord").agg(F.max(F.struct("texts", "term", "times")).alias("most"))
    rarer = live.join(most, "ord").where("term != most.term").select(
        "ord", "term", "times", F.col("most.term").alias("top"), F.col("most.times").alias("top_times"))
    some = hits.join(rarer, "term").groupBy(key, "ord", "top", "top_times").agg(F.sum("times").alias("n"))
    topped = some.join(hits.select(key, F.col("term").alias("top"), F.lit(True).alias("held")), [key, "top"], "left").select(
        key, F.struct((F.col("n") + F.when(F.col("held"), F.col("top_times")).otherwise(0)).alias("n"), back).alias("best"))
    return hits.join(alone, "term").select(key, "best").unionByName(topped).groupBy(key).agg(F.max("best").alias("__best"))


def match_rule_table(texts: DataFrame, rules: DataFrame, key: str, column: str = "text", match: str = "substring",
                     default: dict | None = None) -> DataFrame:
    """Add ``rule`` and ``rule_hits``: the rule with most term hits, the earliest on ties, or ``default``.

    ``rules`` has unique ``ord``. Texts without a hit, null and empty texts get the default.
    """
    default = default or {"ord": None, "sections": [], "domain": "Criminal", "severity": "Medium", "public_risk": False}
    terms = stored(_earliest(rule_terms(rules)), "rule-terms")
    chosen = best_rules(texts, terms, key, column, match).select(
        key, F.col("n").cast("int").alias("rule_hits"), F.col("ord").cast("int").alias("ord"))
    rule = F.struct(
        F.col("ord").cast("int").alias("ord"), F.col("sections").cast("array<string>").alias("sections"), F.col("domain"),
        F.col("severity"), F.col("public_risk").cast("boolean").alias("public_risk"))
    told = chosen.join(rules.select(*RULE_FIELDS), "ord").select(key, rule.alias("rule"), "rule_hits")
    none = F.struct(
        F.lit(default["ord"]).cast("int").alias("ord"),
        F.array(*[F.lit(s) for s in default["sections"]]).cast("array<string>").alias("sections"), F.lit(default["domain"]).alias("domain"),
        F.lit(default["severity"]).alias("severity"), F.lit(bool(default["public_risk"])).alias("public_risk"))
    return texts.join(told, key, "left").select(
        *[texts[c] for c in texts.columns], F.coalesce("rule", none).alias("rule"), F.coalesce("rule_hits", F.lit(0)).alias("rule_hits"))
