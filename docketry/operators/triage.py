"""Intake triage: type, severity, risks, priority; rule matching; manual overrides."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import facets as A
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators.rules import match_rule_table
from docketry.plans.tables import stored

# fixed values: bases, weights, limits
BAIL_BASE, ESCAPE_BASE = 18, 12
BAIL_CRIMINAL, ESCAPE_CRIMINAL = 10, 8
BAIL_SEVERITY = {"Critical": 18, "High": 12, "Medium": 6, "Low": 0}
ESCAPE_SEVERITY = {"Critical": 18, "High": 12, "Medium": 4, "Low": 0}
TYPE_WEIGHT = {"Criminal": 42, "Civil": 26, "Specialized Cases": 34}
SEVERITY_WEIGHT = {"Low": 12, "Medium": 24, "High": 36, "Critical": 48}
LITE_TYPE_WEIGHT = {"Criminal": 40, "Civil": 20, "Specialized Cases": 30}
LITE_SEVERITY_WEIGHT = {"Low": 10, "Medium": 25, "High": 40, "Critical": 55}
MANUAL_TYPE_WEIGHT = {"Criminal": 35, "Civil": 22, "Specialized Cases": 28}
MANUAL_RISKS = {"Critical": (84, 78, 82), "High": (68, 62, 64), "Medium": (48, 38, 43), "Low": (28, 18, 24)}


def lookup(c: Column, values: dict[str, int], default: int = 0) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(default)


def _factors(c: Column, prefix: str, weighted: Iterable[tuple[str, int]]) -> list[Column]:
    return [F.when(c.contains(t), F.lit(f"{prefix} signal: {t}")) for t, _ in weighted]


def triage(texts: DataFrame, rules: L.TriageRules = L.TriageRules(), column: str = "text") -> DataFrame:
    """Add case type, severity, bail / escape / blended risk, factors, priority and band.
    One narrow pass, all in generated code except the factor list."""
    low = F.lower(X.blank(column))
    typed = texts.withColumn("case_type", X.first_rule(low, rules.types, rules.default_type)).withColumn(
        "severity", A.by_contained(column, rules.severity, "Low")
    )
    kind, severity = F.col("case_type"), F.col("severity")
    bail = F.lit(BAIL_BASE) + F.when(kind == "Criminal", BAIL_CRIMINAL).otherwise(0) + lookup(severity, BAIL_SEVERITY)
    escape = (
        F.lit(ESCAPE_BASE) + F.when(kind == "Criminal", ESCAPE_CRIMINAL).otherwise(0)
        + lookup(severity, ESCAPE_SEVERITY)
    )
    factors = F.array_compact(
        F.array(
            *_factors(low, "bail", rules.bail), *_factors(low, "escape", rules.escape),
            F.when(severity == "Critical", "critical offense severity"),
            F.when(severity == "High", "high offense severity"),
        )
    )
    risky = typed.select(
        "*",
        X.clamp(bail + X.sum_contains(low, rules.bail), 10, 99).cast("int").alias("bail_risk"),
        X.clamp(escape + X.sum_contains(low, rules.escape), 10, 99).cast("int").alias("escape_risk"),
        factors.alias("risk_factors"),
    )
    weighted = (
        F.lit(0.34) * lookup(kind, TYPE_WEIGHT) + F.lit(0.3) * lookup(severity, SEVERITY_WEIGHT)
        + F.lit(0.18) * F.col("bail_risk") + F.lit(0.18) * F.col("escape_risk")
    )
    blend = F.col("bail_risk") * 0.55 + F.col("escape_risk") * 0.45
    return risky.select(
        "*",
        X.clamp(X.round_half_up(F.round(blend, 6)), 10, 99).cast("int").alias("risk"),
        X.clamp(X.round_half_up(F.round(weighted, 6)), 20, 99).cast("int").alias("priority_score"),
    ).select("*", A.band("priority_score").alias("priority_band"), judge_category("case_type").alias("category"))


def rationale() -> Column:
    """One sentence on the triage columns."""
    # fixed values: the sentence's parts
    factors = F.when(
        F.size("risk_factors") > 0,
        F.concat(F.lit("Risk factors: "), F.array_join(F.slice("risk_factors", 1, 3), ", "), F.lit(".")),
    ).otherwise("No explicit bail or flight-risk markers detected.")
    return F.concat(
        F.lit("Priority derived from "), F.lower("case_type"), F.lit(" classification, "), F.lower("severity"),
        F.lit(" severity, bail risk "), F.col("bail_risk"), F.lit(", and escape risk "), F.col("escape_risk"),
        F.lit(". "), factors,
    )


def judge_category(case_type: X.ColumnLike) -> Column:
    c = X.col(case_type)
    return F.when(c.isin("Criminal", "Civil"), c).otherwise("Other")


def triage_lite(texts: DataFrame, rules: L.LiteTriageRules = L.LiteTriageRules(), column: str = "text",
                type_hint: str | None = None, score_hint: str | None = None) -> DataFrame:
    """The lighter routing signals. ``type_hint`` / ``score_hint`` name optional columns: a
    given type replaces the derived one, a given score can only raise the priority."""
    low = F.lower(X.blank(column))
    derived = F.when(X.any_contains(low, rules.criminal), "Criminal").otherwise("Civil")
    severity = A.by_contained(
        column, [("Critical", rules.critical), ("High", rules.high), ("Medium", rules.medium)], "Low"
    )
    kind = F.coalesce(F.nullif(F.col(type_hint), F.lit("")), derived) if type_hint else derived
    out = texts.select("*", derived.alias("__derived"), kind.alias("case_type"), severity.alias("severity"))
    critical = F.col("severity") == "Critical"
    out = out.select(
        "*",
        (F.lit(20) + F.when(F.col("__derived") == "Criminal", 15).otherwise(0) + F.when(critical, 30).otherwise(0)).alias("bail_risk"),
        (F.lit(10) + F.when(critical, 40).otherwise(0)).alias("escape_risk"),
        F.when(low.contains(rules.abscond), F.array(F.lit("absconding risk"))).otherwise(
            F.array().cast("array<string>")
        ).alias("risk_factors"),
    ).drop("__derived")
    out = out.withColumn("risk", X.round_half_up((F.col("bail_risk") + F.col("escape_risk")) / 2))
    score = F.least(
        F.lit(99.0),
        lookup(F.col("case_type"), LITE_TYPE_WEIGHT) + lookup(F.col("severity"), LITE_SEVERITY_WEIGHT)
        + F.col("risk") * 0.1,
    )
    if score_hint:
        score = F.greatest(score, F.coalesce(F.col(score_hint).cast("double"), F.lit(0.0)))
    return out.withColumn("priority_score", F.round(score, 6)).withColumn("priority_band", A.band("priority_score"))


def match_rules(texts: DataFrame, rules: DataFrame | Sequence[dict], column: str = "text", match: str = "substring",
                default: dict | None = None, key: str | None = None) -> DataFrame:
    """Add ``rule``: the rule with most term hits in the text, the earliest on ties.

    Rules (``ord, terms, sections, domain, severity, public_risk``) given as a list become
    one expression: the text is scanned where it lies, nothing is joined. A table of rules
    of any number is matched by joins (see ``rules.match_rule_table``); ``key`` names a
    unique column of the texts, without one they are written with a number first. Terms are
    lower-cased. ``match='word'`` asks for whole words.
    """
    if isinstance(rules, DataFrame):
        if key is not None:
            return match_rule_table(texts, rules, key, column, match, default)
        numbered = stored(texts.withColumn("__key", F.monotonically_increasing_id()), "texts")
        return match_rule_table(numbered, rules, "__key", column, match, default).drop("__key")
    default = default or {
        "ord": None, "sections": [], "domain": "Criminal", "severity": "Medium", "public_risk": False,
    }
    low = F.lower(X.blank(column))

    def hits(terms: Sequence[str]) -> Column:
        lowered = [t.lower() for t in terms]
        if match == "substring":
            return X.count_contains(low, lowered)
        parts = [low.rlike(X.word_re(r"\Q" + t + r"\E")).cast("int") for t in lowered]
        return sum(parts[1:], parts[0]) if parts else F.lit(0)

    def as_rule(r: dict) -> Column:
        return F.struct(
            F.lit(r["ord"]).cast("int").alias("ord"),
            F.array(*[F.lit(s) for s in r["sections"]]).cast("array<string>").alias("sections"),
            F.lit(r["domain"]).alias("domain"), F.lit(r["severity"]).alias("severity"),
            F.lit(bool(r["public_risk"])).alias("public_risk"),
        )

    ordered = sorted(rules, key=lambda r: r["ord"])
    scored = F.array(*[F.struct(hits(r["terms"]).alias("n"), F.lit(-i).alias("back")) for i, r in enumerate(ordered)])
    with_best = texts.withColumn("__best", F.array_max(scored))
    chosen = F.element_at(F.array(*[as_rule(r) for r in ordered]), F.lit(1) - F.col("__best.back"))
    return with_best.select(
        *texts.columns,
        F.when(F.col("__best.n") > 0, chosen).otherwise(as_rule(default)).alias("rule"),
        F.col("__best.n").alias("rule_hits"),
    )


def rule_priority(matched: DataFrame, column: str = "text") -> DataFrame:
    """Score and level from the matched rule, with bail, minor and woman modifiers."""
    severity, domain, risk = F.col("rule.severity"), F.col("rule.domain"), F.col("rule.public_risk")
    top = (severity == "Critical") | risk
    middle = (domain == "Civil") | (severity == "Medium")
    base = (
        F.when(top, F.when(severity == "Critical", 92).otherwise(82)).when(severity == "High", 72)
        .when(middle, F.when(domain == "Civil", 48).otherwise(55)).otherwise(22)
    )
    level = F.when(top | (severity == "High"), "HIGH").when(middle, "MEDIUM").otherwise("LOW")
    low = F.lower(X.blank(column))
    modifiers = (
        F.when(low.contains("bail") & (level != "LOW"), 5).otherwise(0)
        + F.when(X.any_contains(low, ["child", "minor"]), 8).otherwise(0)
        + F.when(X.any_contains(low, ["woman", "female"]), 4).otherwise(0)
    )
    return matched.select("*", F.least(F.lit(100), base + modifiers).alias("rule_score"), level.alias("rule_level"))


def override_scores(overrides: DataFrame) -> DataFrame:
    """Scores of a manual type / severity choice."""
    kind, severity = F.col("case_type"), F.col("severity")
    score = X.clamp(lookup(kind, MANUAL_TYPE_WEIGHT) + lookup(severity, SEVERITY_WEIGHT), 20, 99).cast("int")
    risks = [lookup(severity, {k: v[i] for k, v in MANUAL_RISKS.items()}, MANUAL_RISKS["Low"][i]) for i in range(3)]
    return overrides.select(
        "*", score.alias("priority_score"), risks[0].alias("bail_risk"), risks[1].alias("escape_risk"),
        risks[2].alias("risk"),
    ).select(
        "*", A.band("priority_score").alias("priority_band"),
        F.array(
            F.concat(F.lit("manual override: "), kind), F.concat(F.lit("manual severity: "), severity)
        ).alias("risk_factors"),
    )
