"""Checked queries: a Spark job over the given tables and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docketry.plans.sizing import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@dataclass(frozen=True)
class Check:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A text table with at least one task per core."""
    return spread(table(spark, sf_dir, name))


# SQL fragments. ``{x}`` is the expression they apply to.
WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WS_NUL = WS[:-1] + r"\x{00}]"


def fill(template: str, **parts: str) -> str:
    """Put fragments in place of ``<<name>>``."""
    for key, value in parts.items():
        template = template.replace(f"<<{key}>>", value)
    return template


def sq(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS_NUL}+', ' ', 'g'))"


def trim_ws(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def count_in(x: str, terms) -> str:
    return " + ".join(f"(contains({x}, '{t}'))::INT" for t in terms)


def first_case(x: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{label}'" for label, p in rules)
    return f"CASE {whens} ELSE {default} END"
