"""Corpus files: CSV and JSON in, Parquet / JSON / CSV out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import schemas as S
from docketry.functions import dates as D
from docketry.functions import enrich as E
from docketry.functions import text as X
from docketry.plans.ordinal import with_ordinal


def header_name(name: str) -> str:
    """Lower case, other characters to one underscore, none at the ends."""
    return re.sub(r"^_+|_+$", "", re.sub(r"[^a-z0-9]+", "_", name.strip().lower()))


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_name(c) for c in df.columns])


def read_cases_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Quoted CSV with any header; values trimmed, rows without content dropped.

    A quoted line break needs ``multi_line``, which keeps one file in one task. Pass
    False for large files without such breaks, so that they are split.
    """
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )
    named = normalize_columns(raw)
    trimmed = named.select([X.trim_wide(F.col(c)).alias(c) for c in named.columns])
    return trimmed.filter(F.exists(F.array(*trimmed.columns), lambda v: v != ""))


def read_cases_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of records, or JSON Lines (``lines=True``), which splits at scale."""
    return spark.read.schema(S.RAW_CASE).option("multiLine", not lines).json(path)


def write_cases(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Parquet by default; CSV quotes cells holding a quote, comma or line break."""
    out = df.select(*[F.col(c) for c in S.RAW_CASE_FIELDS if c in df.columns]) if fmt == "csv" else df
    writer = out.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').option(
            "emptyValue", ""
        ).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.parquet(path)


def import_records(records: DataFrame, ord_column: str | None = None, summary_chars: int | None = 120) -> DataFrame:
    """Judgment-table rows to raw cases with a dense ingest ordinal ``ord`` and ids that follow it.

    Rows are numbered in the order of ``ord_column`` or, without it, of the reader; those
    without title or body are dropped after that. ``summary_chars`` of the issues go into
    the summary, all with None.
    """
    if ord_column is None:
        records, ord_column = records.withColumn("__read", F.monotonically_increasing_id()), "__read"
    records = with_ordinal(records, [F.col(ord_column), *[F.col(c) for c in records.columns if c != ord_column]], "__ord")
    order, number = F.col("__ord"), (F.col("__ord") + 1).cast("string")
    title, issues = X.trim_wide("case_title"), X.trim_wide("issues")
    kind = E.case_type(F.concat_ws(" ", title, issues))
    lead = F.when((issues != "") & ~F.lower(issues).contains("section"), issues if summary_chars is None else F.substring(issues, 1, summary_chars))
    body = F.concat_ws(" ", *[X.blank(c) for c in ("judges_name_s", "issues", "decision", "cited_cases")])
    # Told by the first sign of the body, which is not squashed for it.
    return records.filter((F.length(title) > 0) & body.rlike(f"[^{X.SPACE_CLASS}\\u0000]")).select(
        order.cast("bigint").alias("ord"),
        F.concat(F.lit("IN-SC-"), F.when(F.length(number) >= 6, number).otherwise(F.lpad(number, 6, "0"))).alias("case_id"),
        title.alias("title"),
        F.lit("Supreme Court of India").alias("court"),
        F.lit("India").alias("jurisdiction"),
        D.decision_date("date_of_judgment").alias("decision_date"),
        X.trim_wide("citation").alias("citation"),
        kind.alias("case_type"),
        F.concat_ws(". ", title, F.concat(kind, F.lit(" case")), lead).alias("summary"),
        E.squashed(body).alias("full_text"),
        F.lit("").alias("source_url"),
        F.lit("import").alias("source_name"),
    )
