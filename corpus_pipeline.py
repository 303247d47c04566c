"""From raw documents to packed training sequences, one written table per stage.

Every stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``;
texts that a stage changes get their new ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import language, near_dedup, packing, pii, suffix_dedup
from docketry.llm.queries import Query, ready, table, tokenizer
from docketry.plans.tables import stored

# Language ID rejects texts without letters, and those that no learned language explains at all.
LEAST_SCORE = 0.05


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a text in a known language. Where no row has a language, any letter will do."""
    ready(spark)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))).select("lang", "text", "doc_id"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = language.predict(docs, model, language="__language", score="__score")
    kept = told.where((F.col("__language") != language.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    ready(spark)
    return near_dedup.keep_one(docs, near_dedup.NearDedup())


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of smallest id only; emptied documents go."""
    ready(spark)
    found = suffix_dedup.repeated_passages(docs.select("doc_id", "text"))
    return _counted(suffix_dedup.cut_repeats(docs, found))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced."""
    ready(spark)
    return _counted(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    ready(spark)
    packed = packing.packed_documents(docs.select("doc_id", "text"), tokenizer("byte_bpe_50k.json"), digest=True)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("sanitise", sanitise),
    ("pack", pack),
]
# Kernel scores, banded components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = [Query("pipeline", run, ORACLE_SQL)]
