"""Chunk index: windows of words, token counts, hashed vectors, document frequencies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.plans import tokens as W

FEATURES = (
    "tokens array<string>, counts array<int>, first array<smallint>, second array<smallint>, length int, norm double"
)
# fixed values: window, overlap, minimum length, weight of the second hash
CHUNK_WORDS = 110
CHUNK_OVERLAP = 24
CHUNK_MIN_CHARS = 60
SECOND_WEIGHT = 0.45
# ``ord`` of a chunk = case ordinal (41 bits), then section (2), then position in the section (20)
SECTION_SHIFT = 1 << 20
CASE_SHIFT = 1 << 22
MOST_CASES = 1 << 41

CHUNK_SCRUB = [
    # fixed values: passes in order
    (r"(?i)" + X.EDGE_L + r"(?:section\s+\d+[a-z]?\s+(?:of\s+)?[\w\s]{0,30}(?:act|code|cpc|crpc)\s*[;,]?)", ""),
    (r"(?i)(?<![A-Za-z0-9_])order\s+[ivxlcdm\d]+\s+rule\s+\d+", ""),
    (r"(?i)(?<![A-Za-z0-9_])filter\s*:\s*[\w\s]+", ""),
    (r"(?i)case title extracted from cited[- ]cases metadata:?[^.;]*", ""),
    (r"(?i)https?://\S+", ""),
    (r"(?im)^(title|source|judges?|issues?|decision|citation)\s*:", ""),
    (r"(?i)section\s+\d+[a-z]?\s+in\s+the\s+[^;.]+[;.]", ""),
    (r"\{[^}]*\}", " "),
    (r"\[[^\]]*\]", " "),
    (r"(?i)\(cid:[^)]+\)", " "),
    (r"(?m)Judges:.*$", ""),
    (f"{X.SPACE}+", " "),
    (r";+", ";"),
]


# fixed values: marks of text that the passes change.
# Text without any of these is left as it is by every pass, so plain prose skips them all.
SCRUB_MARKERS = r"(?i)[:;{\[]|section|rule|case title|\(cid"


@dataclass(frozen=True)
class ChunkRules:
    words: int = CHUNK_WORDS
    overlap: int = CHUNK_OVERLAP
    min_chars: int = CHUNK_MIN_CHARS
    stop: tuple = tuple(L.STOP_WORDS)
    prose: str = L.PROSE_MARKERS


def clean_chunk(c: X.ColumnLike, prose: str = L.PROSE_MARKERS) -> Column:
    """Boilerplate scrub; empty when fewer than 60 characters remain."""
    return X.let(
        X.squash(c),
        lambda t: F.when(t.rlike(SCRUB_MARKERS), _scrubbed(t, prose)).when(F.length(t) < 60, F.lit("")).otherwise(t),
    )


def _scrubbed(t: Column, prose: str) -> Column:
    listed = X.let(
        F.regexp_replace(t, r"(?i)decision\s*:\s*\d+", ""),
        lambda t: F.when(
            F.regexp_count(t, F.lit(";")) >= 2,
            F.array_join(
                F.filter(
                    F.transform(F.split(t, ";"), lambda p: X.trim_wide(p)),
                    lambda p: (F.length(p) > 40) & p.rlike(X.word_re(prose, True)),
                ),
                ". ",
            ),
        ).otherwise(t),
    )
    out = F.trim(X.scrub(listed, CHUNK_SCRUB))
    return X.let(out, lambda t: F.when(F.length(t) < 60, F.lit("")).otherwise(t))


# fixed values: marks of listings.
# Lower-cased pieces without which neither the scrub nor the metadata tests can apply.
PLAIN_MARKERS = [":", ";", "{", "[", "section", "rule", "case title", "(cid", "metadata", "extracted"]


def is_low_quality(c: X.ColumnLike, prose: str = L.PROSE_MARKERS, squashed: bool = False) -> Column:
    """Metadata-heavy text: lists, section dumps, too short, too few words.

    ``squashed`` says that white space is already single blanks, as in a chunk.
    """

    def too_thin(t: Column) -> Column:
        # Twelve words with three letters: each step runs from the letters to the end of the word.
        return (F.length(t) < 85) | ~t.rlike(r"(?s)^(?:(?>.*?[a-z]{3})[^ ]*+){12}")

    def listed(raw: Column) -> Column:
        return (
            (F.regexp_count(raw, F.lit(";")) >= 3)
            | raw.rlike(r"decision\s*:\s*\d")
            | (F.regexp_count(raw, F.lit(X.word_re("section"))) > 3)
        )

    def by_clean(t: Column) -> Column:
        markers = ["case title extracted", "cited-cases metadata", "extracted from cited"]
        prefixes = r"^(?:case title|title:|source:|judges:)|https?://"
        return (
            X.any_contains(t, markers) | t.rlike(prefixes) | t.rlike(r"^decision:\s*\d+\s*cited cases:") | too_thin(t)
        )

    source = X.blank(c) if squashed else X.squash(c)
    return X.let(
        F.lower(source),
        lambda raw: F.when(~X.any_contains(raw, PLAIN_MARKERS), too_thin(raw)).otherwise(
            listed(raw) | X.let(F.lower(clean_chunk(source, prose)), by_clean)
        ),
    )


def windows_of(c: X.ColumnLike, rules: ChunkRules = ChunkRules()) -> Column:
    """Overlapping word windows of a text, short ones dropped; stops at the window
    that reaches the end."""
    step = max(1, rules.words - rules.overlap)

    def cut(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - F.lit(rules.words)) / F.lit(step))).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.array_join(F.slice(w, k * F.lit(step) + 1, F.lit(rules.words)), " "),
        )

    parts = X.let(F.split(X.squash(c), " "), cut)
    return F.filter(parts, lambda p: F.length(p) >= rules.min_chars)


def references(c: X.ColumnLike) -> Column:
    """Distinct provision ids such as ``article-14`` or ``ipc-302``."""
    def ids(source: Column, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all(source, F.lit(pattern), F.lit(0)),
            lambda m: F.regexp_replace(m, r"^([a-z]+)\s*(.*)$", "$1-$2"),
        )

    provisions = X.word_re(r"(?:article|section)\s+\d+[a-z]?")
    codes = X.word_re(r"(?:ipc|crpc)\s*\d+[a-z]?")
    # Most texts name no provision at all, which plain searches tell quicker than patterns.
    return X.let(
        F.lower(X.squash(c)),
        lambda source: F.when(
            X.any_contains(source, ["article", "section", "ipc", "crpc"]),
            F.array_distinct(F.concat(ids(source, provisions), ids(source, codes))),
        ).otherwise(F.array().cast("array<string>")),
    )


def case_sections(cases: DataFrame) -> DataFrame:
    """The three indexed sections of an enriched case, one row each."""
    context = F.concat_ws(" ", X.blank("why_match"), F.array_join(F.col("tags"), " "))
    sections = F.array(
        F.struct(F.lit(0).alias("no"), F.lit("Summary").alias("section"), X.blank("summary").alias("body")),
        F.struct(F.lit(1).alias("no"), F.lit("Judgment").alias("section"), X.blank("judgment").alias("body")),
        F.struct(F.lit(2).alias("no"), F.lit("Context").alias("section"), context.alias("body")),
    )
    return cases.select("*", F.inline(sections))


def chunk_rows(sections: DataFrame, keep: Sequence[str], rules: ChunkRules = ChunkRules()) -> DataFrame:
    """``id, ord, section, case_id, title, text`` and ``keep`` columns, one row per chunk.

    Input columns: ``case_id, ord, title, no, section, body`` and ``keep``. Narrow: no
    shuffle. ``ord`` must be dense (below 2^41), as ``with_ordinal`` gives it; a reader's
    row ids are not. That, and a section of over a million windows, stop the job.
    """
    exploded = X.exploded(
        sections, windows_of("body", rules), ["pos", "text"],
        ["case_id", "title", "section", "no", *keep, F.col("ord").alias("__ord")], positions=True,
    )
    return exploded.select(
        F.concat_ws(
            "-", F.lit("rag"), F.col("case_id").cast("string"), F.lower("section"),
            (F.col("pos") + 1).cast("string"),
        ).alias("id"),
        F.when(F.col("__ord") >= MOST_CASES, F.raise_error(F.lit("case ordinals must be dense")).cast("bigint"))
        .when(F.col("pos") >= SECTION_SHIFT, F.raise_error(F.lit("section of too many windows")).cast("bigint"))
        .otherwise(F.col("__ord") * F.lit(CASE_SHIFT) + F.col("no") * F.lit(SECTION_SHIFT) + F.col("pos"))
        .cast("bigint").alias("ord"),
        "case_id", "title", "section", *keep, "text",
    ).filter(~is_low_quality("text", rules.prose, squashed=True))


def with_features(chunks: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Token, frequency, length, bucket and norm columns of a chunk table."""
    stop = list(rules.stop)

    @F.arrow_udf(FEATURES)
    def measured(titles: pa.Array, texts: pa.Array) -> pa.Array:
        return W.features(titles, texts, pa.array(stop, pa.string()), SECOND_WEIGHT)

    # The vector also covers the title.
    out = chunks.select("*", measured(F.lower(X.blank("title")), F.lower(X.blank("text"))).alias("__w"))
    return out.select(
        *chunks.columns, "__w.tokens", F.map_from_arrays("__w.tokens", "__w.counts").alias("token_freq"),
        F.struct("__w.first", "__w.second").alias("sparse"), "__w.length", "__w.norm",
    )


def build_chunks(cases: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Enriched cases to the full chunk table."""
    keep = ["court", "year", "type", "final_verdict"]
    return with_features(chunk_rows(case_sections(cases), keep, rules), rules)


def token_df(chunks: DataFrame) -> DataFrame:
    """Number of chunks holding each token. Counts are combined before the shuffle, so
    a token found everywhere costs one row per task."""
    return (
        X.exploded(chunks, F.map_keys("token_freq"), ["token"])
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.lit(H.DIMS).alias("dims"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.avg("length"), F.lit(1.0)).alias("avg_chunk_length"),
    )


def postings(chunks: DataFrame) -> DataFrame:
    """``ord, length, token, tf``: one row per chunk and token."""
    return X.exploded(chunks, F.col("token_freq"), ["token", "tf"], ["ord", "length"])


def saved_filter(chunks: DataFrame) -> DataFrame:
    """Rows that survive when an index is stored. The frequency table and mean length
    stay as built; only the number of chunks follows the filter."""
    text = F.lower(X.blank("text"))
    letters = F.length(F.regexp_replace(F.col("text"), "[^a-zA-Z]", ""))
    dirty = text.rlike("case title extracted|cited-cases metadata|https?://")
    return chunks.filter(~dirty & (letters > 80))
