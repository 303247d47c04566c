"""Quality rules: a table of thresholds compiled into one projection of measures and verdicts.

Every measure is a whole number taken from one text with built-in functions, and every rule
compares ``100 * measure`` with ``percent * per``, so no rounding decides. A row is judged where
it lies: no shuffle, no user function, no state between rows.

Words are runs of characters other than ASCII white space. Null and empty texts have no words and
all measures 0. Texts of any length are measured whole; the work for a text grows with its length
(with its logarithm besides, where windows repeat). Repeated rows are judged one by one, an empty
table gives an empty result. Only the id and the text column are read, so other columns can't
clash; an id column named like a result is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, symbols, sentence signs around words, frequent words.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
SIGNS = ["", ".", ",", ";", ":", "!", "?"]
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "as", "on", "be", "by", "this", "are",
           "or", "an", "at", "from"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "von", "mit", "ist", "auf", "für", "im", "dem", "nicht", "ein",
           "eine", "des", "sich", "auch"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "sur", "est", "par",
           "pas", "au", "il"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "es", "se", "no",
           "su", "al", "lo"],
}
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``measure`` is at least or at most ``percent`` hundredths of ``per`` (of 1 where that is None)."""

    name: str
    measure: str
    side: str
    percent: int
    per: str | None = None

    def holds(self) -> Column:
        left, right = 100 * F.col(self.measure), self.percent * (F.col(self.per) if self.per else F.lit(1))
        return left >= right if self.side == "least" else left <= right

    def sql(self) -> str:
        return f"100 * {self.measure} {'>=' if self.side == 'least' else '<='} {self.percent} * {self.per or 1}"


BASE = [
    Rule("short", "n_words", "least", 1000),
    Rule("repeats", "n_repeat_words", "most", 20, "n_words"),
]
RULES = [
    Rule("short_words", "word_chars", "least", 200, "n_words"),
    Rule("long_words", "word_chars", "most", 1500, "n_words"),
    Rule("symbols", "n_symbols", "most", 15, "n_words"),
    Rule("shouting", "n_loud", "most", 25, "n_words"),
    Rule("stop_words", "n_stop_words", "least", 3, "n_words"),
    Rule("without_letters", "n_letter_runs", "least", 60, "n_words"),
    Rule("same_lines", "n_dup_lines", "most", 50, "n_lines"),
    Rule("bullets", "n_bullet_lines", "most", 90, "n_lines"),
    Rule("ellipses", "n_ellipsis_lines", "most", 50, "n_lines"),
]
BULLETS = ["-", "*", "•", "‣", "·"]


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, where ``then`` looks into it repeatedly."""
    return F.transform(F.array(value), then)[0]


def _size(array: Column) -> Column:
    return F.size(array).cast("bigint")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _blanks(text: Column) -> Column:
    """The text with all white space as blanks. Replacing is quicker than translating letter by letter."""
    for sign in SPACE[1:]:
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return text


def _stop_words() -> list[str]:
    """Every stop word, small or with a capital, and at most one sentence sign behind it."""
    plain = {word for words in STOP_WORDS.values() for word in words}
    return sorted(word + sign for word in plain | {word.capitalize() for word in plain} for sign in SIGNS)


def _window(words: Column, first: Column, at: Column) -> Column:
    """Hash of the five words at a place; fewer at the end of the text."""
    return F.xxhash64(first, *[F.get(words, at + i) for i in range(1, WINDOW)])


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words that lie in a window of five words met twice or more, the first one included.

    ``hashes`` holds the hash of the window at every word, with those cut short by the end of the
    text. Texts in which all differ, nearly all texts, end with one distinct count. The others
    sort (hash, place), confirm equal hashes on the words and add up what the windows cover.
    """

    def covered(places: Column) -> Column:
        widths = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0).cast("bigint"), lambda total, width: total + width)

    def same(a: Column, b: Column) -> Column:
        return (a.h == b.h) & (F.slice(words, a.p + 1, WINDOW) == F.slice(words, b.p + 1, WINDOW))

    def repeated(sorted_windows: Column) -> Column:
        twice = F.filter(sorted_windows, lambda x, i: F.coalesce(
            same(x, F.get(sorted_windows, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(sorted_windows, i + 1)), F.lit(False)))
        return _let(F.sort_array(F.transform(twice, lambda x: x.p)), covered)

    placed = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
    whole = F.sort_array(F.slice(placed, 1, F.size(words) - WINDOW + 1))
    differ = (F.size(words) <= WINDOW) | (F.size(F.array_distinct(hashes)) == F.size(hashes))
    return F.when(differ, F.lit(0).cast("bigint")).otherwise(_let(whole, repeated))


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the id and every measure that rules can name."""
    blank = docs.select(F.col(id), F.coalesce(text, F.lit("")).alias("__text")).select(
        F.col(id), "__text", _blanks(F.col("__text")).alias("__blank"))
    split = blank.select(
        F.col(id), "__text", "__blank",
        F.array_remove(F.split("__blank", " "), "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    hashed = split.withColumn("__hashes", F.transform("__words", lambda word, at: _window(F.col("__words"), word, at)))
    return hashed.select(
        F.col(id),
        _size(F.col("__words")).alias("n_words"),
        F.length(F.replace(F.col("__blank"), F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        _count(F.col("__text"), SYMBOLS).alias("n_symbols"),
        _count(F.col("__text"), "!").alias("n_loud"),
        _size(F.filter("__words", lambda word: word.isin(_stop_words()))).alias("n_stop_words"),
        _count(F.col("__text"), r"\p{L}+").alias("n_letter_runs"),
        _size(F.col("__lines")).alias("n_lines"),
        (_size(F.col("__lines")) - _size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        _size(F.filter("__lines", lambda line: F.substring(F.ltrim(line), 1, 1).isin(BULLETS))).alias("n_bullet_lines"),
        _size(F.filter("__lines", lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))).alias("n_ellipsis_lines"),
        repeated_words(F.col("__words"), F.col("__hashes")).alias("n_repeat_words"),
    )


MEASURES = ["n_words", "word_chars", "n_symbols", "n_loud", "n_stop_words", "n_letter_runs", "n_lines", "n_dup_lines",
            "n_bullet_lines", "n_ellipsis_lines", "n_repeat_words"]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE, id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """The measures of every row, ``base_failed``, ``failed`` (names of the broken rules) and ``kept``."""
    if id in (*MEASURES, "base_failed", "failed", "kept"):
        raise ValueError(f"the id column can't be named {id}")
    unknown = [rule for rule in (*base, *rules) if rule.measure not in MEASURES or rule.per not in (None, *MEASURES)
               or rule.side not in ("least", "most")]
    if unknown:
        raise ValueError(f"unknown measure or side: {unknown}")

    def broken(some: Sequence[Rule]) -> Column:
        names = F.array(*[F.when(~rule.holds(), F.lit(rule.name)) for rule in some]) if some else F.array().cast("array<string>")
        return F.filter(names, lambda name: name.isNotNull())

    base_failed = F.size(broken(base)) > 0
    return measures(docs, id, text).withColumns({"base_failed": base_failed, "failed": broken([*base, *rules])}).withColumn(
        "kept", F.size("failed") == 0)
