"""Text column builders. Everything here is a native Spark expression.

Two dialect notes decide the patterns used below:

* Word edges are ASCII. Java's ``\\b`` looks at Unicode letters, so ``word_re``
  spells the edge with lookarounds instead.
* White space is the wide set (no-break space, ideographic space, byte-order
  mark ...), which Java's ``\\s`` does not cover.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str

SPACE_CLASS = r"\s\x0B\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACE_CLASS}]"
EDGE_L = r"(?<![A-Za-z0-9_])"
EDGE_R = r"(?![A-Za-z0-9_])"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: ColumnLike) -> Column:
    """Null and the empty string are the same thing throughout the library."""
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Lambdas that capture a column are re-evaluated per element when the optimiser
    inlines the column; a one-element ``transform`` pins it to a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def squash(c: ColumnLike) -> Column:
    """NUL to space, any run of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(blank(c), f"[{SPACE_CLASS}\\u0000]+", " "))


def trim_wide(c: ColumnLike) -> Column:
    return F.regexp_replace(blank(c), f"^{SPACE}+|{SPACE}+$", "")


def word_re(body: str, ignore_case: bool = False) -> str:
    return f"{'(?i)' if ignore_case else ''}{EDGE_L}(?:{body}){EDGE_R}"


def has_word(c: ColumnLike, body: str, ignore_case: bool = True) -> Column:
    return col(c).rlike(word_re(body, ignore_case))


def round_half_up(c: ColumnLike) -> Column:
    """Halves go towards plus infinity, also below zero."""
    return F.floor(col(c) + F.lit(0.5)).cast("int")


def clamp(c: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def any_contains(c: ColumnLike, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [col(c).contains(t) for t in terms], F.lit(False))


def count_contains(c: ColumnLike, terms: Iterable[str]) -> Column:
    """Number of listed terms that occur as substrings. Stays in generated code."""
    parts = [col(c).contains(t).cast("int") for t in terms]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def sum_contains(c: ColumnLike, weighted: Iterable[tuple[str, int]]) -> Column:
    parts = [F.when(col(c).contains(t), F.lit(w)).otherwise(F.lit(0)) for t, w in weighted]
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def first_rule(c: ColumnLike, rules: Sequence[tuple[str, str]], default: Column | str) -> Column:
    """Ordered ``(label, regex)`` list as one ``when`` chain: the first hit wins."""
    out = None
    for label, pattern in rules:
        hit = col(c).rlike(pattern)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    otherwise = default if isinstance(default, Column) else F.lit(default)
    return otherwise if out is None else out.otherwise(otherwise)


def scrub(c: ColumnLike, passes: Sequence[tuple[str, str]]) -> Column:
    """Fold a list of ``(regex, replacement)`` passes over a column."""
    return reduce(lambda acc, p: F.regexp_replace(acc, p[0], p[1]), passes, blank(c))


def exploded(df: DataFrame, value: Column, names: Sequence[str], keep: Sequence[ColumnLike] = (),
             positions: bool = False) -> DataFrame:
    """One row per element of a computed array or map, empty ones giving none.

    A plain ``explode`` makes the optimiser infer ``size(value) > 0`` below it, which
    evaluates a costly ``value`` again for the test; the outer form with a filter on the
    result does not.
    """
    generator = F.posexplode_outer(value) if positions else F.explode_outer(value)
    return df.select(*keep, generator.alias(*names)).filter(F.col(names[0]).isNotNull())


def words(c: ColumnLike, min_len: int = 3, letters: str = "a-z0-9") -> Column:
    """Lower-cased maximal runs of ``letters``, in order, repeats kept."""
    pattern = f"[{letters}]{{{min_len},}}"
    return F.regexp_extract_all(F.lower(blank(c)), F.lit(f"({pattern})"), F.lit(1))


def without(arr: Column, stop: Sequence[str]) -> Column:
    """Drop stop words, keep repeats."""
    return F.filter(arr, lambda w: ~w.isin(list(stop))) if stop else arr


def tokens(c: ColumnLike, stop: Sequence[str], min_len: int = 3) -> Column:
    """Distinct tokens in order of first appearance."""
    found = F.array_distinct(words(c, min_len))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def runs(arr: Column) -> Column:
    """``ARRAY<STRUCT<token, n, pos>>``: each distinct item with its count and first
    position, by one sort. Linear after the sort, so whole documents are fine."""

    def build(s: Column) -> Column:
        marked = F.transform(s, lambda x, i: F.struct(x["w"].alias("w"), x["pos"].alias("pos"), i.alias("at")))
        firsts = F.filter(marked, lambda x, i: (i == 0) | (F.get(s, i - 1)["w"] != x["w"]))

        def close(f: Column) -> Column:
            ends = F.concat(
                F.slice(F.transform(f, lambda x: x["at"]), 2, 2_000_000_000), F.array(F.size(s))
            )
            return F.zip_with(
                f, ends,
                lambda x, end: F.struct(x["w"].alias("token"), (end - x["at"]).alias("n"), x["pos"].alias("pos")),
            )

        return F.when(
            F.size(s) == 0, F.array().cast("array<struct<token:string,n:int,pos:int>>")
        ).otherwise(let(firsts, close))

    indexed = F.transform(arr, lambda w, i: F.struct(w.alias("w"), i.alias("pos")))
    return let(F.sort_array(indexed), build)


def frequencies(arr: Column) -> Column:
    """``MAP<token, count>`` of an array."""
    return let(
        runs(arr),
        lambda r: F.map_from_arrays(F.transform(r, lambda x: x["token"]), F.transform(r, lambda x: x["n"])),
    )


def segment(c: ColumnLike, label: str) -> Column:
    """Trimmed text after a label up to the end of the line; empty if absent."""
    text = blank(c)
    at = F.instr(text, F.lit(label))
    rest = F.substr(text, at + F.lit(len(label)))
    return F.when(at > 0, trim_wide(F.substring_index(rest, "\n", 1))).otherwise(F.lit(""))


def markup_text(c: ColumnLike) -> Column:
    """Six entities decoded, tags to spaces, white space collapsed."""
    decoded = blank(c)
    # fixed values: entities and their characters
    for entity, char in [
        ("&amp;", "&"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&nbsp;", " "),
    ]:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.trim(
        F.regexp_replace(F.regexp_replace(decoded, "<[^>]+>", " "), f"{SPACE}+", " ")
    )
