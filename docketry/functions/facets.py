"""Band, court level, location, type bucket and similar derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import lexicon as L
from docketry.functions import text as X


def band(score: X.ColumnLike) -> Column:
    out = None
    for name, low in L.BANDS[:-1]:
        hit = X.col(score) >= low
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(L.BANDS[-1][0])


def band_order(b: X.ColumnLike) -> Column:
    """P0 first; unknown bands count as P3."""
    value = F.coalesce(X.col(b), F.lit("P3"))
    return F.when(value == "P0", 0).when(value == "P1", 1).when(value == "P2", 2).otherwise(3)


def by_contained(c: X.ColumnLike, pairs: Sequence[tuple[str, Sequence[str] | str]], default: str) -> Column:
    """First label whose terms occur in the lower-cased column."""
    low = F.lower(X.blank(c))
    out = None
    for label, terms in pairs:
        hit = X.any_contains(low, [terms] if isinstance(terms, str) else terms)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def court_level(c: X.ColumnLike) -> Column:
    return by_contained(c, L.COURT_LEVELS, "Other Court")


def court_location(c: X.ColumnLike, places: Sequence[str] = tuple(L.KNOWN_LOCATIONS)) -> Column:
    pairs = [(" ".join(w[:1].upper() + w[1:] for w in p.split(" ")), p) for p in places]
    return by_contained(c, [*pairs, ("National", "supreme")], "Unspecified")


def type_bucket(c: X.ColumnLike) -> Column:
    return by_contained(c, L.TYPE_BUCKETS, "Specialized Cases")


def judge_category(c: X.ColumnLike) -> Column:
    return by_contained(c, L.TYPE_BUCKETS, "Other")


def jurisdiction_tag(tags: X.ColumnLike) -> Column:
    rest = F.filter(F.coalesce(X.col(tags), F.array().cast("array<string>")), lambda t: ~t.isin(L.NON_JURISDICTION_TAGS))
    return F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit("India"))


def match_level(score: X.ColumnLike, scale: str = "search") -> Column:
    if scale == "client":
        s = X.col(score)
        return F.when(s >= 0.85, "High").when(s >= 0.6, "Medium").otherwise("Low")
    s = F.when(X.col(score) > 1, X.col(score) / 100).otherwise(X.col(score))
    return (
        F.when(s >= 0.8, "High Match").when(s >= 0.6, "Moderate Match").when(s >= 0.4, "Low Match")
        .otherwise("Very Low Match")
    )


def similarity_range(s: X.ColumnLike) -> Column:
    out = None
    for name, low in [("90-100%", 90), ("80-89%", 80), ("70-79%", 70), ("60-69%", 60), ("50-59%", 50)]:
        hit = X.col(s) >= low
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("<50%")


def path_template(path: X.ColumnLike) -> Column:
    """Numeric and long path parts become ``:id``."""
    p = F.when(X.blank(path) == "", "/").otherwise(X.col(path))
    return F.regexp_replace(
        F.regexp_replace(p, r"/[0-9]+(?=/|$)", "/:id"), r"/[A-Za-z0-9_-]{10,}(?=/|$)", "/:id"
    )
