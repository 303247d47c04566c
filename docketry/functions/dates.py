"""Dates and slots from free text. Unreadable input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import text as X

DECISION_FORMATS = [
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "d MMMM, yyyy", "d MMMM yyyy", "d MMM, yyyy", "d MMM yyyy",
    "d-MMM-yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "MMMM yyyy", "MMM yyyy",
]
WEEKDAY = r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+"


def _tries(c: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def decision_date(c: X.ColumnLike) -> Column:
    """ISO text where the date can be read, the trimmed input otherwise.

    Month names may be full or short, with or without commas, after a weekday or not;
    numbers are year first or month first; of an ISO timestamp the date is taken as written.
    """
    raw = X.trim_wide(c)
    plain = F.regexp_replace(F.regexp_replace(raw, WEEKDAY, ""), r"\s+", " ")
    stamp = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:"), F.substring(raw, 1, 10))
    return F.coalesce(F.date_format(_tries(F.coalesce(stamp, plain), DECISION_FORMATS), "yyyy-MM-dd"), raw)


def hearing_date(c: X.ColumnLike) -> Column:
    """DATE from ``dd-MM-yyyy``, ``yyyy-MM-dd`` or an ISO timestamp."""
    raw = X.trim_wide(c)
    return (
        F.when(raw.rlike(r"^\d{2}-\d{2}-\d{4}$"), _tries(raw, ["dd-MM-yyyy"]))
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), _tries(raw, ["yyyy-MM-dd"]))
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T"), _tries(F.substring(raw, 1, 10), ["yyyy-MM-dd"]))
    )


def _two(c: Column) -> Column:
    """Pad to two characters; longer input is kept whole."""
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def millis(df: DataFrame, name: str) -> Column:
    """Milliseconds since 1970 of a timestamp column with or without time zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_millis(name)


def date_dmy(c: X.ColumnLike) -> Column:
    """``dd-MM-yyyy`` text from year-first or day-first input with - or /; else empty."""
    raw = X.trim_wide(c)
    parts = F.split(F.replace(raw, F.lit("/"), F.lit("-")), "-")
    a, b, y = (F.get(parts, F.lit(i)) for i in range(3))
    year_first = raw.contains("-") & (F.length(F.substring_index(raw, "-", 1)) == 4)
    day_first = (F.size(parts) == 3) & (F.length(a) >= 1) & (F.length(b) >= 1) & (F.length(y) == 4)
    return (
        F.when(year_first, F.concat_ws("-", y, b, a))
        .when(day_first, F.concat_ws("-", _two(a), _two(b), y))
        .otherwise("")
    )


def slot(c: X.ColumnLike) -> Column:
    """``HH:mm`` from 24-hour or am/pm text; ``10:00`` when unreadable."""
    raw = X.trim_wide(c)
    hour = F.regexp_extract(raw, r"^(\d{1,2}):(\d{2})", 1).try_cast("int")
    minute = F.regexp_extract(raw, r"^(\d{1,2}):(\d{2})", 2)
    mark = F.upper(F.regexp_extract(raw, r"^\d{1,2}:\d{2}\s*([AaPp][Mm])$", 1))
    full = (
        F.when((mark == "PM") & (hour < 12), hour + 12).when((mark == "AM") & (hour == 12), F.lit(0)).otherwise(hour)
    )
    readable = raw.rlike(r"^\d{1,2}:\d{2}(\s*[AaPp][Mm])?$")
    return F.when(readable, F.concat(F.lpad(full.cast("string"), 2, "0"), F.lit(":"), minute)).otherwise("10:00")


def slot_prefix(c: X.ColumnLike) -> Column:
    """The first five characters, as the booking guard compares times."""
    return F.substring(X.trim_wide(c), 1, 5)
