"""Hearings: listings, calendar views, slot and room conflicts, acceptance, re-bookings.

Conflicts are reported against the incumbent of a slot, not as pairs: a slot with n
bookings gives n - 1 rows, never n squared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.plans.hot import join_by_key
from docketry.plans.tables import stored

JUDGE_SLOT = ("judge_id", "hearing_date", "slot")
ROOM_SLOT = ("hearing_date", "slot", "court", "room")


def list_hearings(hearings: DataFrame, case_id: str | None = None, judge_id: str | None = None) -> DataFrame:
    out = hearings
    if case_id:
        out = out.filter(F.col("case_id") == case_id)
    if judge_id:
        out = out.filter(F.col("judge_id") == judge_id)
    return out.orderBy("hearing_date", "slot", "id")


def hearings_in_month(hearings: DataFrame, year: int, month: int) -> DataFrame:
    """As a range on the date, so that it reaches the scan."""
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    return hearings.filter((F.col("hearing_date") >= start) & (F.col("hearing_date") < F.add_months(start, 1)))


def upcoming_hearings(hearings: DataFrame, as_of, n: int = 5) -> DataFrame:
    return hearings.filter(F.col("hearing_date") >= F.lit(as_of)).orderBy("hearing_date", "seq").limit(n)


def hearing_status_counts(hearings: DataFrame) -> DataFrame:
    return hearings.groupBy("status").agg(F.count(F.lit(1)).alias("hearings"))


def _incumbents(hearings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First booking of each slot that was asked for more than once. Partial minima leave
    one row per slot and task, whatever the demand for a slot."""
    return (
        hearings.groupBy(*keys)
        .agg(F.min(F.struct("seq", "id", "case_id")).alias("first"), F.count(F.lit(1)).alias("n"))
    )


def slot_conflicts(hearings: DataFrame) -> DataFrame:
    """Bookings after the first for the same judge, day and slot, with the incumbent."""
    taken = _incumbents(hearings, JUDGE_SLOT).filter(F.col("n") > 1)
    return join_by_key(hearings, taken, JUDGE_SLOT, "n").filter(F.col("id") != F.col("first.id")).select(
        "id", *JUDGE_SLOT, F.col("first.id").alias("incumbent_id"), F.col("first.case_id").alias("incumbent_case"),
        F.col("n").alias("bookings"),
    )


def schedule(requests: DataFrame) -> DataFrame:
    """First request per judge, day and slot is accepted; later ones name the incumbent.

    Only slots that were asked for more than once go back to the requests, a short table as a
    rule; adaptive execution splits the requests of a slot that very many ask for. A request
    without judge, day or slot takes no slot and is accepted.
    """
    taken = stored(_incumbents(requests, JUDGE_SLOT).filter(F.col("n") > 1), "taken")
    accepted = F.col("first").isNull() | (F.col("id") == F.col("first.id"))
    return requests.join(taken, list(JUDGE_SLOT), "left").select(
        "id", "case_id", *JUDGE_SLOT, accepted.alias("accepted"),
        F.when(~accepted, F.col("first.case_id")).alias("incumbent_case"),
    )


def room_conflicts(hearings: DataFrame) -> DataFrame:
    """Bookings of a room at a time already held by another case.

    Per room and time only the first booking of the two earliest cases matters: a booking
    clashes with the first case, or, if it belongs to that case, with the next one.
    """
    by_case = hearings.groupBy(*ROOM_SLOT, "case_id").agg(
        F.min(F.struct("seq", "id")).alias("own"), F.count(F.lit(1)).alias("rows"))
    by_case = stored(by_case, "room-cases")
    first = by_case.groupBy(*ROOM_SLOT).agg(
        F.min(F.struct("own", "case_id")).alias("first"), F.count(F.lit(1)).alias("n_cases"), F.sum("rows").alias("n")
    ).filter(F.col("n_cases") > 1)
    second = (
        join_by_key(by_case.drop("rows"), first, ROOM_SLOT, "n_cases").filter(F.col("case_id") != F.col("first.case_id"))
        .groupBy(*ROOM_SLOT, "first", "n").agg(F.min(F.struct("own", "case_id")).alias("second"))
    )
    mine = F.col("case_id") == F.col("first.case_id")
    other = F.when(mine, F.col("second")).otherwise(F.col("first"))
    return join_by_key(hearings, second, ROOM_SLOT, "n").select(
        "id", "case_id", *ROOM_SLOT, other["own"]["id"].alias("other_id"), other["case_id"].alias("other_case")
    )


def merge_rebookings(hearings: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Same case, day and slot booked again: one row, first id, last given value of each field."""
    order = F.struct("seq", "id")
    return hearings.groupBy("case_id", "hearing_date", "slot").agg(
        F.min_by("id", order).alias("id"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields],
        F.count(F.lit(1)).alias("bookings"),
    )
