"""Streaming twins of the rate limiter and the slot guard, on transformWithState.

Both need the RocksDB state store (``STATE_STORE``). State per key is one small value. The
expiring twins drop it by event time: a timer fires once the watermark has passed it, so a replay
gives the same result as a live run and ends with empty state.
Within a micro-batch the requests of a key are taken in time order; across batches the
order is that of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
LIMIT_OUT = "client STRING, id BIGINT, t BIGINT, allowed BOOLEAN, retry_after_ms BIGINT"
SLOT_OUT = (
    "judge_id STRING, hearing_date DATE, slot STRING, id STRING, case_id STRING, accepted BOOLEAN, "
    "incumbent_case STRING"
)


class WindowLimiter(StatefulProcessor):
    """Window opens at the first request after expiry; ``limit`` requests per window."""

    def __init__(self, limit: int, window_ms: int, expire: bool):
        self.limit, self.window_ms, self.expire = limit, window_ms, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A client idle for longer than a window starts afresh anyway.
        ttl = 2 * self.window_ms if self.expire else None
        self.window = handle.getValueState("window", "start BIGINT, used INT", ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["t", "id"])
        start, used = self.window.get() if self.window.exists() else (None, 0)
        out = []
        for t, row_id in zip(batch["t"], batch["id"]):
            if start is None or t >= start + self.window_ms:
                start, used, wait = t, 1, 0
            elif used < self.limit:
                used, wait = used + 1, 0
            else:
                wait = max(1, start + self.window_ms - t)
            out.append((key[0], row_id, t, wait == 0, wait))
        self.window.update((int(start), int(used)))
        yield pd.DataFrame(out, columns=["client", "id", "t", "allowed", "retry_after_ms"])

    def close(self) -> None:
        pass


def rate_limit_stream(events: DataFrame, limit: int, window_ms: int, expire: bool = False) -> DataFrame:
    """``client, id, ts`` stream to decisions.

    ``expire`` drops the state of idle clients after two windows of processing time. Use it
    for a query that runs on; with a trigger that ends when the input is read (a replay)
    leave it off, since a processing-time query always has one more batch to run.
    """
    keyed = events.select(F.col("client").cast("string").alias("client"), "id", F.unix_millis("ts").alias("t"))
    return keyed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=WindowLimiter(limit, window_ms, expire), outputStructType=LIMIT_OUT,
        outputMode="Append", timeMode="ProcessingTime" if expire else "None",
    )


class ExpiringLimiter(WindowLimiter):
    """The window limiter with a timer at the end of the newest window: after it a client starts afresh anyway."""

    def __init__(self, limit: int, window_ms: int):
        super().__init__(limit, window_ms, expire=False)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        yield from super().handleInputRows(key, rows, timer_values)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(self.window.get()[0]) + self.window_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield pd.DataFrame(columns=["client", "id", "t", "allowed", "retry_after_ms"])


def rate_limit_stream_expiring(events: DataFrame, limit: int, window_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """``rate_limit_stream`` whose clients leave the state when the watermark has passed their window.

    Rows later than ``lateness`` are dropped by the watermark.
    """
    keyed = events.withWatermark("ts", lateness).select(
        F.col("client").cast("string").alias("client"), "id", "ts", F.unix_millis("ts").alias("t"))
    return keyed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=ExpiringLimiter(limit, window_ms), outputStructType=LIMIT_OUT, outputMode="Append", timeMode="EventTime")


class SlotGuard(StatefulProcessor):
    """First request for a slot keeps it, until ``expire_ms`` after it was taken if that is given."""

    def __init__(self, expire_ms: int | None = None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "id STRING, case_id STRING", self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq", "id"])
        holder = self.holder.get() if self.holder.exists() else None
        out = []
        for row_id, case_id in zip(batch["id"], batch["case_id"]):
            if holder is None:
                holder = (row_id, case_id)
                self.holder.update(holder)
            mine = holder[0] == row_id
            out.append((*key, row_id, case_id, mine, None if mine else holder[1]))
        yield pd.DataFrame(
            out, columns=["judge_id", "hearing_date", "slot", "id", "case_id", "accepted", "incumbent_case"]
        )

    def close(self) -> None:
        pass


def schedule_stream(requests: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """``id, seq, case_id, judge_id, hearing_date, slot`` stream to accepted / rejected.

    ``expire_ms`` bounds the state of a query that runs on: a slot's holder is forgotten
    that long (processing time) after it was taken, so choose more than the longest time
    between a booking and its hearing. A replay leaves it off.
    """
    return requests.groupBy("judge_id", "hearing_date", "slot").transformWithStateInPandas(
        statefulProcessor=SlotGuard(expire_ms), outputStructType=SLOT_OUT, outputMode="Append",
        timeMode="None" if expire_ms is None else "ProcessingTime",
    )


# Judges of a day that are guarded together: a call, a state value and a timer each, however many judges there are.
DAY_GROUPS = 512


class ExpiringGuard(StatefulProcessor):
    """The slot guard for a day's slots of a group of judges, which leave the state together. The timer is at the end of
    the day and ``keep_ms`` more. A key is (day, group)."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.holders = handle.getValueState(
            "holders", "judges ARRAY<STRING>, slots ARRAY<STRING>, ids ARRAY<STRING>, cases ARRAY<STRING>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        fields = ["judge_id", "slot", "id", "case_id"]
        batch = pd.concat(list(rows)).sort_values(["seq", "id"])[fields]
        known = self.holders.get()
        held = pd.DataFrame(dict(zip(fields, known or ([],) * 4)), dtype=object)
        both = pd.concat([held, batch], ignore_index=True)
        codes = both.groupby(["judge_id", "slot"], sort=False, dropna=False).ngroup().to_numpy()
        # The first of a slot keeps it; those that are held stand before all rows, in the order of their slots.
        first = np.unique(codes, return_index=True)[1]
        ids, cases = both["id"].to_numpy(object), both["case_id"].to_numpy(object)
        if len(first) > len(held):
            self.holders.update(tuple(both[c].to_numpy(object)[first].tolist() for c in fields))
        if known is None:
            day = pd.Timestamp(key[0], tz="UTC")
            self.handle.registerTimer(int(day.timestamp() * 1000) + 86_400_000 + self.keep_ms)
        holder = first[codes[len(held):]]
        mine = ids[holder] == ids[len(held):]
        yield pd.DataFrame({
            "judge_id": batch["judge_id"].to_numpy(object), "hearing_date": key[0], "slot": batch["slot"].to_numpy(object),
            "id": batch["id"].to_numpy(object), "case_id": batch["case_id"].to_numpy(object), "accepted": mine,
            "incumbent_case": np.where(mine, None, cases[holder])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.holders.clear()
        yield pd.DataFrame(columns=["judge_id", "hearing_date", "slot", "id", "case_id", "accepted", "incumbent_case"])

    def close(self) -> None:
        pass


def schedule_stream_expiring(requests: DataFrame, lateness: str = "10 minutes", keep_ms: int = 0) -> DataFrame:
    """``schedule_stream`` over requests with an event time ``ts``: a slot leaves the state when the watermark has
    passed its day, after which no request for it is in time."""
    grouped = requests.withWatermark("ts", lateness).withColumn(
        "__group", F.pmod(F.xxhash64("judge_id"), F.lit(DAY_GROUPS)).cast("int"))
    return grouped.groupBy("hearing_date", "__group").transformWithStateInPandas(
        statefulProcessor=ExpiringGuard(keep_ms), outputStructType=SLOT_OUT, outputMode="Append", timeMode="EventTime")
