"""Judge roster: ranking for cases, assignment, availability, status and counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import hashing as H
from docketry.functions import lexicon as L
from docketry.functions import text as X
from docketry.operators.triage import triage
from docketry.plans import blocks as P
from docketry.plans import tokens as W
from docketry.plans.sizing import SMALL_ROWS, fits
from docketry.plans.tables import stored

# fixed values: fit weights
W_CATEGORY, W_AVAILABLE, W_HEADROOM, W_EXPERIENCE, W_COURT, W_RISK = 0.30, 0.22, 0.18, 0.10, 0.17, 0.03
FULL_EXPERIENCE = 25
SEED_RANGE = 11
MASK = np.uint64(H.MASK)


def fallback_roster(spark: SparkSession) -> DataFrame:
    """Stand-in judges per category, used when the roster is empty."""
    rows = [
        (f"{category.lower()}-fallback-{i + 1}", name, "District Court" if category == "Other" else "High Court",
         category, 10 + i * 4, 45 + i * 5, 18 + i * 8, "Busy" if i == 1 else "Available")
        for category, names in L.FALLBACK_ROSTER.items() for i, name in enumerate(names)
    ]
    return spark.createDataFrame(
        rows,
        "id STRING, name STRING, court_level STRING, category STRING, years_of_experience INT, "
        "case_load_capacity INT, current_case_load INT, availability STRING",
    )


def _roster_columns(judges: DataFrame) -> DataFrame:
    capacity = F.coalesce("case_load_capacity", F.lit(0))
    used = F.when(capacity > 0, F.col("current_case_load") / capacity).otherwise(F.lit(1.0))
    name_hash = H.rolling31("name")
    power = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("name"))), F.lit(1).cast("bigint"),
        lambda p, _: (p * F.lit(31).cast("bigint")).bitwiseAND(F.lit(H.MASK).cast("bigint")),
    )
    return judges.select(
        F.col("id").alias("judge_id"), F.col("name").alias("judge_name"), "category", "court_level", "availability",
        used.alias("used"), X.round_half_up(used * 100).alias("utilization"),
        F.coalesce("years_of_experience", F.lit(0)).cast("double").alias("years"),
        name_hash.alias("name_hash"), F.when(F.length("name") == 0, F.lit(1)).otherwise(power).alias("power"),
    )


def contenders(roster: DataFrame, k: int) -> DataFrame:
    """The judges that can be among the best ``k`` of any case.

    Judges of one category and court differ by their fixed part and by the seed's points only. One
    whose fixed part is further below the ``k``-th best of the class than the seed and rounding can
    bring is never chosen, whatever the case. Only rows of the best ``k`` of a class leave a task.
    """
    status = F.when(F.col("availability") == "Available", 1.0).when(F.col("availability") == "Busy", 0.6).otherwise(0.15)
    fixed = (W_AVAILABLE * status + W_HEADROOM * F.greatest(F.lit(0.0), 1 - F.col("used"))
             + W_EXPERIENCE * F.least(F.lit(1.0), F.col("years") / FULL_EXPERIENCE))
    placed = roster.withColumn("__fixed", 100 * fixed)
    best = Window.partitionBy("category", "court_level").orderBy(F.desc("__fixed"))
    kth = placed.select("category", "court_level", "__fixed").withColumn("__n", F.row_number().over(best)).where(
        F.col("__n") <= k).where(F.col("__n") == k).select(
        F.col("category").alias("__category"), F.col("court_level").alias("__court"),
        (F.col("__fixed") - SEED_RANGE - 1e-3).alias("__least"))
    same = F.col("category").eqNullSafe(F.col("__category")) & F.col("court_level").eqNullSafe(F.col("__court"))
    kept = placed.join(kth, same, "left").where(F.col("__least").isNull() | (F.col("__fixed") >= F.col("__least")))
    return kept.select(*roster.columns)


# The lower and upper parts of the hashes, in ever smaller shares, that dominators are looked for in.
SHARES = sorted({2.0 ** -i for i in range(1, 12)} | {1 - 2.0 ** -i for i in range(1, 12)})
# Judges of a partition, about, that are compared with each other.
PRUNED_ROWS = 100_000
# Kinds of case (category, demand, risk) whose best judges a task keeps at hand.
KEPT_KINDS = 20_000


def _kth(values: np.ndarray, k: int) -> list[np.ndarray]:
    """Running best, second best ... ``k``-th best of a sequence, at every position."""
    out = []
    for _ in range(k):
        best = np.maximum.accumulate(values, axis=-1)
        out.append(best)
        before = np.concatenate([np.full_like(best[..., :1], _least(best.dtype)), best[..., :-1]], axis=-1)
        values = np.minimum(values, before)
    return out


def _least(kind: np.dtype):
    return -np.inf if kind.kind == "f" else np.iinfo(kind).min


def _undominated(r: pd.DataFrame, k: int) -> np.ndarray:
    """Which judges of a frame may be chosen: see ``undominated``."""
    r = r.reset_index(drop=True)
    order = r.sort_values(["utilization", "judge_name", "judge_id"], kind="stable", na_position="first").index.to_numpy()
    fixed, name_hash = _prepare(r)["fixed"], r["name_hash"].to_numpy(np.int64)
    same = [r["category"].fillna("\0"), r["court_level"].fillna("\0"), r["power"], name_hash % SEED_RANGE]
    keep = np.zeros(len(r), bool)
    for at in r.loc[order].groupby([x.loc[order] if isinstance(x, pd.Series) else x[order] for x in same], sort=False).indices.values():
        at = order[at]
        f, h = fixed[at], name_hash[at]
        if len(at) <= k:
            keep[at] = True
            continue
        edges = np.unique(h)
        if len(edges) > 2 * len(SHARES):
            edges = np.unique(np.quantile(h, SHARES, method="lower"))
        for side in (1, -1):
            free = np.ones(len(at), bool)
            for edge in edges:
                others, mine = (h <= edge, h >= edge) if side > 0 else (h >= edge, h <= edge)
                kth = _kth(np.where(others, f, -np.inf), k)[-1]
                earlier = np.concatenate([[-np.inf], kth[:-1]])
                free &= ~(mine & (f <= earlier))
            keep[at[free]] = True
    return keep


def undominated(roster: DataFrame, k: int) -> DataFrame:
    """Drop judges that ``k`` others of the same partition beat for every case.

    The seed's points are those of ``seed hash x power + name hash``, modulo 2^32 and modulo 11. Judges of one
    category, court, power and remainder of the name hash get the same points where they lie on one side of the
    overflow, and then differ by their fixed part only. So a judge goes who has ``k`` others with no lower fixed
    part and an earlier place among equal scores both at no higher and at no lower hashes: they are beaten on
    either side. That holds in any part of the roster, so nothing has to be brought together.
    """

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, known = [], 0, 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= 2 * known + PRUNED_ROWS:
                whole = pd.concat(held, ignore_index=True)
                held = [whole[_undominated(whole, k)]]
                size = known = len(held[0])
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield whole[_undominated(whole, k)]

    return roster.mapInPandas(per_partition, roster.schema)


def _fewest(roster: DataFrame, k: int, limit: int) -> DataFrame:
    """The undominated judges, in rounds of fewer and larger partitions until they fit or no longer shrink."""
    kept = stored(roster, "contenders")
    rows = kept.count()
    while True:
        parts = max(1, rows // PRUNED_ROWS)
        kept = stored(undominated(kept.repartition(parts), k), "contenders")
        before, rows = rows, kept.count()
        if parts == 1 or rows <= limit or rows > 0.9 * before:
            return kept


def _prepare(r: pd.DataFrame) -> dict:
    status = r["availability"].map({"Available": 1.0, "Busy": 0.6}).fillna(0.15).to_numpy(float)
    return {
        "fixed": W_AVAILABLE * status + W_HEADROOM * np.maximum(0, 1 - r["used"].to_numpy(float))
        + W_EXPERIENCE * np.minimum(1, r["years"].to_numpy(float) / FULL_EXPERIENCE),
        "category": r["category"].to_numpy(str), "court": r["court_level"].to_numpy(str),
        "name_hash": r["name_hash"].to_numpy(np.uint64), "power": r["power"].to_numpy(np.uint64),
    }


def _court_fit(state: dict) -> np.ndarray:
    """Fit per demand level (0 top, 1 raised, 2 normal) and judge."""
    supreme, high, district = (state["court"] == c for c in ("Supreme Court", "High Court", "District Court"))
    return np.array(
        [
            np.where(supreme, 1, np.where(high, 0.92, 0.68)),
            np.where(high, 1, np.where(supreme, 0.92, 0.76)),
            np.where(district, 1, 0.84),
        ]
    )


def _share(state: dict, cases: pd.DataFrame, few: np.ndarray) -> np.ndarray:
    """Case x judge fit, without the seed's points. ``few`` holds the places of the judges, one row for all cases or one each."""
    wanted = cases["category"].to_numpy(str)[:, None]
    category = state["category"][few]
    match = np.where(category == wanted, 1, np.where((wanted == "Other") & (category == "Criminal"), 0.72, 0.38))
    fit = _court_fit(state)[_demand(cases)[:, None], few]
    risk = cases["risk"].to_numpy(float)
    return W_CATEGORY * match + state["fixed"][few] + W_COURT * fit + W_RISK * np.clip(risk / 100, 0.55, 1)[:, None]


def _score(state: dict, cases: pd.DataFrame, few: np.ndarray | None = None) -> np.ndarray:
    few = np.arange(len(state["fixed"]))[None, :] if few is None else few
    # Hash of "seed:name" from the hash of each part.
    seed = cases["seed_hash"].to_numpy(np.uint64)[:, None]
    affinity = ((seed * state["power"][few] + state["name_hash"][few]) & MASK) % np.uint64(SEED_RANGE)
    return _whole(_share(state, cases, few), affinity)


def _whole(share: np.ndarray, affinity: np.ndarray | int) -> np.ndarray:
    return np.floor(np.round(100 * share + affinity, 6) + 0.5)


def _demand(cases: pd.DataFrame) -> np.ndarray:
    risk, severity = cases["risk"].to_numpy(float), cases["severity"].to_numpy(str)
    return np.where((severity == "Critical") | (risk >= 80), 0, np.where((severity == "High") | (risk >= 60), 1, 2))


class Chooser:
    """The judges worth scoring for a case, from the ordered roster.

    For one kind of case a judge's score is a fixed whole number and the seed's points. Judges of one power and
    remainder get the same points on each side of the overflow, so the best of the case are among the best ``k``
    of each remainder below the overflow and the best ``k`` above it. Both change at few hashes only, and these
    places are kept per kind.
    """

    def __init__(self, roster: pd.DataFrame, k: int):
        self.state, self.k, self.n = _prepare(roster), k, len(roster)
        self.lanes = []
        hashes, powers = roster["name_hash"].to_numpy(np.int64), roster["power"].to_numpy(np.int64)
        for power in np.unique(powers):
            for rest in range(SEED_RANGE):
                at = np.flatnonzero((powers == power) & (hashes % SEED_RANGE == rest))
                if len(at):
                    at = at[np.argsort(hashes[at], kind="stable")]
                    self.lanes.append((int(power), at, hashes[at]))
        self.kinds: dict[tuple, list] = {}

    def _steps(self, keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes at which the best ``k`` up to there change, and the judges from there on (-1: none yet)."""
        best = np.stack(_kth(keys, self.k), axis=1)
        new = np.flatnonzero(np.any(best[1:] != best[:-1], axis=1)) + 1
        at = np.concatenate([[0], new])
        judge = self.n - 1 - best[at] % self.n
        return hashes[at], np.where(best[at] == np.iinfo(np.int64).min, -1, judge)

    def _kind(self, key: tuple, case: pd.DataFrame) -> list:
        if key not in self.kinds:
            if len(self.kinds) >= KEPT_KINDS:
                self.kinds.clear()
            whole = _whole(_share(self.state, case, np.arange(self.n)[None, :]), 0)[0].astype(np.int64)
            lanes = []
            for power, at, hashes in self.lanes:
                # Equal scores go to the earlier place.
                keys = whole[at] * self.n + (self.n - 1 - at)
                low = self._steps(keys, hashes)
                high = self._steps(keys[::-1], -hashes[::-1])
                lanes.append((power, low, high))
            self.kinds[key] = lanes
        return self.kinds[key]

    def of(self, cases: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of the cases of one kind, and per case the places of the judges to score (-1: no judge)."""
        kinds = pd.DataFrame({"wanted": cases["category"].to_numpy(str), "demand": _demand(cases),
                              "risk": np.clip(cases["risk"].to_numpy(float) / 100, 0.55, 1)})
        seeds = cases["seed_hash"].to_numpy(np.uint64)
        for key, at in kinds.groupby(["wanted", "demand", "risk"], sort=False, dropna=False).indices.items():
            found, turn = [], {}
            for power, (lows, low), (highs, high) in self._kind(key, cases.iloc[at[:1]]):
                if power not in turn:
                    # Name hashes from here on overflow.
                    turn[power] = (1 << 32) - ((seeds[at] * np.uint64(power)) & MASK).astype(np.int64)
                below = np.searchsorted(lows, turn[power], "left") - 1
                above = np.searchsorted(highs, -turn[power], "right") - 1
                found += [np.where((below >= 0)[:, None], low[below], -1), np.where((above >= 0)[:, None], high[above], -1)]
            yield at, np.concatenate(found, axis=1)


def _larger(frames: Iterator[pd.DataFrame], rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Batches put together, as a kind of case costs the same for one row as for many."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= rows:
            yield pd.concat(held, ignore_index=True)
            held = []
    if held:
        yield pd.concat(held, ignore_index=True)


def _best_of_few(queue: DataFrame, roster: DataFrame, k: int, carry: Sequence[str], judge_carry: Sequence[str]) -> DataFrame:
    """As ``blocks.best_small``, with scores of the judges a ``Chooser`` names only."""
    packed = queue.sparkSession.sparkContext.broadcast(roster.toPandas())
    schema = T.StructType([queue.schema[c] for c in carry] + [roster.schema[c] for c in judge_carry]
                          + [T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def per_partition(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = packed.value
        chooser = Chooser(table, k) if len(table) else None
        for frame in _larger(frames):
            rows, judges, scores, ranks = [], [], [], []
            for at, few in chooser.of(frame) if chooser else ():
                few = np.sort(few, axis=1)
                score = np.where(few >= 0, np.round(_score(chooser.state, frame.iloc[at], few), 9), -np.inf)
                # Places ascend, so a stable order breaks ties by place.
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                r, c = np.repeat(np.arange(len(at)), order.shape[1]), order.ravel()
                good = np.isfinite(score[r, c])
                rows.append(at[r][good])
                judges.append(few[r, c][good])
                scores.append(score[r, c][good])
                ranks.append(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(at))[good])
            if rows:
                out = pd.concat([frame[list(carry)].iloc[np.concatenate(rows)].reset_index(drop=True),
                                 table[list(judge_carry)].iloc[np.concatenate(judges)].reset_index(drop=True)], axis=1)
                out["score"], out["rank"] = np.concatenate(scores), np.concatenate(ranks)
                yield out

    return queue.mapInPandas(per_partition, schema)


def rank_judges(cases: DataFrame, judges: DataFrame, k: int = 1, seed: str = "seed", limit: int = SMALL_ROWS) -> DataFrame:
    """The best ``k`` judges of every case; see ``_ranked``."""
    return _ranked(cases, judges, k, seed, limit).drop("wanted")


def _seed_hash(seed: Column) -> Column:
    """``hashing.rolling31`` for seeds that may be whole texts."""

    @F.arrow_udf("bigint")
    def hashed(seeds: pa.Array) -> pa.Array:
        return W.rolling31(seeds)

    return hashed(seed)


def _ranked(cases: DataFrame, judges: DataFrame, k: int = 1, seed: str = "seed", limit: int = SMALL_ROWS) -> DataFrame:
    """Best ``k`` judges per case, by score, then lower utilisation, then name.

    ``cases`` needs ``case_id, category, severity, risk`` and a seed text. Of the roster only
    the undominated ``contenders`` are used. Up to ``limit`` of them are shipped to the cases, which
    stay where they are, and a case is scored against the few its ``Chooser`` names; more are scored
    in case-block x roster-cell groups.
    """
    roster = _fewest(contenders(_roster_columns(judges), k), k, limit)
    queue = cases.select(
        "case_id", "category", "severity", "risk",
        _seed_hash(F.concat(X.blank(seed), F.lit(":"))).alias("seed_hash"),
    )
    kept = ["case_id", "severity", "risk", F.col("category").alias("wanted")]
    if fits(roster, limit):
        ordered = roster.orderBy("utilization", "judge_name", "judge_id").select(
            *roster.columns, F.col("category").alias("judge_category")
        )
        best = _best_of_few(
            queue, ordered, k, ["case_id", "category", "severity", "risk"],
            ["judge_id", "judge_name", "utilization", "availability", "used", "judge_category"],
        ).withColumnRenamed("category", "wanted")
    else:
        from docketry.plans.ordinal import with_ordinal

        numbered = with_ordinal(roster, [F.col("utilization"), F.col("judge_name"), F.col("judge_id")], "ord")
        carry = ["ord", "judge_id", "judge_name", "utilization", "availability", "used", "category"]
        found = P.top_rows(
            numbered, queue.withColumnRenamed("case_id", "query_id"), lambda q: q,
            lambda q, rows, floors: _score(_prepare(rows), q).T, k, carry,
        )
        best = found.withColumnRenamed("query_id", "case_id").withColumnRenamed("category", "judge_category").drop(
            "ord"
        ).join(cases.select(*kept), "case_id")
    return best.select(
        "case_id", F.col("rank").cast("int").alias("rank"), "judge_id", "judge_name",
        F.col("score").cast("int").alias("score"), "utilization", "availability", judge_reason().alias("reason"), "wanted",
    )


def judge_reason() -> Column:
    # fixed values: the sentence's parts
    fit = F.when(F.col("judge_category") == F.col("wanted"), "strong category fit").otherwise("acceptable fallback fit")
    status = F.when(F.col("availability") == "Available", "available").otherwise(F.lower("availability"))
    # The thresholds are compared with the load fraction, not with the percentage.
    load = (
        F.when(F.col("used") >= 85, "high current load").when(F.col("used") >= 60, "moderate current load")
        .otherwise("low current load")
    )
    risk = (
        F.when(F.col("risk") >= 80, "critical risk profile").when(F.col("risk") >= 60, "elevated risk profile")
        .otherwise(F.concat(F.lower("severity"), F.lit(" severity")))
    )
    return F.concat(
        F.lit("Selected for "), fit, F.lit(", "), status, F.lit(" status, "), load, F.lit(", and "), risk, F.lit(".")
    )


def assign_judges(cases: DataFrame, judges: DataFrame, seed: str = "seed") -> DataFrame:
    """Rank 1 per case, read once, with party label and prosecutor flag. An empty roster is replaced
    by the stand-in judges of the category."""
    if judges.isEmpty():
        stand_in = fallback_roster(cases.sparkSession)
        parts = [
            _ranked(cases.filter(F.col("category") == c), stand_in.filter(F.col("category") == c), 1, seed)
            for c in ("Criminal", "Civil", "Other")
        ]
        ranked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    else:
        ranked = _ranked(cases, judges, 1, seed)
    criminal = F.col("category") == "Criminal"
    return ranked.drop("rank").withColumnRenamed("wanted", "category").select(
        "*", F.when(criminal, "Accused").otherwise("Defendant").alias("party_label"),
        criminal.alias("requires_public_prosecutor"),
    )


def assign_queue(texts: DataFrame, judges: DataFrame, rules: L.TriageRules = L.TriageRules()) -> DataFrame:
    """Triage a queue of texts (``case_id, text``) and assign a judge to each."""
    return assign_judges(triage(texts, rules), judges, seed="text")


# ---- roster views --------------------------------------------------------------
def in_district(district: str) -> Column:
    """Empty district on either side matches."""
    mine = F.lower(X.blank("district"))
    return F.lit(not district) | (mine == "") | mine.contains((district or "").lower())


def available_judges(judges: DataFrame, district: str = "", case_type: str | None = None,
                     only_available: bool = False, hearings: DataFrame | None = None,
                     date: str | None = None) -> DataFrame:
    """Roster for a place and case type, sorted by status, load and experience. With a
    date, ``scheduled_dates`` repeats it once per hearing the judge has on that day."""
    out = judges.filter(in_district(district))
    if case_type:
        fits_type = F.col("category") == case_type
        if "specializations" in judges.columns:
            fits_type = fits_type | F.coalesce(F.array_contains("specializations", case_type), F.lit(False))
        out = out.filter(fits_type)
    if only_available:
        out = out.filter(F.col("availability") == "Available")
    if date and hearings is not None:
        booked = (
            hearings.filter(F.col("hearing_date") == F.lit(date)).groupBy("judge_id")
            .agg(F.count(F.lit(1)).cast("int").alias("__n"))
        )
        out = out.join(booked, out["id"] == booked["judge_id"], "left").select(
            *judges.columns, F.array_repeat(F.lit(date), F.coalesce("__n", F.lit(0))).alias("scheduled_dates")
        )
    status = F.when(F.col("availability") == "Available", 0).when(F.col("availability") == "Busy", 1).when(
        F.col("availability") == "On Leave", 2
    ).otherwise(3)
    return out.orderBy(status, "current_case_load", F.desc("years_of_experience"), "id")


def judge_status(judges: DataFrame, hearings: DataFrame, k: int = 5) -> DataFrame:
    """Utilisation, free flag and the next ``k`` hearings of every judge. The rank limit is
    applied before the exchange, so a judge holding a third of all hearings sends ``k``
    rows per task."""
    w = Window.partitionBy("judge_id").orderBy("hearing_date", "slot", "id")
    upcoming = (
        hearings.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).groupBy("judge_id")
        .agg(F.sort_array(F.collect_list(F.struct("__n", "id"))).alias("__h"))
    )
    capacity = F.coalesce("case_load_capacity", F.lit(0))
    used = F.when(capacity > 0, F.col("current_case_load") / capacity * 100).otherwise(0.0)
    return judges.join(upcoming, judges["id"] == upcoming["judge_id"], "left").select(
        judges["id"].alias("judge_id"), "name", "availability", "current_case_load", "case_load_capacity",
        X.round_half_up(used).alias("utilization_percent"),
        ((F.col("availability") == "Available") & (F.col("current_case_load") < capacity * 0.8)).alias("is_free"),
        F.coalesce(F.transform("__h", lambda h: h["id"]), F.array().cast("array<string>")).alias("upcoming"),
    )


def roster_counts(judges: DataFrame, district: str = "") -> DataFrame:
    """Per category and for all: total, available, busy, on leave."""
    status = F.col("availability")
    return (
        judges.filter(in_district(district)).rollup("category")
        .agg(
            F.count(F.lit(1)).alias("total"), F.count_if(status == "Available").alias("available"),
            F.count_if(status == "Busy").alias("busy"), F.count_if(status == "On Leave").alias("on_leave"),
        )
        .withColumn("category", F.coalesce("category", F.lit("All")))
    )


def roster_capacity(judges: DataFrame) -> DataFrame:
    load, capacity = F.sum("current_case_load"), F.sum("case_load_capacity")
    return judges.agg(
        capacity.alias("total_capacity"), load.alias("total_load"),
        F.when(capacity > 0, X.round_half_up(load / capacity * 100)).alias("load_percent"),
        F.count_if(F.col("availability") == "Available").alias("available"),
    )
