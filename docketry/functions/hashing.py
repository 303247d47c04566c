"""Hash columns in 64-bit arithmetic masked to 32 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import ColumnLike, blank, col, let

MASK = 4294967295
# fixed values: FNV prime and the two seeds, vector width
PRIME = 16777619
SEED_A = 2166136261
SEED_B = 16777619
DIMS = 192


def fnv1a(token: ColumnLike, seed: int) -> Column:
    """FNV-1a of an ASCII token as BIGINT."""
    return F.aggregate(
        F.split(col(token), ""),
        F.lit(seed).cast("bigint"),
        lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(PRIME).cast("bigint")).bitwiseAND(
            F.lit(MASK).cast("bigint")
        ),
    )


def rolling31(value: ColumnLike) -> Column:
    """``h = h * 31 + code unit`` modulo 2^32, as BIGINT."""
    text = blank(value)
    return F.when(text == "", F.lit(0).cast("bigint")).otherwise(
        F.aggregate(
            F.split(text, ""),
            F.lit(0).cast("bigint"),
            lambda h, ch: (h * F.lit(31).cast("bigint") + F.ascii(ch).cast("bigint")).bitwiseAND(
                F.lit(MASK).cast("bigint")
            ),
        )
    )


def bucket_of(value: ColumnLike, n: int) -> Column:
    """Deterministic bucket ``0 .. n - 1`` of a text."""
    return F.pmod(rolling31(value), F.lit(n).cast("bigint")).cast("int")


def buckets(tokens: Column, seed: int, dims: int = DIMS, limit: int | None = None) -> Column:
    """Bucket of each token, or of the first ``limit``. Repeats are kept: this is the
    sparse form of a hashed vector, two bytes per token instead of ``dims`` floats."""
    taken = tokens if limit is None else F.slice(tokens, 1, limit)
    return F.transform(taken, lambda t: F.pmod(fnv1a(t, seed), F.lit(dims)).cast("smallint"))


# Weights are counted in twentieths: 20 for the first hash, 9 or 10 for the second.
UNIT = 20
# Entries that the packed running state of a norm can hold, all in one bucket.
PACKED = 1_600


def squared_norm(first: Column, second: Column, second_weight: float) -> Column:
    """Sum over buckets of (weight in the bucket)^2, by one pass over sorted entries.

    An entry is ``bucket * 64 + weight``. The running state (total, weight so far in the
    bucket, bucket) is kept in one BIGINT, since a struct per step costs several times as
    much. Adding w to a bucket holding r adds w * (2r + w) to the total. Above ``PACKED``
    tokens the state's fields could overflow, and a struct is used.
    """

    def entries(buckets_: Column, weight: int) -> Column:
        return F.transform(buckets_, lambda b: b.cast("int") * F.lit(64) + F.lit(weight))

    def step(state: Column, e: Column) -> Column:
        bucket, w = F.shiftright(e, 6), e.bitwiseAND(F.lit(63))
        run = F.when(state.bitwiseAND(F.lit(255)) == bucket, F.shiftright(state, 8).bitwiseAND(F.lit(32767))).otherwise(
            F.lit(0).cast("bigint")
        )
        total = F.shiftright(state, 23) + w * (run * F.lit(2) + w)
        return (F.shiftleft(total, 23) + F.shiftleft(run + w, 8) + bucket).cast("bigint")

    merged = F.sort_array(
        F.concat(entries(first, UNIT), entries(second, round(second_weight * UNIT)))
    )
    packed = F.aggregate(merged, F.lit(255).cast("bigint"), step, lambda s: F.shiftright(s, 23) / F.lit(UNIT * UNIT))

    def wide(state: Column, e: Column) -> Column:
        bucket, w = F.shiftright(e, 6), e.bitwiseAND(F.lit(63)).cast("bigint")
        run = F.when(state["bucket"] == bucket, state["run"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct((state["total"] + w * (run * 2 + w)).alias("total"), (run + w).alias("run"), bucket.alias("bucket"))

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("total"), zero.alias("run"), F.lit(-1).alias("bucket"))
    return F.when(F.size(merged) <= PACKED, packed).otherwise(
        F.aggregate(merged, start, wide, lambda s: s["total"] / F.lit(UNIT * UNIT)))


def dense(first: Column, second: Column, second_weight: float, dims: int = DIMS) -> Column:
    """Dense ``ARRAY<FLOAT>`` view of the two bucket lists, for export."""
    return let(
        F.struct(first.alias("a"), second.alias("b")),
        lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)),
            lambda d: (
                F.size(F.filter(s["a"], lambda x: x == d))
                + F.lit(second_weight) * F.size(F.filter(s["b"], lambda x: x == d))
            ).cast("float"),
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense arrays, 0 when either norm is 0."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
