"""Joins of rows with one row per key, for keys of any size.

An aggregate that feeds a join directly leaves a hot key in one task, and adaptive
execution can't split it. Here the keys above a counted share are joined where their rows
lie, by a broadcast of at most ``HOT_KEYS`` rows, and only the others are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.plans.tables import stored

# A key is hot above this share of all rows, so there are fewer hot keys than its inverse.
HOT_KEYS = 1_000


def join_by_key(rows: DataFrame, single: DataFrame, keys: Sequence[str], count: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` with ``single``, which has one row per key and its number of rows in ``count``.

    Null keys match nothing, as in any join. A key is hot with more than one
    ``hot_keys``-th of the counted rows, so at most ``hot_keys`` rows are broadcast.
    """
    keys = list(keys)
    single = stored(single, "by-key")
    total = single.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * hot_keys > total
    hot = single.where(is_hot)
    if hot.isEmpty():
        # No key is hot: one join, and the rows are read once.
        return rows.join(single, keys)
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(single.where(~is_hot), keys)
    return near.unionByName(far.select(*near.columns))
