"""Joins that no hot key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 10_000, 1000


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined to ``facts``, which has one row for each key and in ``count`` the number of
    ``rows`` with that key. Keys of over ``HOT_ROWS`` rows and of over 1 in ``HOT_KEYS`` of all
    rows are broadcast: there are fewer than ``HOT_KEYS`` of them. All others are shuffled, and
    none of them is a large group. Null keys match nothing.

    ``facts`` should be a written table, as it is read three times.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(HOT_ROWS, total // HOT_KEYS)
    few = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(facts.where(~hot), key))
