"""Joins with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of at least one in so many rows are hot; there cannot be more of them than this.
HOT_KEYS = 1000
#: A key of fewer rows is never hot.
LEAST_HOT = 1000


def hot_at(total: int) -> int:
    """Rows from which a key of ``total`` rows is hot: at most ``HOT_KEYS`` keys reach it."""
    return max(LEAST_HOT, -(-total // HOT_KEYS))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group (inner join); ``groups`` has one narrow row a key.

    ``n`` names the column with the rows of a key (or a number not below), ``total`` is the number of rows at least.
    Rows of hot keys stay where they are and get their group by broadcast, of ``HOT_KEYS`` rows at most; the
    others are shuffled, and none of their keys is hot; with fewer than ``LEAST_HOT`` rows no key can be. ``rows`` is read twice: it should be a stored table.
    """
    if total < LEAST_HOT:
        return rows.join(groups, keys)
    cut = hot_at(total)
    hot, cold = groups.where(F.col(n) >= cut), groups.where(F.col(n) < cut)
    spread = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return spread.unionByName(rest)
