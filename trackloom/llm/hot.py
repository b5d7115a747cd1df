"""Joins that hot keys don't send to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is hot; so there are fewer hot keys than its inverse, whatever the table.
HOT = 1 / 1000


def join_by_hot(left: DataFrame, right: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Left join on ``key`` with a table that has one row a key and, in ``copies``, how many rows of ``left`` have it.

    The rows of hot keys, a thousand at most, are broadcast; all others meet by shuffle, none of them in
    over a thousandth of ``total`` rows. Null keys match nothing and must be kept apart by the caller.
    """
    hot = F.broadcast(right.filter(F.col(copies) > total * HOT))
    cold = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(copies) <= total * HOT), key, "left")
    return left.join(hot, key).select(cold.columns).unionByName(cold)
