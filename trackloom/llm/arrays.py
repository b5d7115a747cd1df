"""Small building blocks for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """All prefixes of an array combined, by doubling: n values take log2(n) rounds over the array."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))

    def double(acc: Column, d: Column) -> Column:
        return F.transform(acc, lambda x, i: combine(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2), d).cast("int")), F.lit(zero))))

    return F.aggregate(rounds, values, double)
