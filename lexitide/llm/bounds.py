"""Bounded samples, and joins whose hot keys are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; there are fewer hot keys than its inverse.
HOT = 1 / 1000


def sample(rows: DataFrame, bound: int, *columns: str) -> DataFrame:
    """All of rows, or the bound of them with the smallest hashes of columns, which tell rows apart.

    A sorted limit sends up to bound rows of every partition to one task, so only rows below a hash that is
    surely enough are sorted: little more than bound, however many partitions there are."""
    n = rows.count()
    if n <= bound:
        return rows
    most = (1 << 63) - 1
    h = F.shiftrightunsigned(F.xxhash64(*columns), 1)
    near = rows.where(h <= min(most, int((bound + 6 * bound**0.5 + 20) / n * most)))
    return near.orderBy(h, *columns).limit(bound)


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """left join by key, where right has one row for each key and, as count, how many of the total rows of left have it.

    Hot keys, at most 1 / HOT of them, are broadcast; the other keys meet in a shuffle, in which none is large. Null
    keys of left don't travel. left is read up to three times, so it should be a saved table."""
    hot = right.where(F.col(count) > max(1.0, HOT * total))
    cold = right.where(F.col(count) <= max(1.0, HOT * total))
    known = left.where(F.col(key).isNotNull())
    often = known.join(F.broadcast(hot), key)
    seldom = known.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    others = [c for c in right.columns if c != key]
    none = left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in others))
    names = [*left.columns, *others]
    return often.select(names).unionByName(seldom.select(names)).unionByName(none.select(names))
