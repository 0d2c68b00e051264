"""Exact order statistics of groups of any size: quantiles, medians, the k-th row, Gini coefficients.

Equal values are counted first, so a frequent value is one row. The counts are sorted over all tasks by range of (group, value); running
counts are taken within a task's range and carried on by one row for each group and range. A group that holds all rows is
spread over all ranges, and no task needs a group whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.runtime import Scratch


def places(df: DataFrame, by: list[str], order: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """(by, order, __n, __last, __all): how many rows have these values, how many of the group stand up to them, and the group's rows.

    Nulls come first, or last where descending, as Spark sorts them; null groups are groups."""
    scratch = Scratch(df.sparkSession, "places")
    sort = [F.desc(c) if c in descending else F.asc(c) for c in order]
    counted = df.groupBy(*by, *order).agg(F.count("*").alias("__n"))
    ranged = scratch.save(counted.repartitionByRange(*by, *sort).withColumn("__part", F.spark_partition_id()), "ranges")
    # a row for each group and each range that has a part of it
    sums = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__sum"))
    whole = Window.partitionBy(*by)
    ahead = sums.withColumn("__ahead", F.sum("__sum").over(whole.orderBy("__part")) - F.col("__sum")).withColumn("__all", F.sum("__sum").over(whole)).drop("__sum")
    ahead = ahead.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__p"), "__ahead", "__all")
    here = F.col("__part") == F.col("__p")
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    running = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy(*sort))
    return ranged.withColumn("__run", running).join(ahead, here).select(*by, *order, "__n", (F.col("__run") + F.col("__ahead")).alias("__last"), "__all")


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(by, a column for each wanted share) of the values that aren't null, interpolated between neighbours; groups without values are left out."""
    rows = places(df.where(F.col(value).isNotNull()), by, [value])
    x, first = F.col(value).cast("double"), F.col("__last") - F.col("__n")
    cells = []
    for name, p in wanted.items():
        at = F.lit(float(p)) * (F.col("__all") - 1)
        for end, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            cells.append(F.max(F.when((first <= k) & (k < F.col("__last")), x)).alias(f"__{name}_{end}"))
    got = rows.groupBy(*by).agg(F.max("__all").alias("__all"), *cells)
    part = lambda p: F.lit(float(p)) * (F.col("__all") - 1) - F.floor(F.lit(float(p)) * (F.col("__all") - 1))
    return got.select(*by, *((F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * part(p)).alias(n) for n, p in wanted.items()))


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the exact median under the value's name."""
    return quantiles(df, by, value, {value: 0.5})


def middle_rows(df: DataFrame, by: list[str], order: list[str], descending: tuple[str, ...] = ()) -> DataFrame:
    """The row in the middle of each group, the later of two; order should tell rows apart (of equal ones any is taken)."""
    k = F.floor(F.col("__all") / 2)
    found = places(df, by, order, descending).where((F.col("__last") - F.col("__n") <= k) & (k < F.col("__last")))
    found = found.select(*(F.col(c).alias(f"__m_{c}") for c in [*by, *order]))
    same = F.lit(True)
    for c in [*by, *order]:
        same = same & F.col(c).eqNullSafe(F.col(f"__m_{c}"))
    return df.join(found, same, "left_semi").dropDuplicates(by)


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of a value that isn't negative; a value's copies stand on neighbouring ranks."""
    rows = places(df.where(F.col(value).isNotNull()), by, [value])
    v, n = F.col(value).cast("double"), F.col("__n")
    ranks = n * (2 * F.col("__last") - n + 1) / 2
    got = rows.groupBy(*by).agg(F.sum(v * ranks).alias("rv"), F.sum(v * n).alias("v"), F.max("__all").alias("n"))
    return got.select(*by, F.try_divide(2 * F.col("rv") - (F.col("n") + 1) * F.col("v"), F.col("n") * F.col("v")).alias("gini"))
