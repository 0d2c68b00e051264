"""Ranks, rolling means, top-k, samples, cross-tables and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share_in(n: str, *by: str) -> Column:
    return F.col(n) / F.sum(n).over(Window.partitionBy(*by))


def average_rank(value: str, *by: str) -> Column:
    """Ties get the mean of their places."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def rolling_mean(value: str, at: str, by: list[str], before: int, after: int, least: int = 1) -> Column:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-before, after)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def top_k(df: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def both_ends(df: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """The k lowest and the k highest, once each."""
    low, high = df.orderBy(value, key).limit(k), df.orderBy(F.desc(value), key).limit(k)
    return low.unionByName(high).dropDuplicates([key])


def hashed_sample(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum: those with the smallest hashes of key and seed. The same rows on every run."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def bernoulli(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Rows whose hash falls under the share: as good as drawn, and the same on every run."""
    return df.where(F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) < share)


def cross_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of pairs with margins; null names stand for all (a and b have none)."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).count()


def row_shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """Long cross-table: the share of b within a."""
    return df.groupBy(a, b).count().withColumn("share", share_in("count", a))


def lift(df: DataFrame, a: str, b: str) -> DataFrame:
    """log2 P(a, b) / (P(a) P(b))."""
    n = df.groupBy(a, b).count()
    total, ta, tb = (F.sum("count").over(Window.partitionBy(*by)) for by in ([], [a], [b]))
    return n.withColumn("log2_lift", F.log2(F.col("count") * total / (ta * tb)))


def subtotals(df: DataFrame, a: str, b: str, num: Column, den: Column) -> DataFrame:
    """Ratios of sums by (a, b), with a row for each a and one for all."""
    return df.rollup(a, b).agg(F.sum(num).alias("num"), F.sum(den).alias("den")).withColumn("ratio", F.try_divide("num", "den"))


def kept_categories(df: DataFrame, category: str, period: str, least_periods: int, least_rows: int) -> DataFrame:
    """Rows of categories that have least_rows in each of at least least_periods periods."""
    cells = df.groupBy(category, period).count().where(F.col("count") >= least_rows)
    good = cells.groupBy(category).agg(F.countDistinct(period).alias("__k")).where(F.col("__k") >= least_periods)
    return df.join(good, category, "left_semi")


def multi_values(df: DataFrame, column: str, pattern: str = r"[|]", least: int = 1) -> DataFrame:
    """Tally of the trimmed parts of a separated string; the empty string is a value."""
    return df.select(F.explode(F.split(column, pattern)).alias("v")).groupBy(F.trim("v").alias("value")).count().where(F.col("count") >= least)


def main_label(df: DataFrame, key: str, labels: str) -> DataFrame:
    """Of each row's labels the most frequent overall; ties go to the one that stands first."""
    rows = df.select(key, F.posexplode(labels).alias("at", "label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    return rows.join(counts, "label").groupBy(key).agg(F.max_by("label", F.struct("n", -F.col("at"))).alias("label"))


def measures_by(df: DataFrame, axes: list[str], measures: list[str], least: int = 1) -> DataFrame:
    """Long table of mean and count of every measure in every category of every axis."""
    tall = df.select(*measures, *(F.col(a).cast("string").alias(a) for a in axes)).unpivot(measures, axes, "axis", "category").where("category is not null")
    tall = tall.select("axis", "category", *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(["axis", "category"], measures, "measure", "value")
    out = tall.where("value is not null").groupBy("axis", "category", "measure").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.where(F.col("n") >= least)


def from_baseline(df: DataFrame, period: str, value: str) -> DataFrame:
    """Adds baseline, the mean of value in the period, and the row's deviation from it."""
    means = df.groupBy(F.col(period).alias("__p")).agg(F.avg(value).alias("baseline"))  # a row for each period, joined back
    return df.join(means, F.col(period).eqNullSafe(F.col("__p"))).drop("__p").withColumn("deviation", F.col(value) - F.col("baseline"))


def detrended_means(df: DataFrame, by: str, x: str, y: str, least: int = 1) -> DataFrame:
    """Mean, 1.96 standard errors and count by group of what a straight line in x leaves of y; two aggregations, one row broadcast."""
    line = df.agg(F.regr_slope(y, x).alias("__slope"), F.regr_intercept(y, x).alias("__base"))
    left = df.crossJoin(F.broadcast(line)).withColumn("__left", F.col(y) - F.col("__base") - F.col("__slope") * F.col(x))
    out = left.groupBy(by).agg(F.count("__left").alias("n"), F.avg("__left").alias("mean"), (1.96 * F.stddev_samp("__left") / F.sqrt(F.count("__left"))).alias("ci"))
    return out.where(F.col("n") >= least)
