"""Shift-share decompositions of a change in a mean into composition, within and interaction parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(df: DataFrame, keys: list[str], category: str, value: str, period: Column) -> DataFrame:
    """n and mean by keys, category and period (early, late); rows without a period go."""
    return df.withColumn("__p", period).where("__p is not null").groupBy(*keys, F.col(category).alias("category"), "__p").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def shift_share(df: DataFrame, category: str, value: str, period: Column, keys: list[str] | None = None, least: int = 1, missing: str = "zero") -> DataFrame:
    """A row for each category: shares, means and the three effects, each rounded to 6.

    A category that one period lacks has share 0 there, and mean 0 or, with missing="overall", the period's mean over all rows. Shares are of all rows, null categories included; a
    category stays if it has least rows in either period."""
    keys = keys or []
    both = cells(df, keys, category, value, period)
    total = F.sum("n").over(Window.partitionBy(*keys, "__p"))
    both = both.withColumn("share", F.col("n") / total)
    if missing == "overall":
        whole = F.sum(F.col("n") * F.col("mean")).over(Window.partitionBy(*keys, "__p")) / total
        both = both.withColumn("overall", whole)
        over = both.groupBy(*keys).agg(*(F.max(F.when(F.col("__p") == p, F.col("overall"))).alias(f"overall_{p}") for p in ("early", "late")))
    pick = lambda p, c: F.coalesce(F.max(F.when(F.col("__p") == p, F.col(c))), F.lit(0))
    rows = both.where("category is not null").groupBy(*keys, "category").agg(*(pick(p, c).alias(f"{c}_{p}") for p in ("early", "late") for c in ("n", "share", "mean")))
    if missing == "overall":
        rows = (rows.join(over, keys) if keys else rows.join(F.broadcast(over))).withColumns({f"mean_{p}": F.when(F.col(f"n_{p}") == 0, F.coalesce(f"overall_{p}", F.lit(0.0))).otherwise(F.col(f"mean_{p}")) for p in ("early", "late")}).drop("overall_early", "overall_late")
    rows = rows.where((F.col("n_early") >= least) | (F.col("n_late") >= least))
    share, mean = F.col("share_late") - F.col("share_early"), F.col("mean_late") - F.col("mean_early")
    rows = rows.withColumn("composition", F.round(share * F.col("mean_early"), 6))
    rows = rows.withColumn("within", F.round(F.col("share_early") * mean, 6)).withColumn("interaction", F.round(share * mean, 6))
    return rows.withColumn("total", F.round(F.col("composition") + F.col("within") + F.col("interaction"), 6))


def totals(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sums of the rounded effects, rounded to 4."""
    return rows.groupBy(*(keys or [])).agg(*(F.round(F.sum(c), 4).alias(c) for c in ("composition", "within", "interaction", "total")))


def by_facets(df: DataFrame, facets: list[str], value: str, period: Column, least: int = 1) -> DataFrame:
    """All facets in one pass: unpivoted, the facet is a key."""
    tall = df.select(value, period.alias("__when"), *(F.col(c).cast("string").alias(c) for c in facets)).unpivot([value, "__when"], facets, "facet", "label")
    return shift_share(tall, "label", value, F.col("__when"), ["facet"], least)


def within_corpora(df: DataFrame, category: str, value: str, period: Column, least: int = 1) -> DataFrame:
    """Decomposed corpus by corpus, then averaged by the corpora's rows."""
    rows = shift_share(df, category, value, period, ["corpus"], least)
    weight = df.where(period.isNotNull()).groupBy("corpus").agg(F.count("*").alias("w"))
    both = rows.join(F.broadcast(weight), "corpus").withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("category")))
    return both.groupBy("category").agg(*(F.round(F.sum(F.col(c) * F.col("share")), 6).alias(c) for c in ("composition", "within", "interaction")))


def common_only(df: DataFrame, category: str, value: str, period: Column, least: int = 30) -> DataFrame:
    """Only categories with least rows in both periods, shares renormalised over them."""
    both = cells(df, [], category, value, period).where((F.col("n") >= least) & F.col("category").isNotNull())
    both = both.withColumn("k", F.count("*").over(Window.partitionBy("category"))).where("k = 2")
    both = both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("__p")))
    pick = lambda p, c: F.max(F.when(F.col("__p") == p, F.col(c)))
    rows = both.groupBy("category").agg(*(pick(p, c).alias(f"{c}_{p}") for p in ("early", "late") for c in ("share", "mean")))
    share, mean = F.col("share_late") - F.col("share_early"), F.col("mean_late") - F.col("mean_early")
    return rows.select("category", F.round(share * F.col("mean_early"), 6).alias("composition"), F.round(F.col("share_early") * mean, 6).alias("within"), F.round(share * mean, 6).alias("interaction"))
