"""From text scores to arcs: match groups, bins, subgroups, corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.bins import bin_start
from lexitide.operators.norms import first_by


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    return first_by(df, keys, F.desc(version))


def representatives(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(group_id, _id) of the oldest text of each group, the smallest id among equals."""
    return groups.join(texts.select("_id", "year"), "_id").groupBy("group_id").agg(F.min_by("_id", F.struct(F.col("year").isNull(), "year", "_id")).alias("_id"))


def group_scores(reps: DataFrame, groups: DataFrame, scores: DataFrame, columns: list[str]) -> DataFrame:
    """Each representative gets the mean over its group's scored members; one in no group its own score.

    A representative without any scored member is absent. Group 0 is a group like others."""
    own, other = groups.select(F.col("_id").alias("__m"), "group_id"), groups.select("_id", "group_id")
    matched = reps.select("_id").join(other, "_id").select(F.col("_id").alias("rep"), "group_id").join(own, "group_id").select("rep", F.col("__m").alias("member"))
    single = reps.select("_id").join(groups.select("_id"), "_id", "left_anti").select(F.col("_id").alias("rep"), F.col("_id").alias("member"))
    members = matched.unionAll(single).join(scores.withColumnRenamed("_id", "member"), "member")
    return members.groupBy(F.col("rep").alias("_id")).agg(*(F.avg(c).alias(c) for c in columns), F.countDistinct("member").alias("n_versions"))


def path_sets(items: DataFrame, group: str, path: str) -> DataFrame:
    """Distinct sets of paths, each with its smallest group."""
    sets = items.groupBy(group).agg(F.array_sort(F.collect_set(path)).alias("paths"))
    return sets.groupBy("paths").agg(F.min(group).alias(group))


def where(df: DataFrame, genres=None, corpora=None, title: str | None = None, years=(None, None), score: str | None = None, translated: bool | None = None) -> DataFrame:
    """Chained optional predicates; the title is a literal part, not a pattern."""
    tests: list[Column] = []
    if genres:
        tests.append(F.col("genre").isin(*genres))
    if corpora:
        tests.append(F.col("corpus").isin(*corpora))
    if title:
        tests.append(F.contains(F.lower("title"), F.lit(title.lower())))
    if years[0] is not None:
        tests.append(F.col("year") >= years[0])
    if years[1] is not None:
        tests.append(F.col("year") <= years[1])
    if score:
        tests.append(F.col(score).isNotNull())
    if translated is not None:
        tests.append(F.coalesce(F.col("is_translated"), F.lit(False)) == translated)
    for t in tests:
        df = df.where(t)
    return df


def with_prefix(df: DataFrame, prefix: str, column: str = "_id") -> DataFrame:
    """A literal prefix: an underscore is no wildcard."""
    return df.where(F.col(column).startswith(prefix))


def bounded_years(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """bounds: corpus, lo, hi; inclusive, a missing bound or corpus leaves it open."""
    out = df.join(bounds, "corpus", "left")
    return out.where((F.col("year") >= F.coalesce("lo", F.col("year"))) & (F.col("year") <= F.coalesce("hi", F.col("year")))).drop("lo", "hi")


def in_lifetime(df: DataFrame) -> DataFrame:
    """Published while the author lived; what can't be told goes."""
    return df.where(F.coalesce((F.col("year") >= F.col("born")) & (F.col("year") <= F.col("died")), F.lit(False)))


def bin_means(df: DataFrame, value: str, size: int, by: list[str] | None = None, least: int = 1) -> DataFrame:
    by = by or []
    out = df.where(F.col(value).isNotNull()).groupBy(bin_start(F.col("year"), size).alias("bin"), *by).agg(F.avg(value).alias("mean"), F.count("*").alias("n_texts"))
    return out.where(F.col("n_texts") >= least)


def top_or_other(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Values of the column beyond the k most frequent become Other; ties by value."""
    top = df.groupBy(column).count().orderBy(F.desc("count"), column).limit(k).select(F.col(column).alias("__top"))
    out = df.join(F.broadcast(top), df[column] == F.col("__top"), "left")
    return out.withColumn(column, F.when(F.col("__top").isNotNull(), F.col(column)).otherwise("Other")).drop("__top")


def over_corpora(points: DataFrame, keys: list[str]) -> DataFrame:
    """Means of corpus points, weighted by their texts."""
    return points.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n_texts")) / F.sum("n_texts")).alias("mean"), F.sum("n_texts").alias("n_texts"))


def mean_and_error(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def standardised(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The value over the whole frame's sample deviation, then mean, error and count by group."""
    stats = df.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    out = df.join(F.broadcast(stats)).withColumn("__z", (F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))
    return mean_and_error(out, "__z", by)


def summary(df: DataFrame, least: int = 1) -> DataFrame:
    """By corpus: texts, dated texts, their first and last year, and the genres."""
    dated = F.col("year").isNotNull()
    out = df.groupBy("corpus").agg(
        F.count("*").alias("n"), F.count_if(dated).alias("n_dated"), F.min(F.when(dated, F.col("year"))).alias("first"), F.max(F.when(dated, F.col("year"))).alias("last"), F.array_join(F.array_sort(F.collect_set("genre")), ",").alias("genres")
    )
    return out.where(F.col("n") >= least)


def sanity(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("null_share"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))


def page(df: DataFrame, *order: Column | str, offset: int, size: int) -> DataFrame:
    """One page of a total order, with the number of all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))
