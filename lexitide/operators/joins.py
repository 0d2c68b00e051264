"""Joins that need more than one equality: fallback keys, ranges, defaults, grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rewritten_keys(df: DataFrame, key: str, rewrites: list[Column]) -> DataFrame:
    """Every row once for each distinct rewrite of its key, with the first rewrite's number."""
    forms = F.array(*(F.struct(F.lit(i).alias("rewrite"), r.alias("k")) for i, r in enumerate(rewrites)))
    out = df.withColumn("__f", F.explode(F.filter(forms, lambda x: x["k"].isNotNull())))
    return out.select(*df.columns, F.col("__f.rewrite").alias("__rewrite"), F.col("__f.k").alias("__key"))


def cascade_join(left: DataFrame, right: DataFrame, key: str, rewrites: list[Column]) -> DataFrame:
    """left with the right row of the first rewrite that finds one; right keys are made unique first (smallest row).

    One join over all rewrites instead of a try for each; rewrites are columns over left."""
    own = [c for c in right.columns if c != key]
    unique = right.groupBy(key).agg(F.min(F.struct(*own)).alias("__r")).withColumnRenamed(key, "__key")
    # only lists of rewrites are looked up, each once; whole rows travel once, by their list
    forms = left.withColumn("__forms", F.array(*rewrites))
    each = forms.select("__forms").distinct().select("__forms", F.posexplode("__forms").alias("__rewrite", "__key")).join(unique, "__key")
    best = each.groupBy("__forms").agg(F.min_by(F.struct("__rewrite", "__r"), "__rewrite").alias("__b"))
    out = forms.join(best, "__forms", "left")
    return out.select(*left.columns, F.col("__b.__rewrite").alias("rewrite"), *(F.col(f"__b.__r.{c}").alias(c) for c in own))


def best_rewrite(left: DataFrame, right: DataFrame, key: str, rewrites: list[Column]) -> DataFrame:
    """How many left keys each rewrite finds; (rewrite, n, share), best first."""
    keys = right.select(F.col(key).alias("__key")).distinct()
    total = left.select(key).distinct().agg(F.count("*").alias("total"))
    hit = rewritten_keys(left.select(key).distinct(), key, rewrites).join(keys, "__key", "left_semi").groupBy("__rewrite").agg(F.count("*").alias("n"))
    return hit.join(F.broadcast(total)).select(F.col("__rewrite").alias("rewrite"), "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "rewrite")


def first_key_match(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str) -> DataFrame:
    """The value of the first of left's keys that right (on, value) has."""
    unique = right.groupBy(F.col(on).alias("__k")).agg(F.min(value).alias("__v"))
    out = left
    for i, k in enumerate(keys):
        out = out.join(unique.select(F.col("__k").alias(f"__k{i}"), F.col("__v").alias(f"__v{i}")), out[k] == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    return out.select(*left.columns, F.coalesce(*(F.col(f"__v{i}") for i in range(len(keys)))).alias(value))


def within_ranges(points: DataFrame, ranges: DataFrame, on: list[str], at: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Points with every range of the same keys that holds them (both ends inclusive).

    Ranges are listed under each block of width positions they touch, so it is an equality join on keys and block with a
    check, not a nested loop; a long range has one entry for each of its blocks."""
    blocks = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))
    spread = ranges.where(F.col(end) >= F.col(start)).withColumn("__b", blocks)
    return points.withColumn("__b", F.floor(F.col(at) / width)).join(spread, [*on, "__b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__b")


def with_default(left: DataFrame, right: DataFrame, on: str, default: dict) -> DataFrame:
    """Left rows with every match; without one, one row with the default values."""
    found = left.join(right, on)
    rest = left.join(right.select(on), on, "left_anti")
    kinds = dict(right.dtypes)
    for c in right.columns:
        if c != on:
            rest = rest.withColumn(c, F.lit(default.get(c)).cast(kinds[c]))
    return found.unionByName(rest)


def filled_grid(df: DataFrame, group: str, at: str, value: str, step: int = 1) -> DataFrame:
    """Each group at every position from the first to the last over all groups; missing values are 0."""
    own = df.groupBy(group, at).agg(F.sum(value).alias(value))
    ends = own.agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    grid = own.select(group).distinct().join(F.broadcast(ends)).select(group, F.explode(F.sequence("lo", "hi", F.lit(step))).alias(at))
    return grid.join(own, [group, at], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def pairs_below(df: DataFrame, on: str, name: str, value: str) -> DataFrame:
    """Self-join of a long table into pairs a < b of names on a key."""
    a, b = df.select(on, F.col(name).alias("a"), F.col(value).alias("x")), df.select(on, F.col(name).alias("b"), F.col(value).alias("y"))
    return a.join(b, on).where("a < b")


def propagated(values: DataFrame, groups: DataFrame, key: str, value: str) -> DataFrame:
    """A value known for one member of a group goes to all of it; the smallest where they differ. Own values stay."""
    known = groups.join(values.where(F.col(value).isNotNull()), key).groupBy("group_id").agg(F.min(value).alias("__g"))
    out = groups.join(known, "group_id", "left").join(values, key, "left")
    return out.select(key, "group_id", F.coalesce(value, "__g").alias(value))


def missing(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to be done. An anti-join: unlike NOT IN, a null on the right removes nothing."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def full_merge(a: DataFrame, b: DataFrame, keys: list[str], suffixes=("_a", "_b")) -> DataFrame:
    both = (set(a.columns) & set(b.columns)) - set(keys)
    a, b = (reduce(lambda d, c: d.withColumnRenamed(c, c + s), both, d) for d, s in zip((a, b), suffixes))
    return a.join(b, keys, "full")


def first_in_order(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def bibliography(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, value: str) -> DataFrame:
    """left with matches, the sorted values of all right rows whose normalised key is its own; null where there are none."""
    own = right.select(right_key.alias("__k"), value).where("__k is not null").groupBy("__k").agg(F.array_sort(F.collect_list(value)).alias("matches"))
    return left.withColumn("__k", left_key).join(own, "__k", "left").drop("__k")
