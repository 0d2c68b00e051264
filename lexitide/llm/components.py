"""Connected components of a link table, by Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.runtime import Scratch


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b) but the smallest of each component, which is the component.

    Alternates two steps until nothing changes: every node hangs its larger neighbours, and then its smaller
    ones, on the smallest node it knows (large star, small star). The number of edges never grows, no
    group is gathered anywhere: the steps are a min by key and a join, and hot keys are split like any skewed join."""
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        # large has edges from larger to smaller nodes only
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = scratch.save(small, "small")
        scratch.drop(edges, large)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def smallest_names(grouped: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(id, component_id): for every id of the components, the smallest name, of names (id, name), in its component."""
    everyone = grouped.select("id", "component").unionByName(grouped.select(F.col("component").alias("id"), "component").distinct())
    lowest = everyone.join(names.select("id", name), "id").groupBy("component").agg(F.min(name).alias("component_id"))
    return everyone.join(lowest, "component").select("id", "component_id")
