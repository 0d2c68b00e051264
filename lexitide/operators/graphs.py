"""Graphs kept as edge tables: bipartite networks, statistics by graph, co-presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.numeric import correlation
from lexitide.operators.shape import top_k
from lexitide.runtime import Scratch


def bipartite(df: DataFrame, left: str, right: str, weight: str, k: int) -> DataFrame:
    """Edges (left, right, weight) of each left node's k heaviest right nodes."""
    n = df.groupBy(left, right).agg(F.sum(weight).alias("weight"))
    return top_k(n, [left], k, F.desc("weight"), right).select(left, right, "weight")


def degrees(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, degree) of undirected edges a, b; repeated edges count once."""
    own = edges.where("a <> b").select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # written, so that a task doesn't hold the edges and the nodes at once
    own = Scratch(edges.sparkSession, "graphs").save(own, "edges")
    return own.select(*by, F.explode(F.array("a", "b")).alias("node")).groupBy(*by, "node").agg(F.count("*").alias("degree"))


def statistics(edges: DataFrame, by: str, diameters: bool = True) -> DataFrame:
    """Nodes, edges, density, mean clustering, Gini of degrees, degree assortativity and diameter of the largest part.

    Graphs are edge rows (by, a, b), repeated and reversed ones once; loops are left out. Triangles are found from each edge's end with the
    lower degree, so no node's pairs of neighbours grow beyond the root of twice the edges; the Gini goes by counts of
    degrees. Diameters take a row for each pair of nodes in a part, so large networks are better asked without."""
    scratch = Scratch(edges.sparkSession, "graphs")
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    own = scratch.save(edges.where("a <> b").select(F.col(by).alias("g"), low, high).distinct(), "edges")
    both = own.unionByName(own.select("g", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = scratch.save(both.groupBy("g", F.col("a").alias("node")).agg(F.count("*").alias("d")), "degrees")
    size = degree.groupBy("g").agg(F.count("*").alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"))

    levels = degree.groupBy("g", "d").agg(F.count("*").alias("c")).join(size.select("g", "nodes"), "g")
    before = F.sum("c").over(Window.partitionBy("g").orderBy("d")) - F.col("c")  # a row for each degree
    gini = levels.withColumn("r", before).groupBy("g").agg((F.sum(F.col("d") * F.col("c") * (2 * F.col("r") + F.col("c") - F.col("nodes"))) / (F.first("nodes") * F.sum(F.col("d") * F.col("c")))).alias("gini"))

    ends = lambda name, d: degree.select("g", F.col("node").alias(name), F.col("d").alias(d))
    ranked = scratch.save(both.join(ends("a", "da"), ["g", "a"]).join(ends("b", "db"), ["g", "b"]), "ranked")
    mixing = ranked.groupBy("g").agg(correlation(F.col("da"), F.col("db")).alias("assortativity"))
    up = ranked.where("da < db or (da = db and a < b)").select("g", "a", "b")
    x, y = up.select("g", "a", F.col("b").alias("p")), up.select("g", "a", F.col("b").alias("q"))
    wedges = x.join(y, ["g", "a"]).where("p < q")
    found = wedges.join(own.select("g", F.col("a").alias("p"), F.col("b").alias("q")), ["g", "p", "q"])
    corners = found.select("g", F.explode(F.array("a", "p", "q")).alias("node")).groupBy("g", "node").agg(F.count("*").alias("t"))
    local = F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    clustering = degree.join(corners, ["g", "node"], "left").groupBy("g").agg(F.avg(local).alias("clustering"))

    out = size.join(gini, "g").join(mixing, "g").join(clustering, "g")
    density = F.when(F.col("nodes") > 1, 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    columns = [F.col("g").alias(by), "nodes", "edges", density.alias("density"), "clustering", "gini", "assortativity"]
    if not diameters:
        return out.select(columns)
    seen = scratch.save(degree.select("g", F.col("node").alias("source"), "node", F.lit(0).alias("far")), "reached")
    edge, front, far = both.select("g", F.col("a").alias("node"), F.col("b").alias("next")), seen, 0
    while not front.isEmpty():
        far += 1
        step = front.join(edge, ["g", "node"]).select("g", "source", F.col("next").alias("node")).distinct().join(seen, ["g", "source", "node"], "left_anti")
        front = scratch.save(step.withColumn("far", F.lit(far)), "front")
        seen = seen.unionByName(front)
    reach = seen.groupBy("g", "source").agg(F.count("*").alias("part"), F.max("far").alias("far"), F.min("node").alias("first"))
    largest = reach.groupBy("g").agg(F.min_by("first", F.struct(-F.col("part"), "first")).alias("first"))
    diameter = reach.join(largest, ["g", "first"]).groupBy("g").agg(F.max("far").cast("long").alias("diameter"))
    return out.join(diameter, "g").select(*columns[:5], "diameter", *columns[5:])


def betweenness(edges: DataFrame, by: str) -> DataFrame:
    """(by, node, betweenness): of the shortest paths between two other nodes, the mean share that passes the node.

    Layers of all sources grow at once and carry the number of shortest paths; from the last one back, each node gets its share of the paths
    beyond it. A layer's neighbours are in it, the one before or the next, so only two layers are compared. As diameters do, this takes a row
    for each pair of nodes in a part. Graphs of fewer than three nodes have 0 throughout."""
    scratch = Scratch(edges.sparkSession, "graphs")
    own = edges.where("a <> b").select(F.col(by).alias("g"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edge = own.select("g", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next")))).alias("e"))
    edge = scratch.save(edge.select("g", "e.*"), "edges")
    key = ["g", "source", "node"]
    nodes = scratch.save(edge.select("g", "node").distinct(), "nodes")
    layers = [nodes.select("g", F.col("node").alias("source"), "node", F.lit(1.0).alias("paths"))]
    while not layers[-1].isEmpty():
        step = layers[-1].join(edge, ["g", "node"]).groupBy("g", "source", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        for old in layers[-2:]:
            step = step.join(old, key, "left_anti")
        layers.append(scratch.save(step, "layer"))
    passed = nodes.select("g", "node", F.lit(0.0).alias("passed"))
    beyond = layers[-1].withColumn("passed", F.lit(0.0))
    for layer in layers[-2:0:-1]:  # no path passes its source
        share = beyond.join(edge, ["g", "node"]).groupBy("g", "source", F.col("next").alias("node")).agg(F.sum((1 + F.col("passed")) / F.col("paths")).alias("share"))
        beyond = scratch.save(layer.join(share, key, "left").select(*key, "paths", F.coalesce(F.col("paths") * F.col("share"), F.lit(0.0)).alias("passed")), "passed")
        passed = passed.unionByName(beyond.select("g", "node", "passed"))
    sums = passed.groupBy("g", "node").agg(F.sum("passed").alias("passed")).join(nodes.groupBy("g").agg(F.count("*").alias("n")), "g")
    return sums.select(F.col("g").alias(by), "node", F.when(F.col("n") > 2, F.col("passed") / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness"))


def co_presence(df: DataFrame, a: str, b: str) -> DataFrame:
    """The smaller over the larger of two counts; null if both are 0."""
    return df.withColumn("co_presence", F.try_divide(F.least(a, b), F.greatest(a, b)))
