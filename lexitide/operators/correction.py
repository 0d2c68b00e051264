"""Collection bias: within-group estimates of what a collection adds to a score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.runtime import Scratch
from lexitide.sources.stores import read_version, write_version


def component_of(edges: list[tuple[str, str]], start: str) -> set[str]:
    """Corpora that share groups with start, directly or not: tens of names, so on the driver."""
    seen, todo = {start}, [start]
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    while todo:
        for other in near.get(todo.pop(), set()) - seen:
            seen.add(other)
            todo.append(other)
    return seen


def calibration_rows(scores: DataFrame, least_groups: int, reference: str) -> tuple[DataFrame, set[str]]:
    """(group_id, corpus, score) means of groups in several corpora, of corpora with enough groups in the reference's component.

    Raises ValueError if the reference drops out. scores: group_id, corpus, score."""
    shared = lambda df: df.join(df.groupBy("group_id").agg(F.countDistinct("corpus").alias("__k")).where("__k > 1").select("group_id"), "group_id", "left_semi")
    own = shared(scores.where("score is not null").groupBy("group_id", "corpus").agg(F.avg("score").alias("score")))
    enough = own.groupBy("corpus").agg(F.countDistinct("group_id").alias("n")).where(F.col("n") >= least_groups).select("corpus")
    own = Scratch(scores.sparkSession, "bias").save(shared(own.join(enough, "corpus", "left_semi")), "rows")
    a, b = own.select("group_id", F.col("corpus").alias("a")), own.select("group_id", F.col("corpus").alias("b"))
    edges = [(r["a"], r["b"]) for r in a.join(b, "group_id").where("a < b").select("a", "b").distinct().collect()]  # pairs of corpora
    kept = component_of(edges, reference)
    if len(kept) < 2:
        raise ValueError(f"the reference corpus {reference!r} shares too few groups with others")
    return own.where(F.col("corpus").isin(*kept)), kept


def corpus_bias(scores: DataFrame, reference: str, least_groups: int = 5) -> DataFrame:
    """(corpus, coef, se, n): least squares of score on corpus with group effects; the reference has 0.

    Demeaned within a group of K corpora, the indicators of c and d have the product [c = d] - 1 / K, and that of c with the
    score is the score less the group's mean. So X'X is a sum by pair of corpora over a join of the rows of a group,
    and X'y a sum by corpus; the driver solves a system with a row for each corpus."""
    rows, kept = calibration_rows(scores, least_groups, reference)
    names = sorted(kept - {reference})
    groups = rows.groupBy("group_id").agg(F.avg("score").alias("mean"), F.count("*").alias("k"))
    own = rows.join(groups, "group_id").select("group_id", "corpus", "k", (F.col("score") - F.col("mean")).alias("y"))
    by_corpus = own.groupBy("corpus").agg(F.sum("y").alias("xy"), F.sum(F.col("y") ** 2).alias("yy"), F.count("*").alias("n")).collect()
    a, b = own.select("group_id", F.col("corpus").alias("c"), "k"), own.select("group_id", F.col("corpus").alias("d"))
    pairs = a.join(b, "group_id").groupBy("c", "d").agg(F.sum(F.when(F.col("c") == F.col("d"), 1.0).otherwise(0.0) - 1 / F.col("k")).alias("xx")).collect()
    at = {c: i for i, c in enumerate(names)}
    xx, xy = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in pairs:
        if r["c"] in at and r["d"] in at:
            xx[at[r["c"]], at[r["d"]]] = r["xx"]
    for r in by_corpus:
        if r["corpus"] in at:
            xy[at[r["corpus"]]] = r["xy"]
    n, yy = sum(r["n"] for r in by_corpus), sum(r["yy"] for r in by_corpus)
    coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
    dof = n - groups.count() - len(names)
    sse = max(0.0, yy - 2 * coef @ xy + coef @ xx @ coef)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)), 0) * (sse / dof if dof > 0 else np.nan))
    counts = rows.groupBy("corpus").agg(F.count("*").alias("n"))
    table = scores.sparkSession.createDataFrame([(reference, 0.0, 0.0), *((c, float(b), float(s)) for c, b, s in zip(names, coef, se))], "corpus string, coef double, se double")
    return table.join(counts, "corpus", "left")


def corrected(scores: DataFrame, bias: DataFrame, value: str = "score") -> DataFrame:
    """Scores less their corpus's coefficient; corpora without one stay."""
    return scores.join(bias.select("corpus", "coef"), "corpus", "left").withColumn(value, F.col(value) - F.coalesce("coef", F.lit(0.0))).drop("coef")


def merged(*tables: DataFrame) -> DataFrame:
    """Bias tables of several languages; of a corpus in several the last one counts."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("__i", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    keep = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("__i")))
    return out.withColumn("__n", keep).where("__n = 1").drop("__n", "__i")


BIAS = "corpus string, coef double, se double, n long"


def save_bias(bias: DataFrame, path: str, lang: str) -> None:
    """Keeps the table of a language; other languages' stay."""
    write_version(bias.select("corpus", "coef", "se", F.col("n").cast("long").alias("n")), path, lang=lang)


def load_bias(spark: SparkSession, path: str, *langs: str) -> DataFrame:
    """The tables of these languages as one; of a corpus in several the last one counts, a language without a table adds nothing."""
    return merged(*(read_version(spark, path, BIAS, lang=lang) for lang in langs))
