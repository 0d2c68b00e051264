"""Least squares with several sets of effects, each of any number of levels.

Effects are absorbed by demeaning in turn: the sums of a cell, a combination of levels, are all that it needs, so rows are read once and
a sweep is a join and a sum by level over the cells. The driver solves as many equations as there are regressors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.operators.fits import LEAST_SQUARES
from lexitide.runtime import Scratch

TOLERANCE, SWEEPS = 1e-9, 500


def parts(edges: DataFrame, a: str, b: str, scratch: Scratch) -> int:
    """Number of connected parts of a bipartite graph: the smallest name that reaches a level wins, and names jump to their own level's."""
    pairs = scratch.save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "pairs")
    # a level of a is named by itself; b takes the smallest name among its a's and hands it back
    name = scratch.save(pairs.select("a").distinct().select("a", F.col("a").alias("low")), "names")
    while True:
        of_b = pairs.join(name, "a").groupBy("b").agg(F.min("low").alias("low"))
        near = pairs.join(of_b, "b").groupBy("a").agg(F.min("low").alias("low"))
        jump = near.join(name.select(F.col("a").alias("low"), F.col("low").alias("far")), "low").select("a", F.least("low", "far").alias("low"))
        new = scratch.save(jump, "names")
        moved = new.join(name.select("a", F.col("low").alias("was")), "a").where("low <> was").isEmpty()
        scratch.drop(name)
        name = new
        if moved:
            return name.select("low").distinct().count()


def _absorbed(cells: DataFrame, effects: list[str], columns: list[str], spread: list[float], scratch: Scratch) -> list[DataFrame]:
    """(level, e0, e1, ...) for each effect: what the effects explain of each column, from cells (effects, n, s0, s1, ...)."""
    zero = [F.lit(0.0).alias(f"e{j}") for j in range(len(columns))]
    own = [scratch.save(cells.select(F.col(g).alias(f"l{k}")).distinct().select(f"l{k}", *zero), "effect") for k, g in enumerate(effects)]
    for _ in range(SWEEPS if len(effects) > 1 else 1):
        moved = 0.0
        for k, g in enumerate(effects):
            rows = cells
            rest: list[Column] = [F.col(f"s{j}") for j in range(len(columns))]
            for m, h in enumerate(effects):
                if m != k:
                    other = own[m].select(F.col(f"l{m}").alias(h), *(F.col(f"e{j}").alias(f"e{m}_{j}") for j in range(len(columns))))
                    rows = rows.join(other, h)
                    rest = [r - F.col("n") * F.col(f"e{m}_{j}") for j, r in enumerate(rest)]
            new = rows.groupBy(F.col(g).alias(f"l{k}")).agg(*((F.sum(r) / F.sum("n")).alias(f"e{j}") for j, r in enumerate(rest)))
            new = scratch.save(new, "effect")
            far = new.join(own[k].select(f"l{k}", *(F.col(f"e{j}").alias(f"o{j}") for j in range(len(columns)))), f"l{k}")
            got = far.agg(*(F.max(F.abs(F.col(f"e{j}") - F.col(f"o{j}"))).alias(f"d{j}") for j in range(len(columns)))).collect()[0]
            moved = max([moved, *(got[f"d{j}"] / s for j, s in enumerate(spread) if s)])
            scratch.drop(own[k])
            own[k] = new
        if moved < TOLERANCE:
            return own
    if len(effects) > 1:
        raise ArithmeticError(f"the effects didn't settle in {SWEEPS} sweeps")
    return own


def least_squares(df: DataFrame, y: str, x: list[str], effects: list[str]) -> DataFrame:
    """(term, beta, se, t, p, low, high, n, r2, adjusted_r2) of y on x with effects of the given columns; rows with a null take no part.

    Coefficients and errors are those of a regression with a dummy for each level. Levels cost their number less the connected parts
    of the graph that the first two effects' levels form; each further effect loses the parts it forms with the first."""
    spark = df.sparkSession
    scratch = Scratch(spark, "effects")
    names = [f"c{j}" for j in range(1 + len(x))]
    rows = scratch.save(df.select(*(F.col(g).cast("string").alias(f"g{k}") for k, g in enumerate(effects)), *(F.col(c).cast("double").alias(n) for c, n in zip([y, *x], names))).na.drop(), "rows")
    first = rows.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"d_{c}") for c in names)).collect()[0]
    n = first["n"]
    if not n:
        return spark.createDataFrame([], LEAST_SQUARES)
    level = [f"g{k}" for k in range(len(effects))]
    rows = rows.select(*level, *((F.col(c) - first[f"m_{c}"]).alias(c) for c in names))
    cells = scratch.save(rows.groupBy(*level).agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{j}") for j, c in enumerate(names))), "cells")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    raw = rows.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in pairs)).collect()[0]
    own = _absorbed(cells, level, names, [first[f"d_{c}"] for c in names], scratch)
    met = reduce(lambda d, k: d.join(own[k].select(F.col(f"l{k}").alias(level[k]), *(F.col(f"e{j}").alias(f"e{k}_{j}") for j in range(len(names)))), level[k]), range(len(level)), cells)
    explained = {(i, j): F.sum(F.col(f"s{i}") * reduce(lambda a, b: a + b, (F.col(f"e{k}_{j}") for k in range(len(level))))).alias(f"q{i}_{j}") for i in range(len(names)) for j in range(len(names))}
    taken = met.agg(*explained.values()).collect()[0]
    gram = np.zeros((len(names), len(names)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = raw[f"p{i}_{j}"] - (taken[f"q{i}_{j}"] + taken[f"q{j}_{i}"]) / 2
    levels = [e.count() for e in own]
    lost = sum(parts(cells, level[0], g, scratch) for g in level[1:])
    dof = n - len(x) - (sum(levels) - lost)
    xx, xy = gram[1:, 1:], gram[0, 1:]
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    sse = max(0.0, gram[0, 0] - 2 * beta @ xy + beta @ xx @ beta)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)), 0) * (sse / dof if dof > 0 else np.nan))
    r2 = 1 - sse / raw["p0_0"] if raw["p0_0"] else 0.0
    adjusted = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else float("nan")
    out = []
    for term, b, s in zip(x, beta.tolist(), se.tolist()):
        t = b / s if s else float("nan")
        out.append((term, b, s, t, stats.t_p(t, dof), b - 1.96 * s, b + 1.96 * s, n, float(r2), float(adjusted)))
    return spark.createDataFrame(out, LEAST_SQUARES)
