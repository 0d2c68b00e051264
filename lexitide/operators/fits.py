"""Fits by group. Spark bins first; only a few bins of a group reach pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.functions.pvalues import t_p
from lexitide.runtime import Scratch

GRID = np.arange(1650, 1851, 10)


def _by(points: DataFrame, keys: list[str], fit, schema: str) -> DataFrame:
    """fit(pdf) -> dict of columns or None, for each group of points."""
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = fit(pdf)
        if out is None:
            return pd.DataFrame()
        out = pd.DataFrame(out)
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *names]]

    names = [c.split()[0] for c in schema.split(", ")]
    return points.groupBy(*keys).applyInPandas(run, f"{kinds}, {schema}")


def linear(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, R2 and residual count, by Spark's own aggregates."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def residuals(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """y less its line on log1p(x)."""
    own = df.withColumn("__x", F.log1p(x))
    line = [F.regr_slope(y, "__x").alias("__s"), F.regr_intercept(y, "__x").alias("__i")]  # a row for each key, joined back
    out = own.join(own.groupBy(*keys).agg(*line), keys) if keys else own.join(F.broadcast(own.agg(*line)))
    return out.withColumn("residual", F.col(y) - (F.col("__i") + F.col("__s") * F.col("__x"))).drop("__x", "__s", "__i")


def quadratic(points: DataFrame, keys: list[str]) -> DataFrame:
    """points: keys, bin, mean."""

    def fit(pdf):
        pdf = pdf.sort_values("bin")
        got = stats.quadratic(pdf["bin"].to_numpy(float), pdf["mean"].to_numpy(float))
        return got and {"curve": [got["coef"][2]], "p": [got["p"][2]], "vertex": [got["vertex"]], "r2": [got["r2"]], "n": [got["n"]]}

    return _by(points, keys, fit, "curve double, p double, vertex double, r2 double, n long")


def piecewise(points: DataFrame, keys: list[str], grid: np.ndarray = GRID, fixed: list[str] | None = None) -> DataFrame:
    """Breakpoint and slopes by group; the breakpoint is searched with the first fixed effect only, then all are fitted."""

    def fit(pdf):
        pdf = pdf.sort_values(["bin", *(fixed or [])])
        x, y = pdf["bin"].to_numpy(float), pdf["mean"].to_numpy(float)
        extra = [stats.dummies(pdf[c].astype(str)) for c in fixed or []]
        got = stats.piecewise(x, y, grid, extra[0] if extra else None)
        if got is None:
            return None
        if len(extra) > 1:
            got = stats.piecewise(x, y, np.array([got["breakpoint"]]), np.column_stack(extra))
        return {"breakpoint": [got["breakpoint"]], "rise": [got["rise"]], "fall": [got["fall"]], "r2": [got["r2"]], "n": [got["n"]]}

    return _by(points, keys, fit, "breakpoint double, rise double, fall double, r2 double, n long")


def adjusted(points: DataFrame, keys: list[str], fixed: str | list[str], degree: int = 3, grid: np.ndarray | None = None) -> DataFrame:
    """Points less their fixed effects: a trend in the bin with effects of the fixed columns, the effects' mean kept.

    The trend is a polynomial, or with a grid two lines that meet at the breakpoint with the best R2. points: keys, bin, fixed, mean."""
    fixed = [fixed] if isinstance(fixed, str) else fixed

    def fit(pdf):
        pdf = pdf.sort_values(["bin", *fixed])
        x, y = pdf["bin"].to_numpy(float), pdf["mean"].to_numpy(float)
        if len(pdf) < 10:
            return None
        extra = np.column_stack([stats.dummies(pdf[c].astype(str)) for c in fixed])
        if grid is None:
            c = (x - x.mean()) / (x.std() or 1.0)
            base = np.column_stack([c**k for k in range(degree + 1)])
        else:
            found = stats.piecewise(x, y, grid, extra)
            if found is None:
                return None
            knee = found["breakpoint"]
            base = np.column_stack([np.ones_like(x), x - knee, np.maximum(x - knee, 0)])
        got = stats.ols(y, np.column_stack([base, extra]))
        effect = extra @ got["coef"][base.shape[1] :]
        design = np.column_stack([base, np.tile(extra.mean(0), (len(base), 1))])
        line = design @ got["coef"]
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", design, got["cov"], design), 0))
        return {"bin": pdf["bin"].to_numpy(), **{c: pdf[c].to_numpy() for c in fixed}, "mean": y, "adjusted": y - effect + effect.mean(), "fitted": line, "se": se}

    kinds = {c: points.schema[c].dataType.simpleString() for c in ("bin", *fixed)}
    return _by(points, keys, fit, f"bin {kinds['bin']}, {', '.join(f'{c} {kinds[c]}' for c in fixed)}, mean double, adjusted double, fitted double, se double")


def least_squares(df: DataFrame, y: str, x: list[str], fixed: str | None = None) -> DataFrame:
    """(term, beta, se, t, p, low, high, n, r2, adjusted_r2) of y on x with an intercept, or with effects of the column fixed.

    Demeaned by its group a regression has the coefficients that dummies give, and each group costs one degree of freedom;
    so Spark sums the products of len(x) + 1 columns, however many groups there are, and the driver solves len(x) equations."""
    rows = df.select(*([F.col(fixed).alias("__g")] if fixed else [F.lit(0).alias("__g")]), *(F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate([y, *x]))).na.drop()
    names = [f"__{i}" for i in range(len(x) + 1)]
    rows = Scratch(df.sparkSession, "regression").save(rows, "rows")
    means = rows.groupBy("__g").agg(*(F.avg(c).alias(f"m{c}") for c in names), F.count("*").alias("__n"))
    # without effects all rows have one key, whose mean is one row
    centred = (rows.join(means, "__g") if fixed else rows.drop("__g").join(F.broadcast(means))).select(*((F.col(c) - F.col(f"m{c}")).alias(c) for c in names))
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = centred.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in cells), F.count("*").alias("n")).collect()[0]
    groups = means.count()
    sst = rows.agg((F.var_pop("__0") * F.count("*")).alias("s")).collect()[0]["s"]
    xx, xy = np.zeros((len(x), len(x))), np.array([got[f"s0_{i + 1}"] or 0.0 for i in range(len(x))])
    for i, j in cells:
        if i:
            xx[i - 1, j - 1] = xx[j - 1, i - 1] = got[f"s{i}_{j}"] or 0.0
    n, dof = got["n"], got["n"] - len(x) - groups
    if not n:
        return df.sparkSession.createDataFrame([], LEAST_SQUARES)
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    sse = max(0.0, got["s0_0"] - 2 * beta @ xy + beta @ xx @ beta)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(xx)), 0) * (sse / dof if dof > 0 else np.nan))
    r2 = 1 - sse / sst if sst else 0.0
    adjusted_r2 = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else float("nan")
    out = []
    for term, b, s in zip(x, beta.tolist(), se.tolist()):
        t = b / s if s else float("nan")
        out.append((term, b, s, t, stats.t_p(t, dof), b - 1.96 * s, b + 1.96 * s, n, float(r2), float(adjusted_r2)))
    return df.sparkSession.createDataFrame(out, LEAST_SQUARES)


LEAST_SQUARES = "term string, beta double, se double, t double, p double, low double, high double, n long, r2 double, adjusted_r2 double"


def smooth(points: DataFrame, keys: list[str], frac: float = 2 / 3) -> DataFrame:
    """LOESS of the means over bins, with a local band; groups under five bins are left out."""

    def fit(pdf):
        if len(pdf) < 5:
            return None
        pdf = pdf.sort_values("bin")
        x, y = pdf["bin"].to_numpy(float), pdf["mean"].to_numpy(float)
        line = stats.lowess(x, y, frac)
        lo, hi = stats.local_band(x, y, line)
        return {"bin": pdf["bin"].to_numpy(), "fitted": line, "se_lo": lo, "se_hi": hi}

    return _by(points, keys, fit, f"bin {points.schema['bin'].dataType.simpleString()}, fitted double, se_lo double, se_hi double")


def arc_statistics(points: DataFrame, keys: list[str], grid: np.ndarray = GRID) -> DataFrame:
    """Peak and ends of the LOESS line, slopes a decade, change in standard deviations."""

    def fit(pdf):
        if len(pdf) < 5:
            return None
        pdf = pdf.sort_values("bin")
        x, y = pdf["bin"].to_numpy(float), pdf["mean"].to_numpy(float)
        line = stats.lowess(x, y)
        got = stats.piecewise(x, y, grid)
        peak = int(line.argmax())
        slope = (lambda k: got[k] * 10) if got else (lambda k: float("nan"))
        return {"peak": [x[peak]], "start": [line[0]], "top": [line[peak]], "end": [line[-1]], "rise_decade": [slope("rise")], "fall_decade": [slope("fall")], "sd_change": [(line[-1] - line[0]) / (y.std() or float("nan"))]}

    return _by(points, keys, fit, "peak double, start double, top double, end double, rise_decade double, fall_decade double, sd_change double")


def welch(df: DataFrame, keys: list[str], group: str, value: str, a: str, b: str) -> DataFrame:
    """Welch's t, degrees of freedom and p of two groups, from counts, means and variances; p's rank corrections in adjusted_p."""
    pick = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    own = df.groupBy(*keys).agg(*(pick(g, f).alias(f"{n}_{s}") for s, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    own = own.where("n_a > 1 and n_b > 1 and v_a + v_b > 0").withColumn("__a", F.col("v_a") / F.col("n_a")).withColumn("__b", F.col("v_b") / F.col("n_b"))
    t = (F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("__a") + F.col("__b"))
    dof = (F.col("__a") + F.col("__b")) ** 2 / (F.col("__a") ** 2 / (F.col("n_a") - 1) + F.col("__b") ** 2 / (F.col("n_b") - 1))
    own = own.select(*keys, (F.col("m_a") - F.col("m_b")).alias("diff"), t.alias("t"), dof.alias("dof"))
    return own.withColumn("p", t_p(F.col("t"), F.col("dof")))


def adjusted_p(tests: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg: p n / rank, the highest rank of equal p, then the smallest from the top down.

    Distinct values of p are sorted over all tasks; running counts and minima are taken inside a partition and carried
    from one to the next by one row for each partition, so any number of tests does."""
    values = tests.groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("n")).where("__p is not null").orderBy("__p")
    values = Scratch(tests.sparkSession, "ranks").save(values.withColumn("part", F.spark_partition_id()), "values")
    parts = sorted((r["part"], r["n"]) for r in values.groupBy("part").agg(F.sum("n").alias("n")).collect())
    total, before, start = sum(n for _, n in parts), 0, []
    for part, n in parts:
        start.append((part, before))
        before += n
    if not parts:
        return tests.withColumn("p_adjusted", F.col(p).cast("double"))
    own = Window.partitionBy("part").orderBy("__p")
    ranked = values.join(F.broadcast(tests.sparkSession.createDataFrame(start, "part int, ahead long")), "part")
    ranked = ranked.withColumn("q", F.col("__p") * total / (F.col("ahead") + F.sum("n").over(own)))
    least = {r["part"]: r["q"] for r in ranked.groupBy("part").agg(F.min("q").alias("q")).collect()}
    after, low = [], 1.0
    for part, _ in reversed(parts):
        after.append((part, low))
        low = min(low, least[part])
    down = Window.partitionBy("part").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = ranked.join(F.broadcast(tests.sparkSession.createDataFrame(after, "part int, beyond double")), "part")
    adjusted = adjusted.select("__p", F.least(F.min("q").over(down), "beyond").alias("p_adjusted"))
    return tests.join(adjusted, tests[p] == adjusted["__p"], "left").drop("__p")


def fisher(counts: DataFrame, keys: list[str]) -> DataFrame:
    """counts: keys, a, b, c, d -> exact p and log2 odds clipped to [-5, 5] with halves added."""

    def test(pdfs):
        for pdf in pdfs:
            odds = np.log2((pdf.a + 0.5) * (pdf.d + 0.5) / ((pdf.b + 0.5) * (pdf.c + 0.5))).clip(-5, 5)
            yield pdf[keys].assign(log2_odds=odds, p=[stats.fisher(*map(int, r)) for r in pdf[["a", "b", "c", "d"]].to_numpy()])

    kinds = ", ".join(f"{k} {counts.schema[k].dataType.simpleString()}" for k in keys)
    return counts.mapInPandas(test, f"{kinds}, log2_odds double, p double")
