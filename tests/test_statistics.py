"""Order statistics, effects, partitions and p-values against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.functions import pvalues, stats
from lexitide.operators import effects, gram, order


def test_quantiles_of_one_large_group(spark):
    draw = np.random.default_rng(1)
    x = np.where(draw.random(20_000) < 0.4, 7.0, np.round(draw.normal(size=20_000), 2))  # one value has two fifths of the rows
    rows = [("all", float(v)) for v in x] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: (r.a, r.b, r.c) for r in order.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == {"all", "one", "two", None}
    assert got["all"] == pytest.approx(tuple(np.quantile(x, [0.05, 0.5, 1.0]))) and got["one"] == (3, 3, 3) and got["two"] == pytest.approx((1.05, 1.5, 2.0))
    assert order.quantiles(df.where("v is not null"), [], "v", {"m": 0.5}).collect()[0].m == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert order.medians(df.where("false"), ["g"], "v").count() == 0


def test_middle_rows_and_gini(spark):
    rows = [(k % 3, float(k * 7 % 50), k) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, v double, id int").repartition(5)
    got = {r.g: r.id for r in order.middle_rows(df, ["g"], ["v", "id"], ("v",)).collect()}
    for g in range(3):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert got[g] == own[len(own) // 2][2]
    for r in order.gini(df, ["g"], "v").collect():
        assert r.gini == pytest.approx(stats.gini(np.array([v for g, v, _ in rows if g == r.g])))


def dummies_fit(y, x, sets):
    design = [np.ones(len(y)), *x]
    for s in sets:
        design += [np.array([float(v == k) for v in s]) for k in sorted(set(s))]
    m = np.column_stack(design)
    coef, rank = np.linalg.lstsq(m, y, rcond=None)[0], np.linalg.matrix_rank(m)
    sse = ((y - m @ coef) ** 2).sum()
    own = np.column_stack(x)
    rest = np.column_stack([m[:, 0], m[:, 1 + len(x) :]])
    own = own - rest @ np.linalg.lstsq(rest, own, rcond=None)[0]
    return coef[1 : 1 + len(x)], np.sqrt(np.diag(np.linalg.inv(own.T @ own)) * sse / (len(y) - rank)), 1 - sse / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("k", [2, 3])
def test_several_effects_equal_dummies(spark, k):
    draw = np.random.default_rng(k)
    n = 400
    a = draw.integers(0, 12, n)
    b = np.where(a < 6, draw.integers(0, 5, n), draw.integers(5, 9, n))  # two parts that never meet
    c = draw.integers(0, 3, n)
    x1, x2 = draw.normal(size=n) + a, draw.normal(size=n) + b
    y = 2 * x1 - x2 + a * 0.3 + b**1.5 + c + draw.normal(size=n)
    rows = [(float(v), float(p), float(q), *(f"l{i}" for i in g)) for v, p, q, *g in zip(y, x1, x2, a, b, c)] + [(None, 1.0, 1.0, "l0", "l0", "l0"), (1.0, 1.0, 1.0, None, "l0", "l0")]
    df = spark.createDataFrame(rows, "y double, x1 double, x2 double, a string, b string, c string")
    got = effects.least_squares(df, "y", ["x1", "x2"], ["a", "b", "c"][:k]).collect()
    coef, se, r2 = dummies_fit(y, [x1, x2], [a, b, c][:k])
    assert [r.beta for r in got] == pytest.approx(coef, rel=1e-6) and [r.se for r in got] == pytest.approx(se, rel=1e-6)
    assert got[0].r2 == pytest.approx(r2, rel=1e-8) and got[0].n == n
    assert effects.least_squares(df.where("false"), "y", ["x1"], ["a", "b"]).count() == 0


def r2(y, x):
    y, x = y - y.mean(0), x - x.mean(0)
    return 1 - ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum() / (y**2).sum()


def test_partition_from_one_matrix(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(300, 4)) * [1, 1e4, 1, 1] + [5, 1e6, 0, 0]
    x[:, 3] = x[:, 2] * 2  # depends on another column
    y = x @ [[1, 0], [1e-4, 2e-4], [0.5, 1], [0, 0]] + draw.normal(size=(300, 2))
    df = spark.createDataFrame([(*map(float, a), list(map(float, b))) for a, b in zip(x, y)], "a double, b double, c double, d double, v array<double>").repartition(4)
    got = {(r.block, r.feature): (r.alone, r.added) for r in gram.partition(df, {"one": ["a", "b"], "two": ["c", "d"]}, vector="v").collect()}
    full = r2(y, x)
    assert got["(all)", None][0] == pytest.approx(full)
    for block, cols in (("one", [0, 1]), ("two", [2, 3])):
        rest = [i for i in range(4) if i not in cols]
        assert got[block, None] == pytest.approx((r2(y, x[:, cols]), full - r2(y, x[:, rest])))
    assert got["two", "c"] == pytest.approx((r2(y, x[:, [2]]), 0), abs=1e-9)
    one = {(r.block, r.feature): r.alone for r in gram.partition(df.select("a", "b", F.col("v")[0].alias("y")), {"one": ["a", "b"]}, "y").collect()}
    assert one["(all)", None] == pytest.approx(r2(y[:, :1], x[:, :2]))


def test_marginal_r2_of_principal_components(spark):
    draw = np.random.default_rng(4)
    v = draw.normal(size=(200, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    f = np.column_stack([v[:, 0] > 0, v[:, 1] + draw.normal(size=200), np.ones(200)]).astype(float)
    df = spark.createDataFrame([(float(a), None if i == 0 else float(b), float(c), list(map(float, w))) for i, ((a, b, c), w) in enumerate(zip(f, v))], "p double, q double, r double, v array<double>")
    f[0, 1] = 0
    got = {r.feature: (r.r2, r.prevalence) for r in gram.marginal(df, {"g": ["p", "q"], "h": ["r"]}, "v", 3).collect()}
    centred = v - v.mean(0)
    low = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert set(got) == {"p", "q"}
    for i, c in enumerate("pq"):
        assert got[c] == pytest.approx((r2(low, f[:, [i]]), f[:, i].mean()))


GOLDEN = [(0.0, 5, 1.0), (1.0, 1, 0.5), (12.706204736432095, 1, 0.05), (2.0, 2, 0.1835034190722739), (2.2281388519649385, 10, 0.05), (2.570581835636314, 5, 0.05), (1.983971518449634, 100, 0.05)]


def test_p_values(spark):
    df = spark.createDataFrame([(float(t), float(d), float(p)) for t, d, p in GOLDEN], "t double, d double, p double")
    plan = df.select(pvalues.t_p(F.col("t"), F.col("d")).alias("got"), "p")
    assert "Python" not in plan._jdf.queryExecution().toString() and "Pandas" not in plan._jdf.queryExecution().toString()
    assert all(abs(r.got - r.p) < 1e-9 for r in plan.collect())
    cases = [(t, d) for t in (0.001, 0.01, 0.3, 1.0, 1.7, 3.0, 8.0, 40.0) for d in (0.5, 1, 2, 3.7, 10, 39, 81, 200, 3000)]
    got = spark.createDataFrame([(float(t), float(d)) for t, d in cases], "t double, d double").select("*", pvalues.t_p(-F.col("t"), F.col("d")).alias("p")).collect()
    for r in got:
        want = stats.t_p(r.t, r.d)
        assert abs(r.p - want) < 1e-9 and (want < 1e-200 or abs(r.p / want - 1) < 1e-7)
    far = spark.createDataFrame([(1.96, 1e7), (0.01, 1e7), (5.0, 1e6)], "t double, d double").select(pvalues.t_p(F.col("t"), F.col("d")).alias("p"), "t").collect()
    for r in far:
        assert r.p == pytest.approx(math.erfc(r.t / math.sqrt(2)), rel=1e-3)
    odd = spark.createDataFrame([(None, 5.0), (math.nan, 5.0), (math.inf, 5.0), (1.0, 0.0)], "t double, d double").select(pvalues.t_p(F.col("t"), F.col("d")).alias("p")).collect()
    assert [r.p for r in odd] == [None] * 4
    r = spark.createDataFrame([(0.5, 12), (1.0, 5), (0.9, 2)], "r double, n int").select(pvalues.pearson_p(F.col("r"), F.col("n")).alias("p")).collect()
    assert r[0].p == pytest.approx(stats.t_p(0.5 * math.sqrt(10 / 0.75), 10)) and r[1].p == 0 and r[2].p is None
