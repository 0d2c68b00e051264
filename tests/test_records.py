"""Records, markup, regression and graphs against hand-made cases and plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.operators import aggregate, correction, counting, fits, graphs
from lexitide.operators import records as R
from lexitide.sources import sinks


def test_spelling_keeps_lines_spaces_and_punctuation(spark):
    text = "  The olde  “shoppe,”\n\n—olde!\nOlde shoppe's"
    df = spark.createDataFrame([(1, text), (2, ""), (3, "olde")], "id int, text string")
    got = {r.id: r.text for r in R.respelled(df, ["id"], "text", spark.createDataFrame([("olde", "old"), ("shoppe", "shop")], "word string, modern string")).collect()}
    assert got == {1: "  The old  “shop,”\n\n—old!\nOlde shoppe's", 2: "", 3: "old"}


def test_markup(spark):
    norms = spark.createDataFrame([("virtue", -1.5), ("rock", 3.0), ("so", 0.0)], "word string, z double")
    html = R.rendered(spark.createDataFrame([(1, "Virtue <so>\n\nrock & tree")], "id int, text string"), ["id"], "text", norms).collect()[0].html
    assert html.split("\n") == [
        '<p class="psg-para psg-first"><span class="abstract" style="outline:3px solid rgba(0,0,0,0.50); outline-offset:0px; border-radius:2px">Virtue</span> &lt;<span class="neither" style="outline:1px solid rgba(0,0,0,0.15); outline-offset:0px; border-radius:2px">so</span>&gt;</p>',
        '<p class="psg-para"><span class="concrete" style="font-weight:900; background:rgba(0,0,0,0.40); border-radius:2px">rock</span> &amp; tree</p>',
    ]
    bands = spark.createDataFrame([("virtue", "neg"), ("rock", "pos"), ("man", "neither")], "word string, band string")
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Virtue", ",", "rock", "did", "n't", "man", "\n"])], "id int, position int, token string")
    assert R.marked_passages(tokens, ["id"], bands).collect()[0].passage == "<i><b>Virtue</b></i>, <i><u>rock</u></i> didn't <i>man</i>"


def test_values_and_identifiers(spark):
    with pytest.raises(ValueError):
        R.plotted_value("other")
    df = spark.createDataFrame([(4, 0, 1, 5)], "num_abs int, num_conc int, num_neither int, num_total int")
    assert [df.select(R.plotted_value(k)).collect()[0][0] for k in ("abs/conc", "abs-conc", "abs", "neither")] == [None, 4.0, 80.0, 20.0]
    assert R.known(df, *R.columns_with(df, "num_a")) == ["num_abs"] and R.checked_id("_src1/a b") == "_src1/a b"
    for bad in ("", "x y", None, "a'; --"):
        with pytest.raises(ValueError):
            R.checked_id(bad)
    with pytest.raises(ValueError):
        R.known(df, "nothing")
    assert spark.range(1).select(R.pooled_strings(F.array(F.array(F.lit("a"), F.lit(None)), F.lit(None), F.array(F.lit("b"))))).collect()[0][0] == "a b"


def test_least_squares_like_dummies(spark):
    rng = np.random.default_rng(1)
    g, x, z = rng.integers(0, 5, 300), rng.normal(size=300), rng.normal(size=300)
    y = 2 * x - z + g * 0.7 + rng.normal(size=300)
    df = spark.createDataFrame([*zip(g.tolist(), x.tolist(), z.tolist(), y.tolist()), (1, None, 0.0, 1.0)], "g int, x double, z double, y double")
    want = stats.ols(y, np.column_stack([x, z, np.ones(300), stats.dummies(g.tolist())]))
    got = fits.least_squares(df, "y", ["x", "z"], "g").orderBy("term").collect()
    for i, r in enumerate(got):
        assert (r.beta, r.se, r.t, r.p, r.r2, r.n) == pytest.approx((want["coef"][i], want["se"][i], want["t"][i], want["p"][i], want["r2"], 300), rel=1e-6, abs=1e-12)
    plain = stats.ols(y, np.column_stack([x, np.ones(300)]))
    one = fits.least_squares(df, "y", ["x"]).collect()[0]
    assert (one.beta, one.se) == pytest.approx((plain["coef"][0], plain["se"][0]), rel=1e-2)
    assert fits.least_squares(df.limit(0), "y", ["x"]).collect() == []


def test_imbalanced_corpora_are_adjusted(spark):
    """100 against 5 texts a decade, five apart: adjusted by corpus the start is near 0, pooled it isn't."""
    rng = np.random.default_rng(2)
    rows = [(1700 + 10 * d, c, (0.0 if c == "big" else 5.0) + 0.01 * rng.normal()) for d in range(20) for c, n in (("big", 100), ("small", 5)) for _ in range(n)]
    df = spark.createDataFrame(rows, "year int, corpus string, score double").withColumn("all", F.lit(1))
    points = aggregate.bin_means(df, "score", 10, ["all", "corpus"])
    for how in ({"degree": 2}, {"degree": 4}, {"grid": np.arange(1750, 1851, 10)}):
        out = fits.adjusted(points, ["all"], ["corpus"], **how).where("bin = 1700").toPandas()
        assert abs(out["adjusted"].max() - out["adjusted"].min()) < 0.1 and abs(out["fitted"].iloc[0] - 2.5) < 0.1
    assert abs(aggregate.bin_means(df, "score", 10).where("bin = 1700").collect()[0]["mean"] - 2.5) > 0.1


def test_breakpoint_itself_is_early():
    x = np.arange(1700, 1900, 10).astype(float)
    y = np.where(x <= 1790, x - 1790, 1790 - x)
    assert stats.piecewise(x, y, np.array([1790.0]))["breakpoint"] == 1790  # ten years up to it and ten after it
    assert stats.piecewise(x, y, np.array([1800.0])) is None


def test_adjusted_p_of_ties_over_many_partitions(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(500) ** 2, 2) + 0.001
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "i int, p double").repartition(7)
    order = np.argsort(-p, kind="stable")
    want, low = {}, 1.0
    for place, i in enumerate(order):
        low = min(low, p[i] * len(p) / (len(p) - place))
        want[int(i)] = low
    for i in order[::-1]:  # equal p have equal values
        want[int(i)] = min(want[int(j)] for j in np.nonzero(p == p[i])[0])
    got = {r.i: r.p_adjusted for r in fits.adjusted_p(df).collect()}
    assert got.pop(999) is None and got == pytest.approx(want)


def test_bias_of_many_corpora(spark):
    """Least squares with group dummies, written out."""
    rng = np.random.default_rng(5)
    rows = [(g, f"c{c}", float(rng.normal() + 0.1 * c)) for g in range(60) for c in range(6) if rng.random() < 0.6]
    shared = {g for g in range(60) if sum(r[0] == g for r in rows) > 1}
    own = [r for r in rows if r[0] in shared]
    names = [f"c{c}" for c in range(1, 6)]
    design = np.column_stack([[[float(r[1] == n) for n in names] for r in own], [[float(r[0] == g) for g in sorted(shared)] for r in own]])
    want = stats.ols(np.array([r[2] for r in own]), design)
    got = {r.corpus: (r.coef, r.se) for r in correction.corpus_bias(spark.createDataFrame(rows, "group_id int, corpus string, score double"), "c0").collect()}
    for i, n in enumerate(names):
        assert got[n] == pytest.approx((want["coef"][i], want["se"][i]), rel=1e-6)


def test_sentence_runs_of_a_long_text(spark):
    text = "One two. " * 40_000 + "Tail."
    got = counting.sentences_of(spark.createDataFrame([(1, text), (2, "A b c. D? E f!"), (3, None)], "id int, text string"), ["id"], 4).collect()
    assert sum(r.id == 1 for r in got) == 20_000 and [r.sentence for r in got if r.id == 2] == ["A b c. D?"] and got[0].sentence == "One two. One two."


def test_graph_statistics_like_plain_python(spark):
    rng = np.random.default_rng(6)
    edges = [(g, f"n{a}", f"n{b}") for g in ("x", "y") for a, b in rng.integers(0, 14, (22, 2))]
    got = {r.g: r for r in graphs.statistics(spark.createDataFrame(edges, "g string, a string, b string"), "g").collect()}
    for g in ("x", "y"):
        near = {}
        for a, b in ((a, b) for k, a, b in edges if k == g and a != b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        far = {a: {a: 0} for a in near}
        for a in near:
            todo = [a]
            for x in todo:
                for y in near[x]:
                    if y not in far[a]:
                        far[a][y] = far[a][x] + 1
                        todo.append(y)
        first = min(min(v) for v in far.values() if len(v) == max(map(len, far.values())))
        largest = far[first].keys()
        local = [sum(q in near[p] for p, q in itertools.combinations(v, 2)) / (len(v) * (len(v) - 1) / 2) if len(v) > 1 else 0 for v in near.values()]
        r = got[g]
        assert (r.nodes, r.edges, r.diameter) == (len(near), sum(map(len, near.values())) // 2, max(max(far[a].values()) for a in largest))
        assert r.clustering == pytest.approx(np.mean(local)) and r.gini == pytest.approx(stats.gini(np.array([len(v) for v in near.values()])))
        ends = np.array([(len(near[a]), len(near[b])) for a in near for b in near[a]], float)
        assert r.assortativity == pytest.approx(np.corrcoef(ends.T)[0, 1])


def test_bounds_and_bias_of_any_number_of_corpora(spark):
    n = 100_500
    df = spark.range(n).selectExpr("concat('c', id) corpus", "1700 year", "1.0D score")
    assert aggregate.bounded_years(df, df.selectExpr("corpus", "1800 lo", "cast(null as int) hi")).count() == 0
    assert correction.corrected(df, df.selectExpr("corpus", "0.25D coef")).where("score = 0.75").count() == n


def test_append_keeps_the_same_row(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z"), (1, "c")], "k int, v string").repartition(4)
    for i in range(2):
        sinks.append_new(rows, str(tmp_path / "t"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a"), (2, "z")]
