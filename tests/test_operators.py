"""Golden values on tiny frames, and models in plain Python."""

import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexitide.functions import bins, stats
from lexitide.functions import text as T
from lexitide.operators import correction, counting, decompose, fits, graphs, joins, scoring, shape, words
from lexitide.operators import norms as N
from lexitide.sources import readers, sinks
from lexitide.streaming.passages import event_windows, passages, score_stream

NORMS = [("virtue", -1.5, -1.8), ("justice", -0.8, -1.2), ("face", 0.3, 0.1), ("rock", 1.2, 1.5), ("stone", 0.7, 0.9)]


@pytest.fixture(scope="module")
def norms(spark):
    return spark.createDataFrame(NORMS, "word string, median double, C18 double")


def _pct(spark, norms, counts):
    freqs = spark.createDataFrame([("t", w, n) for w, n in counts.items()], "id string, word string, cnt long")
    return scoring.proportions(freqs, norms, ["word"], ["id"], ["median", "C18"]).collect()[0]


def test_proportions(spark, norms):
    r = _pct(spark, norms, {"virtue": 1, "rock": 1})
    assert (r.pct_abs_10_median, r.pct_conc_10_median) == (0.5, 0.5)
    r = _pct(spark, norms, dict.fromkeys([w for w, *_ in NORMS], 1))
    assert (r.pct_abs_05_median, r.pct_conc_05_median) == (0.4, 0.4)
    r = _pct(spark, norms, {"virtue": 9, "rock": 1})
    assert (r.pct_abs_10_median, r.pct_conc_10_median) == (0.9, 0.1) and r.pct_absconc_10_median == pytest.approx(0.8)
    r = _pct(spark, norms, {"justice": 1, "face": 1})
    assert (r.pct_abs_10_median, r.pct_abs_10_C18) == (0.0, 0.5)
    assert [_pct(spark, norms, {w: n}).pct_absconc_10_median for w, n in (("virtue", 5), ("rock", 5), ("face", 10))] == [1.0, -1.0, 0.0]


def test_weighted_mean_has_a_denominator_for_each_column(spark):
    norms = spark.createDataFrame([("a", 1.0, None), ("b", -1.0, 2.0)], "word string, x double, y double")
    freqs = spark.createDataFrame([("t", "a", 3), ("t", "b", 1), ("u", "zzz", 4)], "id string, word string, cnt long")
    r = scoring.weighted_means(freqs, norms, ["word"], ["id"], ["x", "y"]).collect()
    assert [tuple(x) for x in r] == [("t", 0.5, 2.0)]
    kept = scoring.weighted_means(freqs, norms, ["word"], ["id"], ["x", "y"], keep_unrated=True).orderBy("id").collect()
    assert [tuple(x) for x in kept] == [("t", 0.5, 2.0), ("u", None, None)]


def test_histogram_edges(spark):
    z = spark.createDataFrame([(-3.0,), (-1.0,), (-0.95,), (0.0,), (2.999,), (3.0,), (3.1,), (None,)], "z double")
    assert [r[0] for r in z.select(bins.histogram_bin(F.col("z"))).collect()] == [-29, -9, -9, 1, 30, 30, None, None]


def test_bins(spark):
    y = spark.createDataFrame([(-5,), (1499,), (1500,), (1699,), (None,)], "y int")
    rows = y.select(bins.bin_start(F.col("y"), 10), bins.passage_period(F.col("y")), bins.labelled_periods(F.col("y"), [1500, 1700])).collect()
    assert [tuple(r) for r in rows] == [(-10, 1400, None), (1490, 1400, None), (1500, 1500, "1500-1699"), (1690, 1600, "1500-1699"), (None, None, None)]
    z = spark.createDataFrame([(1.0,), (-1.0,), (0.99,), (None,)], "z double")
    assert [r[0] for r in z.select(bins.word_class(F.col("z"))).collect()] == ["Concrete", "Abstract", "Neither", "Neither"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab'é_9 .,!-—\n#漢", max_size=40), min_size=1, max_size=30))
def test_tokens_like_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, own in df.select("i", T.tokens(F.col("t"))).collect():
        assert own == re.findall(r"[\w']+|[.,!?; \-—–\n]", texts[i])
    for i, own in df.select("i", F.array_join(T.lossless_tokens(F.col("t")), "")).collect():
        assert own == texts[i]


def _windows(tokens, bands, size):
    """A plain model: buffers that are emptied when full."""
    out, own, seen = [], [], 0
    for t in tokens:
        own.append(t)
        if t.lower() in bands:
            seen += 1
            if seen == size:
                out.append(own)
                own, seen = [], 0
    if seen:
        out.append(own)
    return [(sum(bands.get(t.lower()) == "neg" for t in o), sum(bands.get(t.lower()) == "pos" for t in o), sum(t.lower() in bands for t in o), sum(t[0].isalpha() for t in o)) for o in out]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["Rock", "virtue", "zzz", "9", "man"]), max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_counting_windows_like_a_model(spark, texts, size):
    bands = {"rock": "pos", "virtue": "neg", "man": "neither"}
    contrasts = spark.createDataFrame([("c", w, b) for w, b in bands.items()], "contrast string, word string, band string")
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id int, text string")
    got = counting.window_counts(df, contrasts, ["id"], size).orderBy("id", "slice").collect()
    for i, t in enumerate(texts):
        own = re.findall(r"[\w']+|[.,!?; \-—–\n]", " ".join(t))
        assert [(r.num_abs, r.num_conc, r.num_total, r.num_words) for r in got if r.id == i] == _windows(own, bands, size)


def test_row_median_and_zscore(spark):
    df = spark.createDataFrame([(1.0, 3.0, None), (None, None, None), (1.0, 2.0, 9.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(N.row_median(*map(F.col, "abc"))).collect()] == [2.0, None, 2.0]
    z = N.with_zscores(spark.createDataFrame([("s", 1.0), ("s", 3.0), ("one", 5.0)], "k string, v double"), ["k"], {"z": "v"}).select("k", "z").orderBy("k", "z").collect()
    assert [r.z for r in z] == [None, -1.0, 1.0]


def test_period_score_falls_back_row_by_row(spark):
    df = spark.createDataFrame([(1, 1650, 0.5, None), (2, 1650, 0.5, 0.7), (3, 1400, None, 0.7)], "id int, year int, m double, C17 double")
    rows = scoring.period_score(df, "year", [(1600, 1700, "C17")], "m").orderBy("id").collect()
    assert [(r.period_score, r.period_score_source) for r in rows] == [(0.5, "m"), (0.7, "C17"), (None, "m")]


def test_modern_form_only_if_rated(spark):
    freqs = spark.createDataFrame([("t", "publick", 2), ("t", "public", 1), ("t", "olde", 5)], "id string, word string, cnt long")
    spelling = spark.createDataFrame([("publick", "public"), ("olde", "old")], "word string, modern string")
    out = scoring.modern_words(freqs, spelling, spark.createDataFrame([("public",)], "word string")).collect()
    assert {(r.word, r.cnt) for r in out} == {("public", 3), ("olde", 5)}


def test_bias_is_recovered_exactly(spark):
    rng, rows = np.random.default_rng(1), []
    for g in range(20):
        base = float(rng.normal())
        for corpus, bias, there in (("ref", 0.0, True), ("high", 0.1, g < 12), ("low", -0.05, g >= 5)):
            if there:
                rows.append((g, corpus, base + bias))
    df = spark.createDataFrame(rows, "group_id int, corpus string, score double")
    got = {r.corpus: r.coef for r in correction.corpus_bias(df, "ref").collect()}
    assert got == pytest.approx({"ref": 0.0, "high": 0.1, "low": -0.05}, abs=1e-8)
    fixed = correction.corrected(df, spark.createDataFrame(list(got.items()), "corpus string, coef double"))
    assert fixed.groupBy("group_id").agg((F.max("score") - F.min("score")).alias("d")).agg(F.max("d")).collect()[0][0] < 1e-8
    with pytest.raises(ValueError):
        correction.corpus_bias(df.where("corpus <> 'ref'"), "ref")


def test_shift_share_adds_up(spark):
    rows = [("a", "early", 1.0)] * 3 + [("b", "early", 2.0)] + [("a", "late", 2.0)] + [("c", "late", 4.0)] * 3 + [(None, "late", 0.0)] * 4
    df = spark.createDataFrame(rows, "k string, p string, v double")
    out = {r.category: r for r in decompose.shift_share(df, "k", "v", F.col("p")).collect()}
    assert set(out) == {"a", "b", "c"} and out["a"].share_late == 0.125 and out["c"].mean_early == 0
    assert out["b"].total == pytest.approx(-0.5) and out["c"].interaction == pytest.approx(1.5)


def test_word_trends_and_contributions(spark):
    rows = [(d, w, int(n)) for d in range(1700, 1901, 10) for i in [(d - 1700) // 10] for w, n in (("rock", 200 + 80 * i), ("virtue", 2000 - 80 * i), ("man", 5000))]
    decades = spark.createDataFrame(rows, "decade int, word string, cnt long")
    norms = spark.createDataFrame([("rock", 1.5), ("virtue", -1.8), ("man", 0.1)], "word string, z double")
    share = words.shares(decades, norms)
    r = {x.word: x.r for x in words.trends(share).collect()}
    assert r["rock"] > 0.9 and r["virtue"] < -0.9
    c = {x.word: x.contribution for x in words.contributions(share, (1700, 1750), (1850, 1900)).collect()}
    assert c["rock"] > 0 and c["virtue"] > 0
    by = spark.createDataFrame([("callous", 1.58, None, -1.23), ("x", None, None, 1.0)], "word string, C17 double, C18 double, C19 double")
    s = words.shifts(by, ["C17", "C18", "C19"], 2).collect()
    assert len(s) == 1 and s[0].shift == pytest.approx(-2.81) and s[0].trajectory == {"C17": 1.58, "C19": -1.23}


def test_statistics_helpers():
    assert stats.t_p(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.t_p(12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.fisher(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-6)
    x = np.arange(1500.0, 1900, 10)
    y = np.where(x < 1750, 0.001 * (x - 1750), -0.003 * (x - 1750))
    got = stats.piecewise(x, y, np.arange(1650, 1851, 10))
    assert got["breakpoint"] == 1750 and got["rise"] == pytest.approx(0.001) and got["fall"] == pytest.approx(-0.003)
    assert stats.piecewise(x[:15], y[:15], np.arange(1650, 1851, 10)) is None
    q = stats.quadratic(x, -((x - 1700) ** 2))
    assert q["vertex"] == pytest.approx(1700) and q["r2"] == pytest.approx(1)
    assert stats.lowess(x, 2 * x + 1) == pytest.approx(2 * x + 1)
    assert stats.gini(np.array([0, 0, 0, 1])) == pytest.approx(0.75)


def test_unfittable_groups_have_no_rows(spark):
    points = spark.createDataFrame([("g", 1700 + 10 * i, float(i), 3) for i in range(4)], "genre string, bin int, mean double, n_texts long")
    assert fits.piecewise(points, ["genre"]).count() == fits.smooth(points, ["genre"]).count() == fits.quadratic(points, ["genre"]).count() == 0


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5)], "i int, p double")
    assert {r.i: round(r.p_adjusted, 6) for r in fits.adjusted_p(df).collect()} == {1: 0.04, 2: 0.053333, 3: 0.053333, 4: 0.5}


def test_graph_statistics(spark):
    edges = spark.createDataFrame([("g", a, b) for a, b in ("ab", "bc", "ca", "cd", "ab", "dd")], "g string, a string, b string")
    r = graphs.statistics(edges, "g").collect()[0]
    assert (r.nodes, r.edges, r.diameter) == (4, 4, 2) and r.density == pytest.approx(2 / 3) and r.clustering == pytest.approx((1 + 1 + 1 / 3) / 4)
    assert {x.node: x.degree for x in graphs.degrees(edges, ["g"]).collect()} == {"a": 2, "b": 2, "c": 3, "d": 1}


def test_range_join_and_anti_join(spark):
    p = spark.createDataFrame([("t", i) for i in range(0, 300, 7)], "t string, at long")
    r = spark.createDataFrame([("t", 1, 10, 200), ("t", 2, 63, 64), ("u", 3, 0, 300), ("t", 4, 9, 3)], "t string, r int, lo long, hi long")
    got = {(x.at, x.r) for x in joins.within_ranges(p, r, ["t"], "at", "lo", "hi").collect()}
    assert got == {(i, k) for i in range(0, 300, 7) for k, lo, hi in ((1, 10, 200), (2, 63, 64)) if lo <= i <= hi}
    done = spark.createDataFrame([(7,), (None,)], "at long")
    assert joins.missing(p, done, ["at"]).count() == p.count() - 1


def test_samples_are_repeatable(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    a = {r.id for r in shape.hashed_sample(df, ["k"], "id", 5, 1).collect()}
    assert a == {r.id for r in shape.hashed_sample(df.repartition(7), ["k"], "id", 5, 1).collect()} and len(a) == 15
    assert 60 < shape.bernoulli(df, "id", 0.1, 2).count() < 140


def test_readers_and_resumable_sinks(spark, tmp_path):
    (tmp_path / "txt" / "a").mkdir(parents=True)
    (tmp_path / "freqs" / "a").mkdir(parents=True)
    (tmp_path / "txt" / "a" / "t 1.txt").write_text("A rock.\nTwo.")
    (tmp_path / "freqs" / "a" / "t1.json").write_text('{"rock": 2, "virtue": 1}')
    (tmp_path / "freqs" / "bad.json").write_text("not json")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path / "txt")).collect()] == [("a/t 1", "A rock.\nTwo.")]
    assert sorted(tuple(r) for r in readers.frequencies(spark, str(tmp_path / "freqs")).collect()) == [("a/t1", "rock", 2), ("a/t1", "virtue", 1)]
    (tmp_path / "f.tsv").write_text("x\trock\t2\nx\trock\t3\nx\tbad\tno\nx\tnull\t0\n")
    assert [tuple(r) for r in readers.frequency_tsv(spark, str(tmp_path / "f.tsv")).collect()] == [("x", "rock", 5)]
    (tmp_path / "c.jsonl").write_text('{"id": "t", "n": {"-0.9": 2, "3.0": 1}}\n{broken\n')
    assert sorted(tuple(r) for r in readers.count_records(spark, str(tmp_path / "c.jsonl")).collect()) == [("t", "n", -9, 2), ("t", "n", 30, 1)]
    out, df = str(tmp_path / "out"), spark.createDataFrame([(1, 0.5), (2, 0.6)], "id int, s double")
    sinks.append_new(df, out, ["id"])
    sinks.append_new(df.unionAll(spark.createDataFrame([(3, 0.7)], "id int, s double")), out, ["id"])
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        sinks.append_new(df.withColumn("more", F.lit(1)), out, ["id"])
    new = spark.createDataFrame([(2, 9.0)], "id int, s double")
    assert {tuple(r) for r in sinks.upserted(df, new, ["id"]).collect()} == {(1, 0.5), (2, 9.0)}


def test_streams(spark, tmp_path, norms):
    src, out = str(tmp_path / "in"), str(tmp_path / "scored")
    rated = norms.withColumn("lang", F.lit("en"))
    spark.createDataFrame([("t", 0, "rock and virtue", "en"), ("t", 1, "stone", "en")], "_id string, seq long, text string, lang string").write.parquet(src)
    for _ in range(2):  # run again: nothing is scored twice
        score_stream(passages(spark, src), rated, ["median"], out, str(tmp_path / "ck")).awaitTermination()
    got = {(r._id, r.seq): round(r.median, 6) for r in spark.read.parquet(out).collect()}
    assert got == {("t", 0): -0.15, ("t", 1): 0.7}
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert [(r.n, r.total) for r in event_windows(e).orderBy("start").collect()] == [(2, 3.0), (1, 4.0)]


def test_sentence_runs(spark):
    df = spark.createDataFrame([("t", "One two. Three four five. Six.")], "id string, text string")
    assert [r.sentence for r in counting.sentences_of(df, ["id"], 4).collect()] == ["One two. Three four five."]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert N.nan_to_null(df).agg(F.avg("x")).collect()[0][0] == 1.0


def test_betweenness(spark):
    """A path of four, a star of four leaves, a square, one edge, and two paths that never meet."""
    edges = [("path", a, a + 1) for a in range(3)] + [("star", 0, b) for b in range(1, 5)] + [("star", 1, 0), ("star", 2, 2)] + [("square", a, (a + 1) % 4) for a in range(4)] + [("one", 0, 1), ("apart", 0, 1), ("apart", 1, 2), ("apart", 3, 4)]
    out = graphs.betweenness(spark.createDataFrame(edges, "g string, a long, b long"), "g")
    own = {(r.g, r.node): round(r.betweenness, 6) for r in out.collect()}
    want = {("path", 0): 0, ("path", 1): 0.666667, ("path", 2): 0.666667, ("path", 3): 0, ("star", 0): 1, **{("star", b): 0 for b in range(1, 5)}, **{("square", a): 0.166667 for a in range(4)}, ("one", 0): 0, ("one", 1): 0}
    want |= {("apart", a): 0.166667 if a == 1 else 0 for a in range(5)}
    assert own == want
    assert graphs.betweenness(spark.createDataFrame([], "g string, a long, b long"), "g").count() == 0
