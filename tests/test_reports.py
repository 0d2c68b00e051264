"""Reports of arcs against a plain version, tags, places, lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.operators import fits, reports


@pytest.fixture(scope="module")
def planted(spark):
    """Concreteness that falls until 1750 and rises after, with a shift by corpus."""
    draw = np.random.default_rng(3)
    rows = [("Fiction", f"c{c}", int(y), float(abs(y - 1750) / 300 + 0.2 * c - 0.7 + draw.normal() / 50)) for y in range(1600, 1900, 2) for c in range(2)]
    return spark.createDataFrame(rows + [("Poetry", "c0", 1700, 1.0), ("Fiction", "c0", None, 1.0), (None, "c0", 1700, 1.0)], "genre string, corpus string, year int, score double"), rows


def test_arcs_like_plain(spark, planted):
    df, rows = planted
    got = reports.arcs(df).collect()
    assert [r.genre for r in got] == ["Fiction"]
    r = got[0]
    cells = {}
    for _, c, y, s in rows:
        cells.setdefault((y // 10 * 10, c), []).append(-s)
    points = sorted((b, c, np.mean(v)) for (b, c), v in cells.items())
    x, y, g = np.array([p[0] for p in points], float), np.array([p[2] for p in points]), stats.dummies([p[1] for p in points])
    best = stats.piecewise(x, y, fits.GRID, g)
    assert r.breakpoint == best["breakpoint"] and r.slope_before == pytest.approx(best["rise"]) and r.slope_after == pytest.approx(best["fall"]) and r.r2 == pytest.approx(best["r2"])
    assert r.slope_before_p < 1e-10 and r.slope_before_se > 0 and r.n_bins == 60
    text = np.array([-s for *_, s in rows])
    assert (r.start_decade, r.peak_decade, r.end_decade) in {(1600, p, 1890) for p in (1740, 1750)}
    assert r.rise_sd == pytest.approx((r.raw_peak - r.raw_start) / text.std(ddof=1)) and r.n_texts_total == 300 and r.n_texts_peak == 10
    assert r.raw_peak_pooled == pytest.approx(np.mean([-s for _, _, y, s in rows if y // 10 * 10 == r.peak_decade]))
    assert r.peak_vs_start == (pytest.approx(r.raw_peak / r.raw_start) if r.raw_peak * r.raw_start > 0 else None)
    line = reports.sentence(reports.arcs(df)).collect()[0].text
    assert line.startswith("Fiction: from ") and f"Breakpoint {r.breakpoint:.0f}" in line and "300 texts" in line
    both = reports.compared(reports.arcs(df), reports.arcs(df))
    assert both.count() == 1 and "raw_peak_counts" in both.columns
    assert reports.arcs(df.where("false")).count() == 0


def test_printed_points(spark, planted):
    points = reports.balanced(planted[0].where("genre = 'Fiction'"))
    want = {}
    for r in points.collect():
        want.setdefault(r.bin, []).append((r.adjusted, r.n_texts))
    got = {r.bin: (r.score, r.n_texts) for r in reports.printed(points).collect()}
    assert got == {b: (pytest.approx(sum(a * n for a, n in v) / sum(n for _, n in v)), sum(n for _, n in v)) for b, v in want.items()} and len(got) == 30


def test_places_and_z_of_trends(spark):
    rows = [("a", -2.0, 0.5), ("b", 0.0, None), ("c", 1.5, -0.5), ("d", 0.0, 0.5), ("e", 0.0, 0.1)]
    got = {r.word: (r.place, r.category, r.r_z) for r in reports.trend_table(spark.createDataFrame(rows, "word string, z double, r double")).collect()}
    r = np.array([0.5, -0.5, 0.5, 0.1])
    assert {w: v[0] for w, v in got.items()} == {"c": 1, "e": 2, "a": 3, "d": 4, "b": 5} and got["b"][2] is None
    assert got["c"][1:] == ("Concrete", pytest.approx((-0.5 - r.mean()) / r.std())) and got["a"][1] == "Abstract"


def test_author_means_and_tags(spark):
    df = spark.createDataFrame([("x", " ", 1, 2.0), ("x", None, 3, None), ("y", "A", 5, 1.0)], "author string, genre string, n int, v double")
    assert {(r.author, r.genre): (r.n, r.v) for r in reports.author_means(df, ["author", "genre"]).collect()} == {("x", "Unknown"): (2, 2.0), ("y", "A"): (5, 1.0)}
    scores = spark.createDataFrame([("1", 1.0, "early"), ("2", 3.0, "late"), ("3", 5.0, "late"), ("4", 9.0, None)], "_id string, s double, p string")
    tags = spark.createDataFrame([("1", "form", "a"), ("1", "form", "a"), ("2", "form", "a"), ("2", "form", "b"), ("2", "mode", "a"), ("3", "unknown", "z")], "_id string, facet string, tag string")
    got = {(r.facet, r.category): (r.n_early, r.n_late) for r in reports.by_tags(scores, tags, ["form", "flat"], "s", F.col("p")).collect()}
    assert got == {("form", "a"): (1, 1), ("form", "b"): (0, 1), ("form", "(untagged)"): (0, 1), ("flat", "a"): (1, 1), ("flat", "b"): (0, 1), ("flat", "(untagged)"): (0, 1)}


def test_rendering_with_spelling_and_lines(spark):
    from lexitide.operators import records as R

    d = spark.createDataFrame([(1, "Olde rock\nnew <b>\n\nnext olde")], "id int, text string")
    norms = spark.createDataFrame([("old", 1.5), ("rock", -1.0)], "word string, z double")
    spelling = spark.createDataFrame([("olde", "old")], "word string, modern string")
    html = R.rendered(d, ["id"], "text", norms, spelling, keep_lines=True).collect()[0].html
    assert html.count('class="concrete"') == 2 and ">Olde</span>" in html and "<br>\nnew &lt;b&gt;" in html and html.count("<p ") == 2
    assert 'class="concrete"' not in R.rendered(d, ["id"], "text", norms).collect()[0].html
    cells = spark.createDataFrame([("g", 2, "two", "B"), ("g", 1, "one", "A & <")], "g string, i int, html string, t string")
    out = R.side_by_side(cells, ["g"], "i", "t").collect()[0].html
    assert out == R.LEGEND + '<table><tr><td><h4>A &amp; &lt;</h4><div class="passage">one</div></td><td><h4>B</h4><div class="passage">two</div></td></tr></table>'


def test_saving(spark, tmp_path):
    from lexitide.operators import correction
    from lexitide.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    for name in ("t.parquet", "t.orc", "t.csv", "t.tsv.gz", "t.jsonl.gz"):
        sinks.save(df, str(tmp_path / name))
        kind = name.split(".")[1]
        back = spark.read.format({"tsv": "csv", "jsonl": "json"}.get(kind, kind)).options(header=True, sep="\t" if kind == "tsv" else ",").load(str(tmp_path / name))
        assert sorted((int(r.n), r.s) for r in back.collect()) == [(1, "a"), (2, "b")]
    sinks.save(df.select("s"), str(tmp_path / "t.txt"))
    assert spark.read.text(str(tmp_path / "t.txt")).count() == 2
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "t.xls"))
    bias = lambda *rows: spark.createDataFrame(rows, correction.BIAS)
    correction.save_bias(bias(("a", 1.0, 0.1, 5), ("b", 2.0, 0.1, 5)), str(tmp_path / "bias"), "en")
    correction.save_bias(bias(("a", 3.0, 0.1, 5)), str(tmp_path / "bias"), "fr")
    got = {r.corpus: r.coef for r in correction.load_bias(spark, str(tmp_path / "bias"), "en", "fr", "de").collect()}
    assert got == {"a": 3.0, "b": 2.0}
