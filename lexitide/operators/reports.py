"""Reports as tables: arcs by genre with their turning points, shifts by genre tag, trends in order, means by author."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import stats
from lexitide.functions.bins import same_sign_ratio
from lexitide.operators import aggregate, decompose, fits
from lexitide.operators.norms import with_zscores
from lexitide.operators.order import places
from lexitide.runtime import Scratch

SLOPES = "breakpoint double, slope_before double, slope_before_se double, slope_before_p double, slope_after double, slope_after_se double, slope_after_p double, r2 double, n_bins long"


def slopes(points: DataFrame, keys: list[str], fixed: str, grid: np.ndarray = fits.GRID) -> DataFrame:
    """Slopes before and after the breakpoint with errors and p, effects of fixed taken out. points: keys, bin, fixed, mean; a few bins by group."""

    def fit(pdf):
        pdf = pdf.sort_values(["bin", fixed])
        x, y, extra = pdf["bin"].to_numpy(float), pdf["mean"].to_numpy(float), stats.dummies(pdf[fixed].astype(str))
        found = stats.piecewise(x, y, grid, extra)
        if found is None:
            return None
        knee = found["breakpoint"]
        own = stats.ols(y, np.column_stack([np.ones_like(x), np.minimum(x - knee, 0), np.maximum(x - knee, 0), extra]))
        cells = {f"slope_{side}{end}": [own[what][i]] for i, side in ((1, "before"), (2, "after")) for end, what in (("", "coef"), ("_se", "se"), ("_p", "p"))}
        return {"breakpoint": [knee], **cells, "r2": [own["r2"]], "n_bins": [len(x)]}

    return fits._by(points, keys, fit, SLOPES)


def balanced(scores: DataFrame, by: int = 10, least: int = 3, grid: np.ndarray = fits.GRID) -> DataFrame:
    """(genre, bin, corpus, mean, n_texts, adjusted): points by bin and corpus, less the corpora's effects."""
    points = Scratch(scores.sparkSession, "report").save(aggregate.bin_means(scores, "score", by, ["genre", "corpus"], least), "points")
    out = fits.adjusted(points, ["genre"], "corpus", grid=grid)
    return points.join(out.select("genre", "bin", "corpus", "adjusted"), ["genre", "bin", "corpus"])


def printed(points: DataFrame) -> DataFrame:
    """(genre, bin, score, n_texts): the corpora's points in one, weighted by their texts. points: balanced()."""
    return points.groupBy("genre", "bin").agg((F.sum(F.col("adjusted") * F.col("n_texts")) / F.sum("n_texts")).alias("score"), F.sum("n_texts").alias("n_texts"))


def arcs(scores: DataFrame, by: int = 10, least: int = 3, grid: np.ndarray = fits.GRID) -> DataFrame:
    """A row for each genre: breakpoint and slopes, the decades of start, peak and end and the values there, rise and fall in standard
    deviations of texts, and ratios where both values have one sign. scores: genre, corpus, year, score.

    Values are the score times -1: abstractness. Decades are chosen and told by the points less corpora's effects, averaged over
    corpora; pooled values are means of all texts of the decade. The start is the lowest decade up to the peak, the end the lowest from it on, the earliest of
    equals. Genres with too few points for the two lines have nulls there, those with under ten points no row."""
    own = Scratch(scores.sparkSession, "report").save(scores.where("genre is not null and year is not null and score is not null").withColumn("score", -F.col("score")), "scores")
    points = Scratch(scores.sparkSession, "report").save(balanced(own, by, least, grid), "balanced")
    decade = points.groupBy("genre", "bin").agg(F.avg("adjusted").alias("v"))
    pooled = own.groupBy("genre", (F.floor(F.col("year") / by) * by).cast("int").alias("bin")).agg(F.avg("score").alias("pooled"), F.count("*").alias("n"))
    rows = decade.join(pooled, ["genre", "bin"])
    listed = rows.groupBy("genre").agg(F.array_sort(F.collect_list(F.struct("bin", "v", "pooled", "n"))).alias("d"))  # a few decades
    top = lambda d, sign: F.array_min(F.transform(d, lambda x: F.struct((-x["v"] if sign < 0 else x["v"]).alias("k"), x["bin"].alias("bin"), x["v"].alias("v"), x["pooled"].alias("pooled"), x["n"].alias("n"))))
    listed = listed.withColumn("peak", top(F.col("d"), -1))
    listed = listed.withColumn("start", top(F.filter("d", lambda x: x["bin"] <= F.col("peak.bin")), 1)).withColumn("end", top(F.filter("d", lambda x: x["bin"] >= F.col("peak.bin")), 1))
    texts = own.groupBy("genre").agg(F.stddev_samp("score").alias("sd"), F.count("*").alias("n_texts_total"))
    out = listed.join(texts, "genre").join(slopes(points.select("genre", "bin", "corpus", "mean"), ["genre"], "corpus", grid), "genre", "left")
    v = lambda end: F.col(f"{end}.v")
    cells = [F.col(f"{e}.bin").alias(f"{e}_decade") for e in ("start", "peak", "end")] + [v(e).alias(f"raw_{e}") for e in ("start", "peak", "end")] + [F.col(f"{e}.pooled").alias(f"raw_{e}_pooled") for e in ("start", "peak", "end")]
    cells += [((v("peak") - v("start")) / F.nullif("sd", F.lit(0.0))).alias("rise_sd"), ((v("peak") - v("end")) / F.nullif("sd", F.lit(0.0))).alias("fall_sd")]
    cells += [same_sign_ratio(v(a), v(b)).alias(f"{a}_vs_{b}") for a, b in (("peak", "start"), ("peak", "end"), ("start", "end"))]
    names = [c.split()[0] for c in SLOPES.split(", ")]
    return out.select("genre", *names, *cells, *(F.col(f"{e}.n").alias(f"n_texts_{e}") for e in ("start", "peak", "end")), "n_texts_total")


def sentence(report: DataFrame) -> DataFrame:
    """(genre, text): a row of arcs() in words."""
    ratio = lambda c: F.coalesce(F.format_string("%.2fx", c), F.lit("N/A (sign change)"))
    knee = F.coalesce(F.format_string("%.0f", "breakpoint"), F.lit("insufficient data"))
    number = lambda f, c: F.coalesce(F.format_string(f, c), F.lit("n/a"))
    parts = [
        F.col("genre"), F.lit(": from "), number("%.4f", "raw_start"), F.lit(" in the "), F.col("start_decade").cast("string"), F.lit("s to "), number("%.4f", "raw_peak"), F.lit(" in the "), F.col("peak_decade").cast("string"), F.lit("s ("), ratio("peak_vs_start"), F.lit(", "), number("%+.2f", "rise_sd"),
        F.lit(" SD), then to "), number("%.4f", "raw_end"), F.lit(" in the "), F.col("end_decade").cast("string"), F.lit("s ("), ratio("peak_vs_end"), F.lit("). Breakpoint "), knee, F.lit(", slopes "), number("%+.5f", "slope_before"), F.lit(" and "), number("%+.5f", "slope_after"), F.lit(" a year; "), F.col("n_texts_total").cast("string"), F.lit(" texts."),
    ]
    return report.select("genre", F.concat(*parts).alias("text"))


def compared(one: DataFrame, other: DataFrame, suffixes: tuple[str, str] = ("_scores", "_counts")) -> DataFrame:
    """Two reports side by side by genre, as of scores and of counts."""
    named = lambda df, s: df.select("genre", *(F.col(c).alias(c + s) for c in df.columns if c != "genre"))
    return named(one, suffixes[0]).join(named(other, suffixes[1]), "genre", "full")


def by_tags(scores: DataFrame, tags: DataFrame, facets: list[str], value: str, period: Column, least: int = 1) -> DataFrame:
    """Shift-share by genre tag, all facets in one pass; the facet flat pools the tags of all. scores: _id, ...; tags: _id, facet, tag.

    A text with several tags of a facet counts in each, one without in (untagged); tags of the facet unknown go."""
    own = tags.where("tag is not null and facet is not null and facet <> 'unknown'").select("_id", "facet", "tag").distinct()
    flat = own.select("_id", F.lit("flat").alias("facet"), "tag").distinct()
    wanted = own.unionByName(flat).where(F.col("facet").isin(facets))
    rows = scores.select("_id", value, period.alias("__when")).where(F.col("__when").isNotNull() & F.col(value).isNotNull()).withColumn("facet", F.explode(F.array(*map(F.lit, facets))))
    tall = rows.join(wanted, ["_id", "facet"], "left").withColumn("tag", F.coalesce("tag", F.lit("(untagged)")))
    return decompose.shift_share(tall, "tag", value, F.col("__when"), ["facet"], least)


def trend_table(trends: DataFrame) -> DataFrame:
    """trends (word, z, r) with category, the z-score of r over the words that have one, and the place by r, lowest first, then by word.

    Places come from sorted ranges, so the words aren't numbered in one task; words without r come last."""
    own = Scratch(trends.sparkSession, "trends").save(with_zscores(trends, [], {"r_z": "r"}), "trends")
    category = F.when(F.col("z") <= -1, "Abstract").when(F.col("z") >= 1, "Concrete").otherwise("Neither")
    own = own.withColumn("category", category).withColumn("__none", F.col("r").isNull().cast("int"))
    place = places(own, [], ["__none", "r", "word"]).select(F.col("word").alias("__w"), F.col("__last").alias("place"))
    return own.join(place, F.col("word") == F.col("__w")).drop("__w", "__none")


def author_means(counts: DataFrame, by: list[str]) -> DataFrame:
    """Mean of every numeric column by author (and genre): by are the columns that name them; blank names stand for Unknown."""
    named = {b: F.when(F.trim(F.coalesce(b, F.lit(""))) == "", "Unknown").otherwise(F.col(b)) for b in by}
    numeric = [c for c, t in counts.dtypes if c not in by and t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal")]
    return counts.withColumns(named).groupBy(*by).agg(*(F.avg(c).alias(c) for c in numeric))


def listing(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n): the values of each column with their rows, in one pass."""
    tall = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "name", "value")
    return tall.groupBy("name", "value").agg(F.count("*").alias("n"))
