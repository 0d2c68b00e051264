"""Queries on arcs, groups, decompositions, word trends and bias."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import bins
from lexitide.operators import aggregate, correction, decompose, fits, shape, words
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded
from lexitide.runtime import kept, table, table_state


def _reps(spark, sf):
    """One text of each group, and all texts in no group: one aggregate, in which a text without a group is its own."""
    rows = S.texts(spark, sf).select("_id", "year").join(S.groups(spark, sf), "_id", "left")
    return rows.groupBy(F.coalesce("group_id", "_id").alias("g")).agg(F.min_by("_id", F.struct(F.col("year").isNull(), "year", "_id")).alias("_id")).select("_id")


REPS = "reps AS (SELECT arg_min(g._id, (t.year, g._id)) AS _id FROM groups g JOIN texts t USING (_id) GROUP BY group_id UNION ALL SELECT _id FROM texts WHERE _id NOT IN (SELECT _id FROM groups))"


@query(
    f"WITH {S.SCORES}, {S.GROUPS}, {REPS}, m AS (SELECT r._id, b._id AS member FROM reps r JOIN groups a USING (_id) JOIN groups b ON a.group_id = b.group_id UNION ALL SELECT _id, _id FROM reps WHERE _id NOT IN (SELECT _id FROM groups)) "
    "SELECT m._id, round(avg(score), 6) AS score, count(DISTINCT member) AS n_versions FROM m JOIN scores s ON s._id = m.member GROUP BY m._id"
)
def arc_scores_by_group(spark, sf):
    return rounded(aggregate.group_scores(_reps(spark, sf), S.groups(spark, sf), S.scores(spark, sf).select("_id", "score"), ["score"]))


@query(f"WITH {S.SCORES}, {S.GROUPS}, {REPS} SELECT _id, round(score, 6) AS score FROM scores WHERE _id IN (SELECT _id FROM reps)")
def arc_scores_rep_only(spark, sf):
    return rounded(S.scores(spark, sf).join(_reps(spark, sf), "_id", "left_semi").select("_id", "score"))


@query(f"WITH {S.SCORES}, {S.GROUPS} SELECT group_id, round(avg(score), 6) AS score, count(*) AS n_versions, round(coalesce(stddev_samp(score), 0), 6) AS score_sd FROM scores JOIN groups USING (_id) GROUP BY group_id")
def version_means(spark, sf):
    from lexitide.operators.scoring import version_means as means

    return rounded(means(S.scores(spark, sf).join(S.groups(spark, sf), "_id"), "group_id", ["score"], "score"))


@query(f"WITH {S.TEXTS}, {S.GROUPS}, p AS (SELECT group_id, list_sort(list(DISTINCT corpus)) AS paths FROM texts JOIN groups USING (_id) GROUP BY group_id) SELECT array_to_string(paths, ',') AS paths, min(group_id) AS group_id FROM p GROUP BY paths")
def group_path_sets(spark, sf):
    items = S.texts(spark, sf).join(S.groups(spark, sf), "_id")
    return aggregate.path_sets(items, "group_id", "corpus").select(F.array_join("paths", ",").alias("paths"), "group_id")


@query("SELECT c_custkey, max(o_orderkey) AS o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders GROUP BY o_custkey) GROUP BY c_custkey")
def latest_version(spark, sf):
    o = table(spark, sf, "orders").withColumn("version", F.struct("o_orderdate", "o_orderkey"))
    return aggregate.latest(o, ["o_custkey"], "version").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query(f"WITH {S.SCORES} SELECT genre, CAST(floor(year / 10) * 10 AS INTEGER) AS bin, round(avg(score), 6) AS mean, count(*) AS n_texts FROM scores WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def arc_bins(spark, sf):
    return rounded(aggregate.bin_means(S.scores(spark, sf), "score", 10, ["genre"], 2))


@query(f"WITH {S.SCORES}, t AS (SELECT corpus FROM scores GROUP BY corpus ORDER BY count(*) DESC, corpus LIMIT 5) SELECT CASE WHEN corpus IN (SELECT corpus FROM t) THEN corpus ELSE 'Other' END AS corpus, CAST(floor(year / 50) * 50 AS INTEGER) AS bin, round(avg(score), 6) AS mean, count(*) AS n_texts FROM scores WHERE score IS NOT NULL GROUP BY ALL")
def arc_bins_top_subgroups(spark, sf):
    return rounded(aggregate.bin_means(aggregate.top_or_other(S.scores(spark, sf), "corpus", 5), "score", 50, ["corpus"]))


@query(f"WITH {S.SCORES}, p AS (SELECT corpus, CAST(floor(year / 50) * 50 AS INTEGER) AS bin, avg(score) AS mean, count(*) AS n FROM scores WHERE score IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT bin, round(sum(mean * n) / sum(n), 6) AS mean, sum(n) AS n_texts FROM p GROUP BY bin")
def arc_over_corpora(spark, sf):
    return rounded(aggregate.over_corpora(aggregate.bin_means(S.scores(spark, sf), "score", 50, ["corpus"], 3), ["bin"]))


@query(f"WITH {S.SCORES} SELECT lang, CASE WHEN year >= 1500 AND year < 1700 THEN '1500-1699' WHEN year >= 1700 AND year < 1900 THEN '1700-1899' END AS period, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score) / sqrt(count(score)), 6) AS se FROM scores GROUP BY ALL")
def abstractness_by_language(spark, sf):
    s = S.scores(spark, sf).withColumn("period", bins.labelled_periods(F.col("year"), [1500, 1700, 1900]))
    return rounded(aggregate.mean_and_error(s, "score", ["lang", "period"]))


@query(f"WITH {S.ORDERS}, z AS (SELECT *, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS z FROM o) SELECT segment, count(z) AS n, round(avg(z), 6) AS mean, round(stddev_samp(z) / sqrt(count(z)), 6) AS se FROM z GROUP BY segment")
def standardised_means(spark, sf):
    return rounded(aggregate.standardised(S.orders(spark, sf), "price", ["segment"]))


@query(f"WITH {S.TEXTS} SELECT corpus, count(*) AS n, count(year) AS n_dated, min(year) AS first, max(year) AS last, array_to_string(list_sort(list(DISTINCT genre)), ',') AS genres FROM texts GROUP BY corpus HAVING count(*) >= 5")
def corpus_summary(spark, sf):
    return aggregate.summary(S.texts(spark, sf, ("genre",)), 5)


@query(f"WITH {S.SCORES} SELECT count(*) AS n, round(avg(CASE WHEN score IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(min(score), 6) AS low, round(max(score), 6) AS high FROM scores")
def score_sanity(spark, sf):
    return rounded(aggregate.sanity(S.scores(spark, sf), "score"))


@query(f"WITH {S.TEXTS} SELECT _id, year, (SELECT count(*) FROM texts WHERE genre IN ('Fiction', 'Poetry') AND corpus IN ('src0', 'src1', 'src2') AND year >= 1600 AND year <= 1899) AS total FROM texts WHERE genre IN ('Fiction', 'Poetry') AND corpus IN ('src0', 'src1', 'src2') AND year >= 1600 AND year <= 1899 ORDER BY year, _id LIMIT 10 OFFSET 5")
def text_page(spark, sf):
    own = aggregate.where(S.texts(spark, sf, ("genre",)), ["Fiction", "Poetry"], ["src0", "src1", "src2"], years=(1600, 1899)).select("_id", "year")
    return aggregate.page(own, "year", "_id", offset=5, size=10)


@query(f"WITH {S.TEXTS} SELECT _id FROM texts WHERE starts_with(_id, '_src1/')")
def literal_prefix(spark, sf):
    return aggregate.with_prefix(S.texts(spark, sf), "_src1/").select("_id")


@query(f"WITH {S.TEXTS} SELECT _id, year FROM texts WHERE (corpus <> 'src1' OR year BETWEEN 1600 AND 1800) AND (corpus <> 'src2' OR year >= 1700)")
def corpus_year_bounds(spark, sf):
    bounds = spark.createDataFrame([("src1", 1600, 1800), ("src2", 1700, None)], "corpus string, lo int, hi int")
    return aggregate.bounded_years(S.texts(spark, sf), bounds).select("_id", "year")


@query(
    f"WITH {S.TEXTS} SELECT _id, CAST(floor(year / 25) * 25 AS INTEGER) AS quarter, CASE WHEN year >= 1500 THEN CAST(floor(year / 100) * 100 AS INTEGER) ELSE 1400 END AS century_bin, 'C' || (year // 100 + 1) AS century, 'C' || (year // 100 + 1) || CASE WHEN year % 100 < 50 THEN 'e' ELSE 'l' END AS half, "
    "CASE WHEN n_chars > 0 AND n_chars <= 10000 THEN '<10k' WHEN n_chars > 10000 AND n_chars <= 30000 THEN '10-30k' WHEN n_chars > 30000 AND n_chars <= 80000 THEN '30-80k' WHEN n_chars > 80000 AND n_chars <= 150000 THEN '80-150k' WHEN n_chars > 150000 THEN '>150k' ELSE 'nan' END AS length, "
    "CASE WHEN year < 1600 THEN 1600 - (1600 - year) * 0.25 ELSE year END AS compressed FROM texts"
)
def labels_and_bins(spark, sf):
    y = F.col("year")
    return S.texts(spark, sf, ("n_chars",)).select(
        "_id", bins.bin_start(y, 25).alias("quarter"), bins.passage_period(y).alias("century_bin"), bins.century_label(y).alias("century"), bins.half_century_label(y).alias("half"), bins.length_class(F.col("n_chars")).alias("length"), bins.compressed_year(y).alias("compressed")
    )


@query(f"WITH {S.ORDERS}, c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_custkey, n, CASE WHEN n >= 10 THEN 'prolific' WHEN n >= 3 THEN 'moderate' ELSE 'single' END AS class FROM c")
def productivity_class(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("class", bins.productivity(F.col("n")))


def _shift_sql(category: str, keys: str = "", source: str = "o", value: str = "price", least: int = 1) -> str:
    k, by = (f"{keys}, ", f"PARTITION BY {keys}, p") if keys else ("", "PARTITION BY p")
    pick = lambda p, c: f"coalesce(max({c}) FILTER (p = '{p}'), 0)"
    return (
        f"c0 AS (SELECT {k}{category} AS category, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'early' WHEN year BETWEEN 1998 AND 2001 THEN 'late' END AS p, {value} AS v FROM {source}), "
        f"c1 AS (SELECT {k}category, p, count(v) AS n, avg(v) AS m FROM c0 WHERE p IS NOT NULL GROUP BY ALL), c2 AS (SELECT *, n / sum(n) OVER ({by}) AS s FROM c1), "
        f"c3 AS (SELECT {k}category, {pick('early', 'n')} AS n_early, {pick('early', 's')} AS share_early, {pick('early', 'm')} AS mean_early, {pick('late', 'n')} AS n_late, {pick('late', 's')} AS share_late, {pick('late', 'm')} AS mean_late FROM c2 WHERE category IS NOT NULL GROUP BY ALL), "
        f"rows AS (SELECT *, round((share_late - share_early) * mean_early, 6) AS composition, round(share_early * (mean_late - mean_early), 6) AS within, round((share_late - share_early) * (mean_late - mean_early), 6) AS interaction FROM c3 WHERE n_early >= {least} OR n_late >= {least})"
    )


_OUT = "n_early, round(share_early, 6) AS share_early, round(mean_early, 6) AS mean_early, n_late, round(share_late, 6) AS share_late, round(mean_late, 6) AS mean_late, round(composition, 2) AS composition, round(within, 2) AS within, round(interaction, 2) AS interaction"
_COLS = ["n_early", "share_early", "mean_early", "n_late", "share_late", "mean_late", "composition", "within", "interaction"]


def _when():
    return F.when(F.col("year").between(1995, 1997), "early").when(F.col("year").between(1998, 2001), "late")


def _two(df, *more):
    out = rounded(df)
    return out.select(*more, *(F.round(c, 2).alias(c) if c in ("composition", "within", "interaction") else c for c in _COLS))


@query(f"WITH {S.ORDERS}, {_shift_sql('segment')} SELECT category, {_OUT} FROM rows")
def shift_share(spark, sf):
    return _two(decompose.shift_share(S.orders(spark, sf), "segment", "price", _when()), "category")


@query(f"WITH {S.ORDERS}, {_shift_sql('segment')} SELECT round(sum(composition), 1) AS composition, round(sum(within), 1) AS within, round(sum(interaction), 1) AS interaction FROM rows")
def shift_share_totals(spark, sf):
    out = decompose.totals(decompose.shift_share(S.orders(spark, sf), "segment", "price", _when()))
    return out.select(*(F.round(c, 1).alias(c) for c in ("composition", "within", "interaction")))


@query(
    f"WITH {S.ORDERS}, tall AS (SELECT year, price, facet, label FROM (UNPIVOT (SELECT year, price, segment, priority, CAST(nation AS VARCHAR) AS nation FROM o) ON segment, priority, nation INTO NAME facet VALUE label)), {_shift_sql('label', 'facet', 'tall')} SELECT facet, category, {_OUT} FROM rows"
)
def shift_share_facets(spark, sf):
    return _two(decompose.by_facets(S.orders(spark, sf), ["segment", "priority", "nation"], "price", _when()), "facet", "category")


@query(f"WITH {S.ORDERS}, {_shift_sql('segment', 'corpus')}, w AS (SELECT corpus, count(*) AS w FROM c0 WHERE p IS NOT NULL GROUP BY 1), x AS (SELECT *, w / sum(w) OVER (PARTITION BY category) AS ws FROM rows JOIN w USING (corpus)) SELECT category, round(sum(composition * ws), 2) AS composition, round(sum(within * ws), 2) AS within, round(sum(interaction * ws), 2) AS interaction FROM x GROUP BY category")
def shift_share_within_corpora(spark, sf):
    out = decompose.within_corpora(S.orders(spark, sf), "segment", "price", _when())
    return out.select("category", *(F.round(c, 2).alias(c) for c in ("composition", "within", "interaction")))


@query(
    f"WITH {S.ORDERS}, c0 AS (SELECT segment AS category, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'early' WHEN year BETWEEN 1998 AND 2001 THEN 'late' END AS p, price AS v FROM o), c1 AS (SELECT category, p, count(v) AS n, avg(v) AS m FROM c0 WHERE p IS NOT NULL GROUP BY ALL HAVING count(v) >= 30), "
    "c2 AS (SELECT * FROM c1 WHERE category IN (SELECT category FROM c1 GROUP BY 1 HAVING count(*) = 2)), c3 AS (SELECT *, n / sum(n) OVER (PARTITION BY p) AS s FROM c2), c4 AS (SELECT category, max(s) FILTER (p = 'early') AS se, max(s) FILTER (p = 'late') AS sl, max(m) FILTER (p = 'early') AS me, max(m) FILTER (p = 'late') AS ml FROM c3 GROUP BY 1) "
    "SELECT category, round((sl - se) * me, 1) AS composition, round(se * (ml - me), 1) AS within, round((sl - se) * (ml - me), 1) AS interaction FROM c4"
)
def shift_share_common(spark, sf):
    out = decompose.common_only(S.orders(spark, sf), "segment", "price", _when())
    return out.select("category", *(F.round(c, 1).alias(c) for c in ("composition", "within", "interaction")))


DECADES = f"{S.NORMS}, d0 AS (SELECT CAST(floor(year / 10) * 10 AS INTEGER) AS decade, word, sum(cnt) AS cnt FROM freqs WHERE lang = 'en' AND regexp_matches(word, '^\\p{{L}}+$') GROUP BY ALL), top AS (SELECT word FROM d0 GROUP BY word ORDER BY sum(cnt) DESC, word LIMIT 10000), d AS (SELECT * FROM d0 WHERE word IN (SELECT word FROM top))"
SHARES = (
    f"{DECADES}, en AS (SELECT word, z_quality AS z FROM norms WHERE lang = 'en' AND z_quality IS NOT NULL), k0 AS (SELECT decade, word, z, cnt, sum(cnt) OVER (PARTITION BY word) AS n FROM d JOIN en USING (word)), k AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY decade) AS p FROM k0 WHERE n >= 20), "
    "grid AS (SELECT * FROM (SELECT DISTINCT word, z FROM k), (SELECT DISTINCT decade FROM k0 WHERE n >= 20)), shares AS (SELECT decade, word, z, coalesce(p, 0) AS p FROM grid LEFT JOIN k USING (decade, word, z))"
)


def _decades(spark, sf):
    return kept(spark, "decades", table_state(spark, sf, "documents"), lambda: words.by_decade_of_most_frequent(S.counted(spark, sf).where("lang = 'en'"), 10_000))


def _shares(spark, sf):
    norms = S.norms(spark, sf).where("lang = 'en'").select("word", F.col("z_quality").alias("z"))
    return kept(spark, "shares", S._states(spark, sf), lambda: words.shares(_decades(spark, sf), norms, 20))


@query(f"WITH {DECADES} SELECT * FROM d")
def decade_words(spark, sf):
    return _decades(spark, sf)


@query(f"WITH {DECADES} SELECT decade, word, 2 * cnt AS cnt FROM d")
def decade_words_added(spark, sf):
    d = _decades(spark, sf)
    return words.added(d, d)


@query(f"WITH {SHARES} SELECT decade, word, round(z, 6) AS z, round(p, 9) AS p FROM shares")
def decade_shares(spark, sf):
    return _shares(spark, sf).select("decade", "word", F.round("z", 6).alias("z"), F.round("p", 9).alias("p"))


@query(f"WITH {SHARES}, s AS (SELECT decade, sum(p * z) AS score FROM shares GROUP BY decade) SELECT word, round(z, 6) AS z, round(corr(p, score), 5) AS r, round(avg(p), 9) AS mean_p FROM shares JOIN s USING (decade) GROUP BY word, z")
def word_trends(spark, sf):
    t = words.trends(_shares(spark, sf))
    return t.select("word", F.round("z", 6).alias("z"), F.round("r", 5).alias("r"), F.round("mean_p", 9).alias("mean_p"))


@query(
    f"WITH {SHARES}, c AS (SELECT word, z, coalesce(avg(p) FILTER (decade BETWEEN 1500 AND 1650), 0) AS e, coalesce(avg(p) FILTER (decade BETWEEN 1800 AND 1950), 0) AS l FROM shares GROUP BY ALL) SELECT word, round(z, 6) AS z, round(e, 8) AS p_early, round(l, 8) AS p_late, round((l - e) * z, 8) AS contribution, CASE WHEN e > 0 THEN round((l - e) / e * 100, 4) END AS freq_change_pct FROM c"
)
def word_contributions(spark, sf):
    c = words.contributions(_shares(spark, sf), (1500, 1650), (1800, 1950))
    return c.select("word", F.round("z", 6).alias("z"), *(F.round(x, 8).alias(x) for x in ("p_early", "p_late", "contribution")), F.round("freq_change_pct", 4).alias("freq_change_pct"))


_CC = [f"C{c}" for c in S.CENTURIES]


@query(f"WITH {S.CENTURY_NORMS}, v AS (SELECT word, list_filter([{', '.join(_CC)}], lambda x: x IS NOT NULL) AS v FROM cnorms WHERE lang = 'en') SELECT word, len(v) AS n_periods, round(v[1], 6) AS first_z, round(v[-1], 6) AS last_z, round(v[-1] - v[1], 6) AS shift FROM v WHERE len(v) >= 2")
def word_shifts(spark, sf):
    return rounded(words.shifts(S.century_norms(spark, sf).where("lang = 'en'"), _CC, 2).drop("trajectory"))


def _bias_rows(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("l_partkey").alias("group_id"), F.col("l_returnflag").alias("corpus"), (F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 0.1).otherwise(0.0)).alias("score"))


@query()
def corpus_bias(spark, sf):
    return rounded(correction.corpus_bias(_bias_rows(spark, sf), "N"))


@query()
def corpus_bias_corrected(spark, sf):
    rows = _bias_rows(spark, sf)
    out = correction.corrected(rows, correction.corpus_bias(rows, "N"))
    return rounded(out.groupBy("corpus").agg(F.avg("score").alias("mean"), F.count("*").alias("n")))


@query("WITH g AS (SELECT l_partkey, l_returnflag, l_discount, avg(l_discount) OVER (PARTITION BY l_partkey) AS m FROM lineitem) SELECT l_returnflag, round(avg(l_discount - m), 6) AS demeaned, count(*) AS n FROM g GROUP BY 1")
def demeaned(spark, sf):
    from pyspark.sql import Window

    li = table(spark, sf, "lineitem")
    own = li.withColumn("d", F.col("l_discount") - F.avg("l_discount").over(Window.partitionBy("l_partkey")))
    return rounded(own.groupBy("l_returnflag").agg(F.avg("d").alias("demeaned"), F.count("*").alias("n")))


def _points(spark, sf, least=1):
    return aggregate.bin_means(S.scores(spark, sf), "score", 10, ["genre"], least)


@query()
def fit_piecewise(spark, sf):
    return rounded(fits.piecewise(_points(spark, sf), ["genre"]))


@query()
def fit_quadratic(spark, sf):
    return rounded(fits.quadratic(_points(spark, sf), ["genre"]))


@query()
def fit_smooth(spark, sf):
    return rounded(fits.smooth(_points(spark, sf), ["genre"]))


@query()
def fit_adjusted(spark, sf):
    points = aggregate.bin_means(S.scores(spark, sf), "score", 50, ["genre", "corpus"])
    return rounded(fits.adjusted(points, ["genre"], "corpus"))


@query()
def fit_arc_statistics(spark, sf):
    return rounded(fits.arc_statistics(_points(spark, sf), ["genre"]))


@query(f"WITH {S.SCORES} SELECT genre, round(regr_slope(score, year), 8) AS slope, round(regr_intercept(score, year), 6) AS intercept, round(regr_r2(score, year), 6) AS r2, regr_count(score, year) AS n FROM scores GROUP BY genre")
def fit_linear(spark, sf):
    out = fits.linear(S.scores(spark, sf), ["genre"], "year", "score")
    return out.select("genre", F.round("slope", 8).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(f"WITH {S.ORDERS}, l AS (SELECT o_orderkey, segment, price, ln(1 + nation) AS x FROM o), f AS (SELECT segment, regr_slope(price, x) AS s, regr_intercept(price, x) AS i FROM l GROUP BY 1) SELECT o_orderkey, round(price - (i + s * x), 3) AS residual FROM l JOIN f USING (segment)")
def fit_residuals(spark, sf):
    return fits.residuals(S.orders(spark, sf), "nation", "price", ["segment"]).select("o_orderkey", F.round("residual", 3).alias("residual"))


@query()
def test_welch(spark, sf):
    out = fits.welch(table(spark, sf, "lineitem"), ["l_linestatus"], "l_returnflag", "l_discount", "A", "N")
    wide = fits.welch(table(spark, sf, "lineitem"), ["l_linenumber"], "l_linestatus", "l_discount", "F", "O").select(F.col("l_linenumber").cast("string").alias("l_linestatus"), "diff", "t", "dof", "p")
    return rounded(fits.adjusted_p(out.unionByName(wide)))


@query()
def test_fisher(spark, sf):
    li = table(spark, sf, "lineitem")
    flag, late = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    counts = li.groupBy("l_linenumber").agg(F.count_if(flag & late).alias("a"), F.count_if(flag & ~late).alias("b"), F.count_if(~flag & late).alias("c"), F.count_if(~flag & ~late).alias("d"))
    return rounded(fits.adjusted_p(fits.fisher(counts, ["l_linenumber"])))


@query(f"WITH {S.ORDERS}, c AS (SELECT year, segment, avg(price) AS m, count(*) AS n FROM o GROUP BY ALL) SELECT year, segment, round(m, 4) AS mean, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM c")
def shares_by_year(spark, sf):
    out = S.orders(spark, sf).groupBy("year", "segment").agg(F.round(F.avg("price"), 4).alias("mean"), F.count("*").alias("n"))
    return out.withColumn("share", F.round(shape.share_in("n", "year"), 6))
