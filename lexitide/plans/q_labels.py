"""Queries on labels from metadata, baselines and detrended means."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import bins, labels
from lexitide.operators import shape
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded
from lexitide.runtime import table


@query(
    "SELECT doc_id, CASE WHEN source = (SELECT min(source) FROM documents WHERE source LIKE '%1') THEN 'Letters' WHEN lang = 'fr' THEN 'Roman' WHEN lang = 'de' THEN 'de' "
    r"WHEN regexp_matches(lower(text), '(^|[^\p{L}])th') THEN 'Th' WHEN regexp_matches(lower(text), '(^|[^\p{L}])an') THEN 'An' ELSE '' END AS genre FROM documents"
)
def genre_harmonised(spark, sf):
    d = table(spark, sf, "documents")
    special = d.where(F.col("source").endswith("1")).agg(F.min("source")).collect()[0][0]
    raw = F.when(F.col("lang").isin("fr", "de"), F.col("lang"))
    out = labels.harmonised_genre(F.col("source"), raw, F.col("text"), {special: "Letters"} if special else {}, {"fr": "Roman"}, {"th": "Th", "an": "An"})
    return d.select("doc_id", out.alias("genre"))


@query("WITH p AS (SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(replace(p_type, ' ', '|'), '[|,]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM part) SELECT p_partkey, coalesce(list_filter(l, lambda x: x <> 'STANDARD')[1], l[1]) AS genre FROM p")
def genre_first_specific(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.first_specific(F.replace("p_type", F.lit(" "), F.lit("|")), "STANDARD").alias("genre"))


@query("SELECT p_partkey, contains(lower(concat_ws(' ', p_type, p_name)), 'steel') OR contains(lower(concat_ws(' ', p_type, p_name)), 'red') AS flag FROM part")
def metadata_flags(spark, sf):
    return table(spark, sf, "part").select("p_partkey", labels.mentions(["steel", "red"], F.col("p_type"), F.col("p_name")).alias("flag"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'fr' WHEN lang IN ('en', 'fr', 'de') THEN lang WHEN doc_id % 2 = 0 THEN 'de' ELSE 'en' END AS language FROM documents")
def language_resolved(spark, sf):
    explicit, default = F.when(F.col("doc_id") % 7 == 0, "FR"), F.when(F.col("doc_id") % 2 == 0, "de").otherwise("xx")
    return table(spark, sf, "documents").select("doc_id", labels.resolved_language(explicit, F.col("lang"), default, ["en", "fr", "de"]).alias("language"))


@query("WITH c AS (SELECT conv_id, turn, (turn - min(turn) OVER w) / nullif(max(turn) OVER w - min(turn) OVER w, 0)::DOUBLE AS p FROM conversations WINDOW w AS (PARTITION BY conv_id)) SELECT round(round_even(p * 10, 0) / 10, 6) AS position, count(*) AS n FROM c WHERE p IS NOT NULL GROUP BY 1")
def positions_by_decile(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    place = F.try_divide(F.col("turn") - F.min("turn").over(w), F.max("turn").over(w) - F.min("turn").over(w))
    c = table(spark, sf, "conversations").withColumn("p", place).where("p is not null")
    return rounded(c.groupBy(labels.decile(F.col("p")).alias("position")).agg(F.count("*").alias("n")))


@query(f"WITH {S.ORDERS} SELECT o_orderkey, year, round(avg(price) OVER (PARTITION BY year), 4) AS baseline, round(price - avg(price) OVER (PARTITION BY year), 4) AS deviation FROM o")
def baseline_deviation(spark, sf):
    return rounded(shape.from_baseline(S.orders(spark, sf), "year", "price").select("o_orderkey", "year", "baseline", "deviation"), 4)


@query(f"WITH {S.ORDERS}, l AS (SELECT regr_slope(price, year) AS s, regr_intercept(price, year) AS b FROM o), r AS (SELECT segment, price - b - s * year AS e FROM o, l) SELECT segment, count(*) AS n, round(avg(e), 2) AS mean, round(1.96 * stddev_samp(e) / sqrt(count(*)), 2) AS ci FROM r GROUP BY 1")
def detrended_means(spark, sf):
    return rounded(shape.detrended_means(S.orders(spark, sf), "segment", "year", "price", 2), 2)


@query("SELECT CASE WHEN n_chars > 0 AND n_chars <= 10000 THEN '<10k' WHEN n_chars > 10000 AND n_chars <= 30000 THEN '10-30k' WHEN n_chars > 30000 AND n_chars <= 80000 THEN '30-80k' WHEN n_chars > 80000 AND n_chars <= 150000 THEN '80-150k' WHEN n_chars > 150000 THEN '>150k' ELSE 'nan' END AS length, count(*) AS n FROM documents GROUP BY 1")
def length_classes(spark, sf):
    return table(spark, sf, "documents").groupBy(bins.length_class(F.col("n_chars")).alias("length")).agg(F.count("*").alias("n"))
