"""Queries on records, tags, vocabularies, markup, regression and arcs adjusted for their corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import bins
from lexitide.functions import text as T
from lexitide.operators import aggregate, correction, counting, embeddings, fits, scoring
from lexitide.operators import norms as N
from lexitide.operators import records as R
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded, t_p_sql
from lexitide.runtime import table


@query("SELECT o_orderdate, o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def columns_by_prefix(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(*R.known(o, *R.columns_with(o, "o_order")))


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1990 + o_custkey % 7 AND year(o_orderdate) <= 1993 + o_custkey % 9")
def in_lifetime(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), (1990 + F.col("o_custkey") % 7).alias("born"), F.when(F.col("o_custkey") > 0, 1993 + F.col("o_custkey") % 9).alias("died"))
    return aggregate.in_lifetime(o).select("o_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang END AS lang FROM documents) WHERE lang IS NULL OR lang = 'fr'")
def language_confirmed_or_unknown(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    return d.where(R.confirmed_or_unknown(F.col("lang"), "fr")).select("doc_id")


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'male' WHEN 3 THEN 'female' END AS gender FROM customer")
def gender_labels(spark, sf):
    forms = F.array(*map(F.lit, ("Male.", "f", "MAN", "Woman", "n/a")))
    c = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.element_at(forms, (F.col("c_custkey") % 5 + 1).cast("int")).alias("gender"))).alias("meta"))
    return c.select("c_custkey", bins.gender(F.col("meta")).alias("gender"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 END AS place FROM orders")
def ordinal_labels(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", R.ordinal(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("place"))


@query(
    "WITH n AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS c, count(*) FILTER (l_returnflag = 'N') AS n, count(*) AS t FROM lineitem GROUP BY 1) "
    "SELECT l_suppkey, round(least(a / nullif(c, 0), 1.2), 6) AS ratio, greatest(a - c, -5.0) AS diff, c - a + 0.0 AS against, a + c + 0.0 AS both, round(100 * a / t, 6) AS abs, round(100 * c / t, 6) AS conc, round(100 * n / t, 6) AS neither, round(CASE WHEN c > 0 THEN a / c END, 6) AS safe, round(CASE WHEN (a - c) * (c - n) > 0 THEN (a - c) / (c - n) END, 6) AS same_sign FROM n"
)
def plotted_values(spark, sf):
    n = lambda flag, name: F.count_if(F.col("l_returnflag") == flag).alias(name)
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(n("A", "num_abs"), n("R", "num_conc"), n("N", "num_neither"), F.count("*").alias("num_total"))
    value = R.plotted_value
    a, b, d = F.col("num_abs"), F.col("num_conc"), F.col("num_neither")
    return rounded(
        c.select("l_suppkey", value("abs/conc", high=1.2).alias("ratio"), value("abs-conc", low=-5).alias("diff"), value("conc-abs").alias("against"), value("abs+conc").alias("both"), *(value(k).alias(k) for k in ("abs", "conc", "neither")), bins.safe_ratio(a, b).alias("safe"), bins.same_sign_ratio(a - b, b - d).alias("same_sign"))
    )


@query("SELECT p_partkey, CASE WHEN p_size % 5 < 3 AND p_size % 3 < 2 AND p_size % 4 > 0 THEN 'scene' WHEN p_size % 5 = 3 AND p_size % 3 = 2 AND p_size % 4 = 0 THEN 'commentary' ELSE 'other' END AS mode FROM part")
def discourse_modes(spark, sf):
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_size") % k + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", R.discourse_mode(pick(5, "1m", "10m", "100m", "none", "1km"), pick(3, "minutes", "hours", "moment"), pick(4, "generic", "typed", "named", "fully_described")).alias("mode"))


_NAMES = ("The Old Man", "Miller's Wife", "Mr. Brown", "Cassandra Vale", "Tom Stone", "", "his friend", "Clarinda")


@query("SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'type' WHEN 1 THEN 'type' WHEN 2 THEN 'realistic' WHEN 3 THEN 'classical' WHEN 4 THEN 'other' WHEN 5 THEN 'unknown' WHEN 6 THEN 'other' ELSE 'classical' END AS name_class, c_custkey % 8 IN (1, 2, 3, 4, 7) AND c_custkey % 3 > 0 AS named FROM customer")
def name_classes(spark, sf):
    own = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("c_custkey") % 8 + 1).cast("int"))
    c = table(spark, sf, "customer").select("c_custkey", own.alias("name"), F.when(F.col("c_custkey") % 3 > 0, "character").otherwise("collective").alias("kind"))
    out = R.classified_names(c, "name", spark.createDataFrame([("Brown",), ("green",)], "word string"))
    return out.select("c_custkey", "name_class", R.named_character(F.col("kind"), F.col("name")).alias("named"))


@query(
    "SELECT p_partkey, regexp_replace(p_type, '^[A-Z]+ ', '') AS label FROM part WHERE regexp_matches(p_type, 'tin|copper', 'i') "
    "UNION ALL SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'ring|red', 'i')"
)
def labels_matching(spark, sf):
    """Labels of the types, without the first word in capitals, and of the names."""
    p = table(spark, sf, "part")
    types = p.where(R.matching(F.col("p_type"), "tin", "copper")).select("p_partkey", F.regexp_replace("p_type", "^[A-Z]+ ", "").alias("label"))
    return types.unionAll(p.where(R.matching(F.col("p_name"), "Ring", "RED")).select("p_partkey", F.col("p_name").alias("label")))


def _texts(spark, sf):
    return table(spark, sf, "documents").select(T.text_id(F.col("source"), F.col("doc_id")).alias("_id"), "doc_id", "source", "lang")


_TX = "tx AS (SELECT '_' || source || '/' || doc_id AS _id, doc_id, source, lang FROM documents)"


@query(f"WITH {_TX} SELECT _id, source AS corpus, CASE WHEN doc_id % 3 > 0 THEN lang END AS lang FROM tx")
def metadata_with_fallback(spark, sf):
    t = _texts(spark, sf)
    meta = t.where("doc_id % 3 > 0").select("_id", F.when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise("").alias("corpus"), "lang")
    return R.with_metadata(t.select("_id", "source"), meta).select("_id", "corpus", "lang")


_TAGS = "tags AS (SELECT _id, 'even' AS tag FROM tx WHERE doc_id % 2 = 0 UNION ALL SELECT _id, 'five' FROM tx WHERE doc_id % 5 = 0)"


def _tagged(spark, sf):
    t = _texts(spark, sf)
    tags = t.where("doc_id % 2 = 0").select("_id", F.lit("even").alias("tag")).unionAll(t.where("doc_id % 5 = 0").select("_id", F.lit("five").alias("tag")))
    return R.with_tags(t.select("_id", (F.col("doc_id") * 1.0).alias("score")), t.select("_id", "lang"), tags)


@query(f"WITH {_TX}, {_TAGS} SELECT tx._id, lang, CAST(doc_id AS DOUBLE) AS score, coalesce(tag, '(untagged)') AS tag FROM tx LEFT JOIN tags ON tx._id = tags._id")
def scores_with_tags(spark, sf):
    return _tagged(spark, sf).select("_id", "lang", "score", "tag")


@query(f"WITH {_TX}, {_TAGS} SELECT tx._id, array_to_string(list_sort(list(DISTINCT coalesce(tag, '(untagged)'))), ',') AS tags, min(lang) AS lang FROM tx LEFT JOIN tags ON tx._id = tags._id GROUP BY 1")
def tags_by_text(spark, sf):
    return R.tag_arrays(_tagged(spark, sf), ["_id"], "lang").withColumn("tags", F.array_join("tags", ","))


@query(
    f"WITH {_TX}, {S.GROUPS}, f AS (SELECT g.group_id, arg_min(CASE doc_id % 3 WHEN 0 THEN 'Epistolary' ELSE 'First-person' END, tx._id) AS form FROM tx JOIN groups g ON g._id = tx._id WHERE doc_id % 2 = 0 AND doc_id % 7 > 0 GROUP BY 1) "
    "SELECT tx._id, coalesce(form, '(unknown)') AS form FROM tx LEFT JOIN groups g ON g._id = tx._id LEFT JOIN f ON f.group_id = g.group_id"
)
def narrative_forms(spark, sf):
    t = _texts(spark, sf)
    form = F.when(F.col("doc_id") % 7 == 0, " | x").when(F.col("doc_id") % 3 == 0, "Epistolary | Other").otherwise("First-person")
    described = t.where("doc_id % 2 = 0").select("_id", F.to_json(F.struct(form.alias("narrative_form"))).alias("meta"))
    return R.narrative_forms(t, S.groups(spark, sf), described)


@query(
    "SELECT conv_id AS _id, turn AS seq, role, CASE WHEN turn % 2 = 0 THEN conv_id END AS score, embedding IS NOT NULL AS vector FROM conversations JOIN (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id % 3 > 0) ON c = conv_id JOIN embeddings ON vec_id = conv_id WHERE turn < 3"
)
def passages_with_all(spark, sf):
    f = table(spark, sf, "conversations").select(F.col("conv_id").alias("_id"), F.col("turn").alias("seq"), "role")
    texts = f.select("_id").distinct().where("_id % 3 > 0")
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_id"), F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("seq"), F.col("embedding").isNotNull().alias("vector"))
    scores = f.where("seq % 2 = 0").select("_id", "seq", F.col("_id").alias("score"))
    return R.passages_with_all(f, texts, scores, vectors).select("_id", "seq", "role", "score", "vector")


@query("WITH p AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS d FROM lineitem GROUP BY ALL) SELECT e.event_id, d FROM events e LEFT JOIN p ON p.l_orderkey = e.user_id AND p.l_linenumber = 1")
def labels_with_passages(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("user_id"), F.col("l_linenumber").alias("seq"), F.col("l_shipdate").alias("d"))
    e = table(spark, sf, "events").select("event_id", "user_id", F.lit(1).alias("seq"))
    return R.labels_with_passages(e, li.unionAll(li), ["user_id", "seq"]).select("event_id", "d")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def deleted_by_join(spark, sf):
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return R.without_members(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey")


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_with, round(100.0 * count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) / count(*), 1) AS pct FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) >= 3")
def json_member_shares(spark, sf):
    field = F.to_json(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.array(F.lit("x"), F.lit("ghost"))).otherwise(F.array(F.lit("x"))))
    return R.member_shares(table(spark, sf, "orders").select("o_custkey", field.alias("f")), ["o_custkey"], "f", "ghost", 3)


@query(
    "WITH v AS (SELECT l_suppkey, CASE l_shipmode WHEN 0 THEN 'land' WHEN 1 THEN 'land' WHEN 2 THEN 'air' END AS bucket FROM (SELECT l_suppkey, l_linenumber % 4 AS l_shipmode FROM lineitem)), n AS (SELECT l_suppkey, bucket, count(*) AS n FROM v WHERE bucket IS NOT NULL GROUP BY 1, 2) SELECT l_suppkey, bucket, round(100 * n / sum(n) OVER (PARTITION BY l_suppkey), 1) AS pct FROM n"
)
def bucket_shares(spark, sf):
    mode = F.element_at(F.array(*map(F.lit, (" Rail", "TRUCK ", "Plane", "unheard of"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    taxonomy = spark.createDataFrame([("rail", "land"), ("truck", "land"), ("plane", "air"), ("ship", "water")], "value string, bucket string")
    return R.bucket_shares(table(spark, sf, "lineitem").select("l_suppkey", mode.alias("mode")), ["l_suppkey"], "mode", taxonomy)


@query("SELECT l_suppkey, round(avg(l_discount), 6) AS mean, count(l_discount) AS n, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) AS mean_A, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) AS mean_R FROM lineitem GROUP BY 1")
def role_means(spark, sf):
    return rounded(R.role_means(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", "l_discount", ["A", "R"]))


@query("WITH m AS (SELECT l_suppkey, l_orderkey, avg(l_quantity) AS m, sum(l_quantity) AS s FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(avg(m), 6) AS mean, sum(s) AS total, count(*) AS n FROM m GROUP BY 1")
def means_of_means(spark, sf):
    return rounded(R.means_of_means(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_orderkey"], "l_quantity"))


@query(
    f"WITH {S.NORMS} SELECT _id, count(*) FILTER (z_quality <= -1) AS n_abs, count(*) FILTER (z_quality >= 1) AS n_conc, count(DISTINCT word) FILTER (z_quality <= -1) AS words_abs, count(DISTINCT word) FILTER (z_quality >= 1) AS words_conc, round(count(*) FILTER (z_quality <= -1) / nullif(count(*) FILTER (z_quality >= 1), 0), 6) AS ratio FROM freqs JOIN norms USING (lang, word) GROUP BY 1"
)
def band_summary(spark, sf):
    counts, norms = S.both(spark, sf, S.norms)
    return rounded(R.band_summary(scoring.looked_up(counts, norms, ["lang", "word"]), ["_id"], "word", "z_quality"))


@query(f"WITH {S.RATED}, c AS (SELECT lang, corpus, word, sum(cnt) AS cnt FROM freqs GROUP BY ALL), j AS (SELECT c.*, r.word IS NOT NULL AS k FROM c LEFT JOIN (SELECT DISTINCT word FROM rated) r ON r.word = c.word) SELECT corpus, count(*) FILTER (k) AS kinds, count(*) AS all_kinds, round(coalesce(sum(cnt) FILTER (k), 0) / sum(cnt), 6) AS token_share FROM j GROUP BY 1")
def vocabulary_coverage(spark, sf):
    counts = S.freqs(spark, sf, "corpus", "lang")
    return rounded(R.vocabulary_coverage(S.rated(spark, sf), counts, ["corpus"]))


@query("WITH n AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT s, string_agg(p || ' (' || n || ')', ', ' ORDER BY n DESC, p) AS caption FROM n GROUP BY 1")
def captions(spark, sf):
    return R.caption(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("s"), "o_orderpriority"), "s", "o_orderpriority")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 AS is_first FROM orders")
def first_appearances(spark, sf):
    return R.first_appearances(table(spark, sf, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "is_first")


@query(f"WITH {S.ORDERS}, m AS (SELECT segment, year, avg(price) AS m, count(*) AS n FROM o GROUP BY ALL) SELECT segment, arg_max(year, m) AS highest, arg_min(year, m) AS lowest FROM m GROUP BY 1")
def extreme_years(spark, sf):
    return R.extreme_places(S.orders(spark, sf).groupBy("segment", "year").agg(F.avg("price").alias("m")), ["segment"], "year", "m")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_by_author FROM orders")
def author_counts(spark, sf):
    return R.with_counts(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "n_by_author").select("o_orderkey", "n_by_author")


@query(f"WITH {S.ORDERS}, m AS (SELECT segment, year, round(avg(price), 4) AS m FROM o GROUP BY ALL), a AS (SELECT segment, arg_min(m, year) AS anchor FROM m GROUP BY 1) SELECT segment, anchor, row_number() OVER (ORDER BY anchor, segment) AS position FROM a")
def ordered_by_anchor(spark, sf):
    out = R.ordered_by_anchor(S.orders(spark, sf).groupBy("segment", "year").agg(F.round(F.avg("price"), 4).alias("m")), "segment", "year", "m")
    return out.withColumn("position", F.col("position").cast("long"))


@query("SELECT event_id FROM events ORDER BY md5(event_id || '|5'), event_id LIMIT 200")
def exact_sample(spark, sf):
    return R.exact_sample(table(spark, sf, "events").select("event_id"), "event_id", 200, 5)


_OF = r"'(?m)(^|[ \n])([^\p{L}\p{N} \n]*)of([^\p{L}\p{N} \n]*)($|[ \n])', '\1\2o''\3\4', 'g'"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(text, {_OF}), {_OF}) AS text FROM documents")  # twice: neighbours share the space between them
def spelling_by_line(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = R.respelled(d, ["doc_id"], "text", spark.createDataFrame([("of", "o'")], "word string, modern string"))
    return out.select("doc_id", "text")


@query("SELECT doc_id, len(regexp_split_to_array(text, '\\n\\s*\\n')) AS n_paragraphs, TRY_CAST(nullif(regexp_extract(text, '(\\d{4})', 1), '') AS INTEGER) AS year, 'd' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS padded, regexp_replace(lower(source), '[^a-z]', '', 'g') AS letters, source AS last FROM documents")
def text_helpers(spark, sf):
    d = table(spark, sf, "documents")
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return d.select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n_paragraphs"), T.year_in(F.col("text")).alias("year"), T.padded_id(key).alias("padded"), T.letters_only_lower(F.col("source")).alias("letters"), T.last_segments(F.concat(F.lit("a/b/"), "source"), 1).alias("last"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(lower(replace(replace(text, '&amp;', '&'), '’', '''')), '{S.TOKENS}'), '¦') AS tokens FROM documents")
def normal_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.normal_tokens(F.col("text")), "¦").alias("tokens"))


@query("WITH r AS (SELECT l_suppkey % 3 AS corpus, l_linenumber AS run, l_partkey % 50 AS word, l_discount AS z FROM lineitem), a AS (SELECT corpus, word, median(z) AS z FROM r GROUP BY ALL) SELECT word, round(median(z), 6) AS z FROM a GROUP BY 1")
def medians_over_runs(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("corpus"), F.lit("p").alias("period"), F.lit("c").alias("contrast"), (F.col("l_partkey") % 50).alias("word"), F.col("l_discount").alias("z"))
    return rounded(embeddings.over_runs(li).select("word", "z"))


@query("WITH v AS (SELECT l_linestatus AS lang, l_partkey AS word, l_returnflag AS source, median(l_discount) AS value FROM lineitem GROUP BY ALL) SELECT lang, word, source, round(value, 6) AS value, round((value - avg(value) OVER (PARTITION BY lang, source)) / nullif(stddev_pop(value) OVER (PARTITION BY lang, source), 0), 6) AS z FROM v")
def rated_by_source(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("lang"), F.col("l_partkey").alias("word"), F.col("l_returnflag").alias("source"), "l_discount")
    return rounded(N.rate(li, ["lang"], "source", "l_discount"))


@query(
    "WITH a AS (SELECT l_linenumber AS k, count(*) FILTER (l_linestatus = 'F') AS na, count(*) FILTER (l_linestatus = 'O') AS nb, avg(l_discount) FILTER (l_linestatus = 'F') AS ma, avg(l_discount) FILTER (l_linestatus = 'O') AS mb, var_samp(l_discount) FILTER (l_linestatus = 'F') AS va, var_samp(l_discount) FILTER (l_linestatus = 'O') AS vb FROM lineitem GROUP BY 1)"
    ", w AS (SELECT k, ma - mb AS diff, (ma - mb) / sqrt(va / na + vb / nb) AS t, (va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) AS dof FROM a) "
    f"SELECT k AS l_linenumber, round(diff, 6) AS diff, round(t, 5) AS t, round(dof, 3) AS dof, round({t_p_sql('t', 'dof')}, 7) AS p FROM w"
)
def welch_statistics(spark, sf):
    out = fits.welch(table(spark, sf, "lineitem"), ["l_linenumber"], "l_linestatus", "l_discount", "F", "O")
    return out.select("l_linenumber", F.round("diff", 6).alias("diff"), F.round("t", 5).alias("t"), F.round("dof", 3).alias("dof"), F.round("p", 7).alias("p"))


@query("WITH p AS (SELECT p_partkey, (p_partkey * 7919 % 1000 + 1) / 1001.0 AS p FROM part), r AS (SELECT p_partkey, p, p * count(*) OVER () / (count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM p) SELECT p_partkey, round(least(1.0, min(q) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS p_adjusted FROM r")
def adjusted_p_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001.0).alias("p"))
    return fits.adjusted_p(p).select("p_partkey", F.round("p_adjusted", 8).alias("p_adjusted"))


_OLS = "x AS (SELECT l_extendedprice AS y, l_quantity AS x, l_suppkey AS g FROM lineitem)"


@query(
    f"WITH {_OLS}, m AS (SELECT y, x - avg(x) OVER (PARTITION BY g) AS dx, y - avg(y) OVER (PARTITION BY g) AS dy FROM x), s AS (SELECT sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, count(*) AS n, var_pop(y) * count(*) AS sst FROM m), d AS (SELECT *, n - 1 - (SELECT count(DISTINCT g) FROM x) AS dof, yy - xy * xy / xx AS sse FROM s) "
    "SELECT 'l_quantity' AS term, round(xy / xx, 3) AS beta, round(sqrt(sse / dof / xx), 4) AS se, round(xy / xx / sqrt(sse / dof / xx), 2) AS t, n, round(1 - sse / sst, 6) AS r2, round(1 - (sse / sst) * (n - 1) / dof, 6) AS adjusted_r2 FROM d"
)
def regression_with_effects(spark, sf):
    out = fits.least_squares(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], "l_suppkey")
    return out.select("term", F.round("beta", 3).alias("beta"), F.round("se", 4).alias("se"), F.round("t", 2).alias("t"), "n", F.round("r2", 6).alias("r2"), F.round("adjusted_r2", 6).alias("adjusted_r2"))


@query(
    "WITH s AS (SELECT covar_samp(l_extendedprice, l_quantity) AS y1, covar_samp(l_extendedprice, l_discount) AS y2, covar_samp(l_quantity, l_discount) AS x12, var_samp(l_quantity) AS v1, var_samp(l_discount) AS v2, count(*) AS n FROM lineitem) "
    "SELECT 'l_quantity' AS term, round((y1 * v2 - y2 * x12) / (v1 * v2 - x12 * x12), 2) AS beta, n FROM s UNION ALL SELECT 'l_discount', round((y2 * v1 - y1 * x12) / (v1 * v2 - x12 * x12), 2), n FROM s"
)
def regression_of_two(spark, sf):
    out = fits.least_squares(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return out.select("term", F.round("beta", 2).alias("beta"), "n")


@query(
    "WITH r AS (SELECT l_partkey AS g, l_returnflag AS c, avg(l_discount + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0 END) AS s FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY ALL), k AS (SELECT g, avg(s) FILTER (c = 'R') - avg(s) FILTER (c = 'N') AS d FROM r GROUP BY g HAVING count(*) = 2) "
    "SELECT 'N' AS corpus, 0.0 AS coef, count(*) AS n FROM k UNION ALL SELECT 'R', round(avg(d), 6), count(*) FROM k"
)
def bias_of_two(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag in ('N', 'R')")
    rows = li.select(F.col("l_partkey").alias("group_id"), F.col("l_returnflag").alias("corpus"), (F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 0.1).otherwise(0.0)).alias("score"))
    return rounded(correction.corpus_bias(rows, "N").select("corpus", "coef", "n"))


def _adjusted(spark, sf, **how):
    points = aggregate.bin_means(S.scores(spark, sf), "score", 25, ["genre", "corpus"])
    return rounded(fits.adjusted(points.withColumn("all", F.lit("all")), ["all"], ["corpus", "genre"], **how))


@query()
def adjusted_by_two_effects(spark, sf):
    return _adjusted(spark, sf, degree=2)


@query()
def adjusted_piecewise(spark, sf):
    return _adjusted(spark, sf, grid=fits.GRID)


@query()
def arcs_by_corpus_and_over_all(spark, sf):
    scores = S.scores(spark, sf)
    each = fits.piecewise(aggregate.bin_means(scores, "score", 10, ["corpus"]), ["corpus"])
    whole = aggregate.bin_means(scores, "score", 10).withColumn("corpus", F.lit("(all)"))
    return rounded(each.unionByName(fits.piecewise(whole, ["corpus"])))


@query()
def passage_html(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    norms = S.norms(spark, sf).where("lang = 'en'").select("word", F.col("z_quality").alias("z"))
    return R.rendered(d, ["conv_id", "turn"], "text", norms)


@query()
def marked_passages(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return R.marked_passages(counting.token_rows(d, ["conv_id", "turn"]), ["conv_id", "turn"], S.contrasts(spark, sf))


def _replies(spark, sf):
    c = table(spark, sf, "conversations")
    one = F.struct(F.col("role").alias("name"), F.col("text").alias("description"), F.lit(None).cast("string").alias("quote"), F.when(F.col("turn") % 2 == 0, "said").otherwise("thought").alias("mode"))
    own = F.struct(F.concat(F.lit("s_"), F.col("turn").cast("string")).alias("id"), (F.col("turn") / 2).alias("concabs"), F.lit("n").alias("narrative_mode"), F.array(F.lit("a"), F.lit("b")).alias("key_abstractions"), F.array(one, one).alias("character_descriptions"))
    replies = c.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(own))).alias("reply"))
    return R.slice_rows(replies.withColumn("reply", F.concat(F.lit("Here it is:\n```json\n"), "reply", F.lit("\n```"))), ["conv_id"])


@query("SELECT conv_id, CAST(turn AS INTEGER) AS slice_num, turn / 2 AS concabs, 'n' AS narrative_mode, 2 AS n_abstractions, 0 AS n_concretions, 2 AS n_characters FROM conversations")
def nested_slices(spark, sf):
    return _replies(spark, sf).drop("slice_id", "characters")


@query("SELECT conv_id, CAST(turn AS INTEGER) AS slice_num, role AS name, CASE WHEN turn % 2 = 0 THEN 'said' ELSE 'thought' END AS modes FROM conversations, range(2)")
def nested_characters(spark, sf):
    return R.character_rows(_replies(spark, sf), ["conv_id"]).select("conv_id", "slice_num", "name", F.array_join("modes", ",").alias("modes"))
