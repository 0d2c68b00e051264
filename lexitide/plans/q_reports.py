"""Queries on reports: arcs, tags, trends in order, means by author, listings, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators import decompose, graphs, joins, reports, scoring, words
from lexitide.operators import records as R
from lexitide.operators.norms import with_zscores
from lexitide.plans import q_arcs, q_scoring
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded
from lexitide.runtime import table


def _scores(spark, sf):
    """Languages stand for corpora: each has texts in most periods."""
    return S.scores(spark, sf).withColumn("corpus", F.col("lang"))


@query()
def arc_report(spark, sf):
    return rounded(reports.arcs(_scores(spark, sf), 25, 1))


@query()
def arc_report_in_words(spark, sf):
    return reports.sentence(reports.arcs(_scores(spark, sf), 25, 1))


@query()
def arc_printed(spark, sf):
    return rounded(reports.printed(reports.balanced(_scores(spark, sf), 25, 1)))


_TAGS = "tags AS (SELECT o_orderkey AS _id, 'form' AS facet, ['novel', 'tale', 'play'][o_orderkey % 3 + 1] AS tag FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'form', 'tale' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'mode', CASE WHEN o_custkey % 2 = 0 THEN 'comic' ELSE 'tale' END FROM orders WHERE o_orderkey % 7 > 1)"


@query(
    f"WITH {S.ORDERS}, {_TAGS}, u AS (SELECT DISTINCT * FROM tags UNION SELECT _id, 'flat', tag FROM tags), tall AS (SELECT year, price, f.facet, coalesce(tag, '(untagged)') AS label FROM o CROSS JOIN (SELECT unnest(['form', 'mode', 'flat']) AS facet) f LEFT JOIN u ON u._id = o_orderkey AND u.facet = f.facet), "
    f"{q_arcs._shift_sql('label', 'facet', 'tall')} SELECT facet, category, {q_arcs._OUT} FROM rows"
)
def shift_share_tags(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    form = o.where(k % 4 > 0).select(k.alias("_id"), F.lit("form").alias("facet"), F.element_at(F.array(*map(F.lit, ("novel", "tale", "play"))), (k % 3 + 1).cast("int")).alias("tag"))
    more = o.where(k % 5 == 0).select(k.alias("_id"), F.lit("form").alias("facet"), F.lit("tale").alias("tag"))
    mode = o.where(k % 7 > 1).select(k.alias("_id"), F.lit("mode").alias("facet"), F.when(F.col("o_custkey") % 2 == 0, "comic").otherwise("tale").alias("tag"))
    scores = S.orders(spark, sf).withColumn("_id", F.col("o_orderkey"))
    return q_arcs._two(reports.by_tags(scores, form.unionAll(more).unionAll(mode), ["form", "mode", "flat"], "price", q_arcs._when()), "facet", "category")


@query(
    f"WITH {S.ORDERS}, c0 AS (SELECT CASE WHEN year = 1995 THEN 'only early' WHEN year = 2001 THEN 'only late' ELSE segment END AS category, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'early' ELSE 'late' END AS p, price AS v FROM o), "
    "a AS (SELECT avg(v) FILTER (p = 'early') AS ae, avg(v) FILTER (p = 'late') AS al, count(*) FILTER (p = 'early') AS te, count(*) FILTER (p = 'late') AS tl FROM c0), "
    "c AS (SELECT category, count(*) FILTER (p = 'early') AS ne, count(*) FILTER (p = 'late') AS nl, avg(v) FILTER (p = 'early') AS me, avg(v) FILTER (p = 'late') AS ml FROM c0 GROUP BY 1), "
    "s AS (SELECT category, ne / te AS se, nl / tl AS sl, coalesce(me, ae) AS me, coalesce(ml, al) AS ml FROM c, a) SELECT category, round((sl - se) * me, 2) AS composition, round(se * (ml - me), 2) AS within, round((sl - se) * (ml - me), 2) AS interaction FROM s"
)
def shift_share_missing_overall(spark, sf):
    """Categories that a period lacks take its overall mean."""
    year = F.col("year")
    o = S.orders(spark, sf).withColumn("category", F.when(year == 1995, "only early").when(year == 2001, "only late").otherwise(F.col("segment")))
    out = decompose.shift_share(o, "category", "price", F.when(year <= 1997, "early").otherwise("late"), missing="overall")
    return out.select("category", *(F.round(c, 2).alias(c) for c in ("composition", "within", "interaction")))


@query(
    f"WITH {q_arcs.SHARES}, s AS (SELECT decade, sum(p * z) AS score FROM shares GROUP BY decade), t AS (SELECT word, z, round(corr(p, score), 4) AS r FROM shares JOIN s USING (decade) GROUP BY word, z) "
    "SELECT word, r, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 5) AS r_z, CASE WHEN z <= -1 THEN 'Abstract' WHEN z >= 1 THEN 'Concrete' ELSE 'Neither' END AS category FROM t"
)
def trend_table(spark, sf):
    t = words.trends(q_arcs._shares(spark, sf)).withColumn("r", F.round("r", 4))
    return reports.trend_table(t).select("word", "r", F.round("r_z", 5).alias("r_z"), "category")


@query("SELECT o_custkey, row_number() OVER (ORDER BY cents DESC, o_custkey) AS place FROM (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)")
def customers_in_order(spark, sf):
    """Places of all customers by their sum, largest first, without one task for all."""
    from lexitide.operators.order import places

    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return places(sums, [], ["cents", "o_custkey"], ("cents",)).select("o_custkey", F.col("__last").alias("place"))


@query("SELECT CASE WHEN c_custkey % 6 = 0 THEN 'Unknown' ELSE c_mktsegment END AS segment, 'n' || c_nationkey AS author, round(avg(c_acctbal), 6) AS c_acctbal, round(avg(c_custkey), 6) AS c_custkey FROM customer GROUP BY 1, 2")
def author_means(spark, sf):
    c = table(spark, sf, "customer")
    own = c.select(F.when(F.col("c_custkey") % 6 != 0, F.col("c_mktsegment")).otherwise(F.when(F.col("c_custkey") % 12 == 0, " ")).alias("segment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("author"), "c_acctbal", "c_custkey")
    return rounded(reports.author_means(own, ["segment", "author"]))


@query("SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def listings(spark, sf):
    return reports.listing(table(spark, sf, "documents"), ["lang", "source"])


@query("WITH c AS (SELECT l_suppkey, greatest(count(*) FILTER (l_returnflag = 'A') - count(*) FILTER (l_returnflag = 'R'), -5) AS v FROM lineitem GROUP BY 1) SELECT l_suppkey, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS z FROM c")
def plotted_values_standardised(spark, sf):
    n = lambda flag, name: F.count_if(F.col("l_returnflag") == flag).alias(name)
    c = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(n("A", "num_abs"), n("R", "num_conc"), n("N", "num_neither"), F.count("*").alias("num_total"))
    return rounded(with_zscores(c.select("l_suppkey", R.plotted_value("abs-conc", low=-5).alias("v")), [], {"z": "v"}).select("l_suppkey", "z"))


@query(
    "WITH e AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS graph, least(s_nationkey, c_nationkey) AS a, greatest(s_nationkey, c_nationkey) AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey), "
    "x AS (SELECT graph, a, b FROM e UNION ALL SELECT graph, b, a FROM e), d AS (SELECT graph, a, count(*) AS d FROM x GROUP BY ALL), "
    "t AS (SELECT p.graph, p.a, count(*) AS t FROM x p JOIN x q ON p.graph = q.graph AND p.a = q.a AND p.b < q.b JOIN e ON e.graph = p.graph AND e.a = p.b AND e.b = q.b GROUP BY ALL) "
    "SELECT graph, count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, round(avg(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS clustering FROM d LEFT JOIN t USING (graph, a) GROUP BY graph"
)
def graph_clustering(spark, sf):
    """Nations that trade in a month: graphs with triangles."""
    li, s, o, c = (table(spark, sf, t) for t in ("lineitem", "supplier", "orders", "customer"))
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    edges = rows.select(F.date_format("l_shipdate", "yyyy-MM").alias("graph"), F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
    return rounded(graphs.statistics(edges, "graph", diameters=False).select("graph", "nodes", "edges", "clustering"))


@query("SELECT doc_id, '_' || source || '/' || CASE WHEN source = 'src1' THEN CASE WHEN length(CAST(doc_id AS VARCHAR)) < 8 THEN lpad(CAST(doc_id AS VARCHAR), 8, '0') ELSE CAST(doc_id AS VARCHAR) END WHEN source = 'src2' THEN replace('d ' || doc_id, ' ', '_') ELSE 'd ' || doc_id END AS _id FROM documents")
def corpus_ids(spark, sf):
    d = table(spark, sf, "documents")
    key = F.when(F.col("source") == "src1", F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("d "), F.col("doc_id").cast("string")))
    return d.select("doc_id", T.corpus_id(F.col("source"), key, {"src1": 8}, ["src2"]).alias("_id"))


@query("WITH m AS (SELECT l_partkey AS k, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS matches FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) SELECT p_partkey, coalesce(matches, '') AS matches FROM part LEFT JOIN m ON k = p_partkey")
def bibliography_matches(spark, sf):
    """Parts as 'P12', lines as 'P000012': matched by the padded key, one to many."""
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    li = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.format_string("P%06d", "l_partkey").alias("id"), "l_orderkey")
    out = joins.bibliography(p, li, T.padded_id(F.col("id")), F.col("id"), "l_orderkey")
    return out.select("p_partkey", F.coalesce(F.array_join(F.transform("matches", lambda x: x.cast("string")), ","), F.lit("")).alias("matches"))


@query(f"WITH {S.NORMS}, s AS (SELECT _id, {', '.join(f'round(sum(cnt * {c}) / sum(cnt) FILTER ({c} IS NOT NULL), 6) AS {c}' for c in ('z_quality', 'z_toxic'))} FROM freqs JOIN norms USING (lang, word) GROUP BY _id) SELECT _id, 'z_quality' AS name, z_quality AS score FROM s WHERE z_quality IS NOT NULL UNION ALL SELECT _id, 'z_toxic', z_toxic FROM s WHERE z_toxic IS NOT NULL")
def score_maps(spark, sf):
    counts, norms = S.both(spark, sf, S.norms)
    maps = scoring.score_maps(scoring.weighted_means(counts, norms, ["lang", "word"], ["_id"], ["z_quality", "z_toxic"]), ["_id"], ["z_quality", "z_toxic"])
    return rounded(maps.select("_id", F.explode("scores").alias("name", "score")))


@query(
    f"WITH w AS ({q_scoring.counting_windows_sql}) SELECT '_' || source || '/' || d.doc_id AS _id, slice, CASE WHEN d.doc_id % 3 = 0 THEN 'xx' ELSE d.lang END AS lang, CAST(1500 + (d.doc_id * 7919) % 500 AS INTEGER) AS year, num_total FROM w JOIN documents d ON d.doc_id = w.doc_id"
)
def passages_with_texts(spark, sf):
    """Passages joined to their texts, with the detected language where there is one."""
    w = q_scoring.counting_windows(spark, sf)
    detected = table(spark, sf, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang_detected"))
    out = w.join(S.texts(spark, sf), "doc_id").join(detected, "doc_id", "left")
    return out.select("_id", "slice", F.coalesce("lang_detected", "lang").alias("lang"), "year", "num_total")


@query()
def passages_compared(spark, sf):
    """The first turns of a conversation side by side, words looked up in another spelling."""
    d = table(spark, sf, "conversations").where("turn < 2").select("conv_id", "turn", "text")
    norms = S.norms(spark, sf).where("lang = 'en'").select("word", F.col("z_quality").alias("z"))
    spelling = norms.select(F.concat("word", F.lit("e")).alias("word"), F.col("word").alias("modern"))
    html = R.rendered(d, ["conv_id", "turn"], "text", norms, spelling, keep_lines=True)
    return R.side_by_side(html.withColumn("title", F.concat(F.lit("Turn "), F.col("turn").cast("string"))), ["conv_id"], "turn", "title")
