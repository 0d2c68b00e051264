"""Queries on joins, windows, ranks, cross-tables, graphs and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import bins
from lexitide.functions import text as T
from lexitide.functions.numeric import correlation
from lexitide.operators import embeddings, graphs, joins, order, shape
from lexitide.operators import norms as N
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded
from lexitide.runtime import table
from lexitide.streaming.passages import event_windows


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 END AS rewrite, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN source END AS found FROM documents")
def join_cascade(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    plain, dotted = F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), F.concat("source", F.lit("."), F.col("doc_id").cast("string"))
    right = d.where("doc_id % 2 = 0").select(plain.alias("key"), F.col("source").alias("found")).unionByName(d.where("doc_id % 3 = 0").select(dotted.alias("key"), F.col("source").alias("found")))
    left = d.select("doc_id", plain.alias("key"))
    return joins.cascade_join(left, right, "key", [F.col("key"), T.slash_to_dot(F.col("key"))]).select("doc_id", "rewrite", "found")


@query("SELECT 0 AS rewrite, count(*) FILTER (doc_id % 2 = 0) AS n, round(count(*) FILTER (doc_id % 2 = 0) / count(*), 6) AS share FROM documents UNION ALL SELECT 1, count(*) FILTER (doc_id % 3 = 0), round(count(*) FILTER (doc_id % 3 = 0) / count(*), 6) FROM documents")
def join_coverage(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"))
    right = d.where("doc_id % 2 = 0").select("key").unionAll(d.where("doc_id % 3 = 0").select(T.slash_to_dot(F.col("key")).alias("key")))
    return rounded(joins.best_rewrite(d, right, "key", [F.col("key"), T.slash_to_dot(F.col("key"))]))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' WHEN doc_id % 5 = 0 THEN 'five' END AS tag FROM documents")
def join_first_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("e"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("k1"), F.concat(F.lit("f"), F.pmod("doc_id", F.lit(5)).cast("string")).alias("k2"))
    right = spark.createDataFrame([("e0", "even"), ("f0", "five")], "k string, tag string")
    return joins.first_key_match(d, right, ["k1", "k2"], "k", "tag").select("doc_id", "tag")


RANGES = "r AS (SELECT user_id, event_id AS range_id, CAST(floor(value) AS BIGINT) AS lo, CAST(floor(value) AS BIGINT) + 5 AS hi FROM events)"


@query(f"WITH {RANGES} SELECT e.event_id, r.range_id FROM events e JOIN r ON e.user_id = r.user_id AND CAST(floor(e.value) AS BIGINT) BETWEEN lo AND hi")
def join_ranges(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.floor("value"))
    r = e.select("user_id", F.col("event_id").alias("range_id"), F.col("at").alias("lo"), (F.col("at") + 5).alias("hi"))
    return joins.within_ranges(e.select("user_id", "event_id", "at"), r, ["user_id"], "at", "lo", "hi").select("event_id", "range_id")


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def join_with_default(spark, sf):
    right = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.with_default(table(spark, sf, "customer").select("c_custkey"), right, "c_custkey", {"o_orderkey": -1})


@query(f"WITH {S.TEXTS}, y AS (SELECT genre, year, count(*) AS n FROM texts WHERE lang = 'de' GROUP BY ALL), g AS (SELECT DISTINCT genre FROM y) SELECT genre, CAST(year AS INTEGER) AS year, coalesce(n, 0) AS n FROM (SELECT genre, z.year FROM g, (SELECT unnest(range((SELECT min(year) FROM y), (SELECT max(year) + 1 FROM y))) AS year) z) x LEFT JOIN y USING (genre, year)")
def join_filled_grid(spark, sf):
    t = S.texts(spark, sf, ("genre",)).where("lang = 'de'").withColumn("n", F.lit(1).cast("long"))
    return joins.filled_grid(t, "genre", "year", "n")


@query(f"WITH {S.LONG} SELECT x.norm AS a, y.norm AS b, count(*) AS n, round(corr(x.z, y.z), 6) AS r FROM long x JOIN long y ON x.lang = y.lang AND x.word = y.word AND x.norm < y.norm GROUP BY ALL")
def join_pairs(spark, sf):
    long = S.norms_long(spark, sf).withColumn("key", F.struct("lang", "word"))
    return rounded(joins.pairs_below(long, "key", "norm", "z").groupBy("a", "b").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("r")))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def join_missing(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("WITH a AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1) SELECT coalesce(a.nation, b.nation) AS nation, a.n AS n_a, b.n AS n_b FROM a FULL JOIN b ON a.nation = b.nation")
def join_full_merge(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return joins.full_merge(a, b, ["nation"])


@query(f"WITH {S.TEXTS}, {S.GROUPS}, v AS (SELECT _id, CASE WHEN doc_id % 2 = 0 THEN corpus END AS v FROM texts), k AS (SELECT group_id, min(v) AS k FROM groups JOIN v USING (_id) GROUP BY 1) SELECT _id, group_id, coalesce(v, k) AS v FROM groups JOIN v USING (_id) JOIN k USING (group_id)")
def join_propagated(spark, sf):
    v = S.texts(spark, sf).select("_id", F.when(F.col("doc_id") % 2 == 0, F.col("corpus")).alias("v"))
    return joins.propagated(v, S.groups(spark, sf), "_id", "v")


@query(f"WITH {S.ORDERS}, c AS (SELECT year, segment, count(*) AS n FROM o GROUP BY ALL) SELECT year, segment, n, rank() OVER (PARTITION BY year ORDER BY n DESC) AS rank, rank() OVER (PARTITION BY year ORDER BY n) + (count(*) OVER (PARTITION BY year, n) - 1) / 2 AS average_rank FROM c")
def ranks(spark, sf):
    from pyspark.sql import Window

    c = S.orders(spark, sf).groupBy("year", "segment").agg(F.count("*").alias("n"))
    return c.withColumn("rank", F.rank().over(Window.partitionBy("year").orderBy(F.desc("n")))).withColumn("average_rank", shape.average_rank("n", "year"))


@query(f"WITH {S.ORDERS}, c AS (SELECT segment, year, count(*) AS n FROM o GROUP BY ALL), w AS (SELECT segment, year, avg(n) OVER x AS wide, CASE WHEN count(n) OVER y >= 2 THEN avg(n) OVER y END AS narrow FROM c WINDOW x AS (PARTITION BY segment ORDER BY year ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), y AS (PARTITION BY segment ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT segment, year, round(wide, 6) AS wide, round(narrow, 6) AS narrow FROM w")
def rolling_means(spark, sf):
    c = S.orders(spark, sf).groupBy("segment", "year").agg(F.count("*").alias("n"))
    return rounded(c.select("segment", "year", shape.rolling_mean("n", "year", ["segment"], 12, 12).alias("wide"), shape.rolling_mean("n", "year", ["segment"], 2, 2, 2).alias("narrow")))


@query(f"WITH {S.ORDERS}, r AS (SELECT segment, o_orderkey, price, row_number() OVER (PARTITION BY segment ORDER BY price DESC, o_orderkey) AS rank FROM o) SELECT * FROM r WHERE rank <= 5")
def top_by_group(spark, sf):
    return shape.top_k(S.orders(spark, sf).select("segment", "o_orderkey", "price"), ["segment"], 5, F.desc("price"), "o_orderkey").withColumn("rank", F.col("rank").cast("long"))


@query("(SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 6) UNION (SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 6)")
def both_ends(spark, sf):
    return shape.both_ends(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 6)


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|3')) AS i FROM documents) SELECT doc_id, lang FROM r WHERE i <= 7")
def stratified_sample(spark, sf):
    return shape.hashed_sample(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 7, 3)


@query("SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id || '|1'), 1, 8))::BIGINT / 4294967296.0 < 0.1")
def bernoulli_sample(spark, sf):
    return shape.bernoulli(table(spark, sf, "events").select("event_id"), "event_id", 0.1, 1)


@query(f"WITH {S.ORDERS}, r AS (SELECT year, o_orderkey, row_number() OVER (PARTITION BY year ORDER BY price, o_orderkey) AS i, count(*) OVER (PARTITION BY year) AS c FROM o) SELECT year, o_orderkey FROM r WHERE i = c // 2 + 1")
def middle_rows(spark, sf):
    return order.middle_rows(S.orders(spark, sf).select("year", "o_orderkey", "price"), ["year"], ["price", "o_orderkey"]).select("year", "o_orderkey")


@query(f"WITH {S.ORDERS} SELECT segment, round(quantile_cont(price, 0.05), 4) AS p05, round(quantile_cont(price, 0.95), 4) AS p95, round(median(price), 4) AS median FROM o GROUP BY 1")
def quantiles(spark, sf):
    out = order.quantiles(S.orders(spark, sf), ["segment"], "price", {"p05": 0.05, "p95": 0.95, "median": 0.5})
    return rounded(out, 4)


@query("SELECT count(*) AS n, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(median(l_extendedprice), 4) AS q2, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3 FROM lineitem")
def quantiles_of_all(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(order.quantiles(li, [], "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).join(li.agg(F.count("*").alias("n"))), 4)


@query(f"WITH {S.ORDERS} SELECT segment, priority, count(*) AS count FROM o GROUP BY CUBE (segment, priority)")
def cross_table_margins(spark, sf):
    return shape.cross_table(S.orders(spark, sf), "segment", "priority")


@query(f"WITH {S.ORDERS}, c AS (SELECT segment, priority, count(*) AS count FROM o GROUP BY ALL) SELECT segment, priority, count, round(count / sum(count) OVER (PARTITION BY segment), 6) AS share FROM c")
def cross_table_shares(spark, sf):
    return rounded(shape.row_shares(S.orders(spark, sf), "segment", "priority"))


@query(f"WITH {S.ORDERS} SELECT year, {', '.join(f'''count(*) FILTER (segment = '{s}') AS "{s.lower()}"''' for s in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))} FROM o GROUP BY year")
def pivoted(spark, sf):
    names = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    out = S.orders(spark, sf).groupBy("year").pivot("segment", names).count()
    return out.select("year", *(F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names))


@query(f"WITH {S.ORDERS}, c AS (SELECT segment, priority, count(*) AS count FROM o GROUP BY ALL) SELECT segment, priority, count, round(log2(count * sum(count) OVER () / (sum(count) OVER (PARTITION BY segment) * sum(count) OVER (PARTITION BY priority))), 6) AS log2_lift FROM c")
def lift(spark, sf):
    return rounded(shape.lift(S.orders(spark, sf), "segment", "priority"))


@query("SELECT l_returnflag AS a, l_linestatus AS b, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS num, count(*) AS den, round(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / count(*), 6) AS ratio FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def subtotals(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (F.col("l_quantity") > 25).cast("long").alias("big"))
    return rounded(shape.subtotals(li, "a", "b", F.col("big"), F.lit(1).cast("long")))


@query(f"WITH {S.TEXTS}, y AS (SELECT _id, lang, year // 100 AS c FROM texts), n AS (SELECT lang, c FROM y GROUP BY ALL HAVING count(*) >= 5), k AS (SELECT lang FROM n GROUP BY 1 HAVING count(*) >= 4) SELECT _id, lang FROM y WHERE lang IN (SELECT lang FROM k)")
def kept_categories(spark, sf):
    t = S.texts(spark, sf).select("_id", "lang", F.floor(F.col("year") / 100).alias("c"))
    return shape.kept_categories(t, "lang", "c", 4, 5).select("_id", "lang")


@query("WITH p AS (SELECT unnest(regexp_split_to_array(p_name || ' ' || p_type, ' ')) AS v FROM part) SELECT trim(v) AS value, count(*) AS count FROM p GROUP BY 1 HAVING count(*) >= 3")
def multi_value_tally(spark, sf):
    return shape.multi_values(table(spark, sf, "part").withColumn("names", F.concat_ws(" ", "p_name", "p_type")), "names", " ", 3)


@query("WITH p AS (SELECT p_partkey, regexp_split_to_array(p_name || ' ' || p_type, ' ') AS l FROM part), r AS (SELECT p_partkey, unnest(l) AS label, unnest(range(len(l))) AS pos FROM p), n AS (SELECT label, count(*) AS n FROM r GROUP BY 1) SELECT p_partkey, arg_max(label, (n, -pos)) AS label FROM r JOIN n USING (label) GROUP BY 1")
def main_labels(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("labels"))
    return shape.main_label(p, "p_partkey", "labels")


@query(
    "WITH t AS (SELECT axis, category, l_discount, l_tax FROM (UNPIVOT (SELECT l_discount, l_tax, l_returnflag AS flag, l_linestatus AS status FROM lineitem) ON flag, status INTO NAME axis VALUE category)) "
    "SELECT axis, category, measure, count(*) AS n, round(avg(value), 6) AS mean FROM (UNPIVOT t ON l_discount, l_tax INTO NAME measure VALUE value) GROUP BY ALL"
)
def measures_by_axis(spark, sf):
    li = table(spark, sf, "lineitem").select("l_discount", "l_tax", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return rounded(shape.measures_by(li, ["flag", "status"], ["l_discount", "l_tax"]))


@query("WITH r AS (SELECT c_mktsegment, c_acctbal + 1000 AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS r FROM customer) SELECT c_mktsegment, round((2 * sum(r * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)), 6) AS gini FROM r GROUP BY 1")
def gini(spark, sf):
    return rounded(order.gini(table(spark, sf, "customer").withColumn("v", F.col("c_acctbal") + 1000), ["c_mktsegment"], "v"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci FROM events GROUP BY 1")
def events_by_field(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"), F.countDistinct("user_id").alias("users"), F.avg("value").alias("mean"), (1.96 * F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("ci")))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows_batch(spark, sf):
    return event_windows(table(spark, sf, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def entity_attribute_pivot(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(*(F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in ("click", "purchase", "view")))


@query("SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role, count(*) AS turns, round(least(count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant')) / nullif(greatest(count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant')), 0), 6) AS co_presence FROM conversations GROUP BY conv_id")
def conversation_ends(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return rounded(graphs.co_presence(c, "u", "a").drop("u", "a"))


def _edges(spark, sf):
    """Repeated edges are left to the graphs' functions, which count them once."""
    return table(spark, sf, "lineitem").withColumn("l_shipmonth", F.date_format("l_shipdate", "yyyy-MM")).select(F.col("l_shipmonth").alias("graph"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b"))


_EDGES = "e AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS graph, 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem)"


@query(f"WITH {_EDGES} SELECT graph, node, count(*) AS degree FROM (SELECT graph, a AS node FROM e UNION ALL SELECT graph, b FROM e) GROUP BY ALL")
def graph_degrees(spark, sf):
    return graphs.degrees(_edges(spark, sf), ["graph"])


_DEGREES = f"{_EDGES}, x AS (SELECT graph, a, b FROM e UNION ALL SELECT graph, b, a FROM e), d AS (SELECT graph, a AS node, count(*) AS d FROM x GROUP BY ALL), s AS (SELECT graph, count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges FROM d GROUP BY 1)"


@query(
    f"WITH {_DEGREES}, r AS (SELECT graph, d, row_number() OVER (PARTITION BY graph ORDER BY d) AS i FROM d), g AS (SELECT graph, sum((2 * i - nodes - 1) * d) / (any_value(nodes) * sum(d)) AS gini FROM r JOIN s USING (graph) GROUP BY 1), "
    "m AS (SELECT x.graph, CASE WHEN stddev_pop(p.d) > 0 THEN corr(p.d, q.d) END AS assortativity FROM x JOIN d p ON p.graph = x.graph AND p.node = x.a JOIN d q ON q.graph = x.graph AND q.node = x.b GROUP BY 1) "
    "SELECT graph, nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 6) AS density, 0.0 AS clustering, round(gini, 6) AS gini, round(assortativity, 6) AS assortativity FROM s JOIN g USING (graph) JOIN m USING (graph)"
)
def graph_statistics(spark, sf):
    return rounded(graphs.statistics(_edges(spark, sf), "graph", diameters=False))


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS graph, s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey <> c_nationkey), "
    "x AS (SELECT graph, a, b FROM e UNION SELECT graph, b, a FROM e), n AS (SELECT graph, count(DISTINCT a) AS n FROM x GROUP BY 1), "
    "w AS (SELECT DISTINCT graph, a AS s, a AS v, 0 AS d, 1.0::DOUBLE AS k FROM x UNION ALL SELECT w.graph, w.s, x.b, w.d + 1, sum(w.k) FROM w JOIN x ON x.graph = w.graph AND x.a = w.v WHERE w.d < 12 GROUP BY ALL), "
    "p AS (SELECT graph, s, v, min(d) AS d, arg_min(k, d) AS k FROM w GROUP BY ALL), "
    "t AS (SELECT st.graph, sv.v AS node, sum(sv.k * vt.k / st.k) AS t FROM p st JOIN p sv ON sv.graph = st.graph AND sv.s = st.s JOIN p vt ON vt.graph = st.graph AND vt.s = sv.v AND vt.v = st.v "
    "WHERE sv.d > 0 AND vt.d > 0 AND st.d = sv.d + vt.d GROUP BY ALL) "
    "SELECT p.graph, p.s AS node, round(CASE WHEN n > 2 THEN coalesce(t, 0) / ((n - 1) * (n - 2)) ELSE 0 END, 6) AS betweenness FROM (SELECT DISTINCT graph, s FROM p) p JOIN n ON n.graph = p.graph LEFT JOIN t ON t.graph = p.graph AND t.node = p.s"
)
def graph_betweenness(spark, sf):
    """Months of trade between the nations of suppliers and customers."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("graph"))
    sold = li.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a")), "l_suppkey")
    bought = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), "c_custkey")
    return rounded(graphs.betweenness(sold.join(bought, "l_orderkey").select("graph", "a", "b").distinct(), "graph"))


@query("WITH n AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, l_partkey) AS i FROM n) SELECT l_suppkey, l_partkey, weight FROM r WHERE i <= 3")
def graph_bipartite(spark, sf):
    return graphs.bipartite(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", 3)


_V = "v AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)"


@query(f"WITH {_V}, m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL) SELECT label, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM m")
def mean_pooled(spark, sf):
    m = embeddings.mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding")
    return rounded(m.select("label", F.posexplode("embedding").alias("i", "x")))


AXIS = f"{_V}, m AS (SELECT i, avg(x) FILTER (label = 1) - avg(x) FILTER (label = 0) AS a FROM v GROUP BY i), ax AS (SELECT list(a ORDER BY i) AS a FROM m), c AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], a) AS s FROM embeddings, ax)"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector"), "label")


@query(f"WITH {AXIS} SELECT 'w' || vec_id AS word, round((s - avg(s) OVER ()) / stddev_pop(s) OVER (), 5) AS z FROM c")
def axis_scores(spark, sf):
    v = _vectors(spark, sf)
    poles = v.where("label in (0, 1)").select(F.lit("c").alias("contrast"), "word", F.when(F.col("label") == 1, "pos").otherwise("neg").alias("band"))
    own = v.select("word", "vector")
    out = embeddings.axis_scores(own, embeddings.axes(own, poles, []), [])
    return out.select("word", F.round("z", 5).alias("z"))


@query()
def reduced_dimensions(spark, sf):
    out = embeddings.reduced(table(spark, sf, "embeddings"), "embedding", 2)
    return out.select("vec_id", F.round(F.abs(F.col("components")[0]), 6).alias("x"), F.round(F.abs(F.col("components")[1]), 6).alias("y"))


@query("SELECT DISTINCT lang FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) > 20)")
def shared_values(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("lang").intersect(d.groupBy("lang").count().where("count > 20").select("lang"))


@query(
    f"WITH {S.RATED}, h AS (SELECT CAST(('0x' || substr(md5(concat_ws('|', lang, word, n)), 1, 13))::BIGINT AS HUGEINT) AS x FROM rated) SELECT substr(sha256(count(*) || '|' || coalesce(sum(x), 0)), 1, 12) AS version, count(*) AS n FROM h"
)
def norms_size(spark, sf):
    """Number of rated words and the digest of what they are."""
    return N.fingerprint(S.rated(spark, sf).select("lang", "word", "n"))


@query("WITH c AS (SELECT l_partkey, CASE WHEN l_extendedprice / l_quantity >= 1000 THEN 'Abs' WHEN l_extendedprice / l_quantity <= -1000 THEN 'Conc' ELSE 'Neither' END AS band FROM lineitem WHERE l_quantity > 0) SELECT band, count(*) AS n FROM c GROUP BY 1")
def banded(spark, sf):
    li = table(spark, sf, "lineitem").where("l_quantity > 0")
    return li.groupBy(bins.z_band(F.col("l_extendedprice") / F.col("l_quantity"), 1000).alias("band")).agg(F.count("*").alias("n"))
