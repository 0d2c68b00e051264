"""Queries on stores that carry a version, on lookups, and on the ratings of one language's sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators import norms as N
from lexitide.operators import records as R
from lexitide.plans.catalog import query, rounded
from lexitide.runtime import Scratch, table
from lexitide.sources import readers, registers, stores

_Z = "SELECT word, '{0}' AS source, (value - avg(value) OVER ()) / nullif(stddev_pop(value) OVER (), 0) AS z FROM {0}"


@query(
    "WITH c AS (SELECT 'w' || c_custkey AS word, c_custkey AS k, c_acctbal AS a, c_nationkey AS b FROM customer), "
    "flipped AS (SELECT word, -a AS value FROM c), "
    "averaged AS (SELECT word, CASE WHEN k % 3 = 0 THEN a WHEN k % 3 = 1 THEN b ELSE (a + b) / 2 END AS value FROM c), "
    "joined AS (SELECT word, a AS value FROM c WHERE k % 2 = 0 UNION ALL SELECT word, b FROM c WHERE k % 2 = 1 AND k % 5 = 0), "
    f"z AS ({' UNION ALL '.join(_Z.format(n) for n in ('flipped', 'averaged', 'joined'))}), "
    "w AS (SELECT word, min(z) FILTER (source = 'flipped') AS flipped, min(z) FILTER (source = 'averaged') AS averaged, min(z) FILTER (source = 'joined') AS joined, median(z) AS median FROM z GROUP BY 1) "
    "SELECT word, round(flipped, 6) + 0 AS flipped, round(averaged, 6) + 0 AS averaged, round(joined, 6) + 0 AS joined, round(median, 6) + 0 AS median FROM w WHERE word NOT LIKE '%7'"
)
def original_norms(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("w"), F.col("c_custkey")).alias("word"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    young, old = F.when(F.col("k") % 3 != 1, F.col("a")), F.when(F.col("k") % 3 != 0, F.col("b"))
    both = N.united(c.where("k % 2 = 0").select("word", F.col("a").alias("value")), c.where("k % 2 = 0 OR k % 5 = 0").select("word", F.col("b").alias("value")))
    sources = {"flipped": c.select("word", F.col("a").alias("value")), "averaged": c.select("word", N.row_mean(young, old).alias("value")), "joined": both}
    return rounded(N.originals(sources, ["flipped"], c.select(F.upper("word").alias("word")).where("word LIKE '%7'")))


_ARCS = "s AS (SELECT doc_id, doc_id AS _id, source AS arc_corpus, lang, doc_id % 7 AS score FROM documents), a AS (SELECT arc_corpus, min(lang) AS own FROM s GROUP BY 1)"


@query(
    f"WITH {_ARCS} SELECT s._id, s.arc_corpus, s.score, CASE WHEN s.doc_id % 5 > 0 AND s.doc_id % 3 > 0 THEN 'known' ELSE s.arc_corpus END AS corpus FROM s JOIN a ON s.arc_corpus = a.arc_corpus WHERE s.doc_id % 5 = 0 OR s.lang IS NULL OR s.lang = own"
)
def serving_view(spark, sf):
    d = table(spark, sf, "documents")
    languages = d.groupBy(F.col("source").alias("arc_corpus")).agg(F.min("lang").alias("lang"))
    texts = d.where("doc_id % 5 > 0").select(F.col("doc_id").alias("_id"), "lang", F.when(F.col("doc_id") % 3 > 0, "known").otherwise("").alias("corpus"))
    scores = d.select(F.col("doc_id").alias("_id"), F.col("source").alias("arc_corpus"), F.col("source").alias("source_corpus"), (F.col("doc_id") % 7).alias("score"))
    return stores.serve({"scores": scores}, texts, languages)["scores_texts"].select("_id", "arc_corpus", "score", "corpus")


@query("SELECT doc_id, lang, text FROM documents WHERE contains('_' || source || '/' || doc_id, '/17') ORDER BY '_' || source || '/' || doc_id LIMIT 1")
def resolved_text(spark, sf):
    d = table(spark, sf, "documents").select(T.text_id(F.col("source"), F.col("doc_id")).alias("id"), "doc_id", "lang", "text")
    return readers.resolved(d, "/17").drop("id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT conv_id FROM conversations)")
def scores_of_ids(spark, sf):
    return readers.with_ids(table(spark, sf, "labels").select("doc_id", "quality"), table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")


@query("SELECT doc_id, quality * 2 AS score FROM labels")
def cached_scores(spark, sf):
    own = table(spark, sf, "labels")
    path = f"{Scratch(spark, 'scores').base}/cache"
    for norms, factor in (("v1", 1), ("v2", 2), ("v2", 3)):  # the third finds the second's rows
        stores.cached(spark, path, lambda: own.select("doc_id", (F.col("quality") * factor).alias("score")), modernised="0", norms=norms)  # noqa: B023
    return stores.read_version(spark, path, "doc_id long, score int", modernised="0", norms="v2")


@query(
    "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '|3'), event_id) AS n FROM events) SELECT event_type, event_id FROM r WHERE n <= 150"
)
def exact_sample_by_group(spark, sf):
    return R.exact_sample(table(spark, sf, "events").select("event_type", "event_id"), "event_id", 150, 3, ["event_type"])


@query("SELECT p_brand, count(*) AS occurrences FROM part GROUP BY 1 HAVING count(*) >= 8")
def frequent_vocabulary(spark, sf):
    return readers.frequent(table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("occurrences")), 8, "occurrences")


def _first_name(column: str) -> str:
    return f"regexp_replace(regexp_extract({column}, '^[\\s\"]*(\\S+)', 1), '^[,.;:''\"\\-]+|[,.;:''\"\\-]+$', '', 'g')"


@query(
    "WITH r AS (SELECT p_name, p_type, regexp_replace(o_orderpriority, '^[0-9]-', '') AS priority, year(l_shipdate) AS shipped, year(o_orderdate) AS ordered FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey), "
    f"w AS (SELECT {_first_name('p_name')} AS w, shipped AS y, 'parts' AS register FROM r UNION ALL SELECT {_first_name('p_type')}, shipped, 'parts' FROM r UNION ALL SELECT {_first_name('priority')}, ordered, 'orders' FROM r) "
    "SELECT lower(w) AS name, count(*) AS n, count(DISTINCT register) AS n_registers, min(y) AS first_year, max(y) AS last_year FROM w "
    "WHERE regexp_matches(w, '^[A-Za-zÀ-ÿ''\\-]{3,}$') AND y BETWEEN 1996 AND 1999 GROUP BY 1 HAVING count(*) >= 5"
)
def register_names(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey")).join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    rows = rows.withColumn("priority", F.regexp_replace("o_orderpriority", "^[0-9]-", ""))
    parts = registers.wide(rows, {"p_name": "l_shipdate", "p_type": "l_shipdate"}, 1996, 1999)
    return registers.tally({"parts": parts, "orders": registers.wide(rows, {"priority": "o_orderdate"}, 1996, 1999)}, 5)
