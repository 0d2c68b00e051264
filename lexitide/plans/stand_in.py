"""The test tables in the roles of the analytics: texts, word counts, ratings, groups. And the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import bins
from lexitide.functions import text as T
from lexitide.operators import norms as N
from lexitide.operators import scoring
from lexitide.runtime import Scratch, kept, spread, table, table_state

CENTURIES = (16, 17, 18, 19, 20)


def texts(spark: SparkSession, sf: str, columns: tuple = ()) -> DataFrame:
    """_id, doc_id, corpus, lang, year (1500-1999), and what else is asked for of genre, text, n_chars."""
    docs = table(spark, sf, "documents")
    out = docs.withColumn("corpus", F.col("source")).withColumn("_id", T.text_id(F.col("source"), F.col("doc_id")))
    out = out.withColumn("year", (1500 + F.pmod(F.col("doc_id") * 7919, F.lit(500))).cast("int"))
    out = out.withColumn("genre", F.element_at(F.array(*map(F.lit, ("Fiction", "Poetry", "Periodical"))), (F.pmod("doc_id", F.lit(3)) + 1).cast("int")))
    out = out.select("_id", "doc_id", "corpus", "lang", "year", *columns)
    return spread(out) if "text" in columns else out


KEYS = ["_id", "doc_id", "corpus", "lang", "year"]


def bags(spark: SparkSession, sf: str) -> DataFrame:
    """(_id, doc_id, corpus, lang, year, bag of (word, cnt)): texts are tokenised once in a session, for all scores and ratings, and stay in their tasks."""

    def make() -> DataFrame:
        return scoring.of_one_text(Scratch(spark, "bags").save(scoring.bags(texts(spark, sf, ("text",)), KEYS), "rows"), KEYS)

    return kept(spark, "counted", table_state(spark, sf, "documents"), make)


def counted(spark: SparkSession, sf: str) -> DataFrame:
    """(_id, doc_id, corpus, lang, year, word, cnt)."""
    return bags(spark, sf).select(*KEYS, F.inline("bag"))


def freqs(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """(keys, word, cnt); keys with the text's id need no further sum."""
    keys = keys or ("_id", "lang")
    rows = counted(spark, sf)
    return rows.select(*keys, "word", "cnt") if "_id" in keys or "doc_id" in keys else rows.groupBy(*keys, "word").agg(F.sum("cnt").alias("cnt"))


def both(spark: SparkSession, sf: str, ratings) -> tuple[DataFrame, DataFrame]:
    """Saved word counts, and ratings made of them."""
    return counted(spark, sf), ratings(spark, sf, True)


def _states(spark: SparkSession, sf: str) -> tuple:
    return table_state(spark, sf, "documents"), table_state(spark, sf, "labels")


def rated(spark: SparkSession, sf: str, century: bool = False) -> DataFrame:
    """(lang[, century], word, quality, toxic, n): means over labelled documents that hold the word, at least 3."""

    def make() -> DataFrame:
        # texts meet their labels before their words are rows
        own = bags(spark, sf).withColumn("century", bins.century_label(F.col("year"))).select("doc_id", "lang", "century", "bag")
        words = own.join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id").select("lang", "century", "quality", "toxic", F.inline("bag"))
        keys = ["lang", *(["century"] if century else []), "word"]
        return words.groupBy(*keys).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("n")).where("n >= 3")

    return kept(spark, f"rated-{century}".lower(), _states(spark, sf), make)


def _norms(spark: SparkSession, sf: str) -> DataFrame:
    def make() -> DataFrame:
        out = N.with_zscores(scoring.frequent(rated(spark, sf)), ["lang"], {"z_quality": "quality", "z_toxic": "toxic"}, 9)
        return out.select("lang", "word", "z_quality", "z_toxic", F.round(N.row_median(F.col("z_quality"), F.col("z_toxic")), 9).alias("z_median"), "frequent", "n")

    return kept(spark, "norms", _states(spark, sf), make)


def norms(spark: SparkSession, sf: str, frequent: bool = False) -> DataFrame:
    """Wide ratings: (lang, word, z_quality, z_toxic, z_median), and for look-ups whether the word is frequent."""
    return _norms(spark, sf).drop("n", *([] if frequent else ["frequent"]))


def norms_long(spark: SparkSession, sf: str, frequent: bool = False) -> DataFrame:
    return N.long(norms(spark, sf, frequent), ["lang", "word", *(["frequent"] if frequent else [])], ["z_quality", "z_toxic", "z_median"])


def century_norms(spark: SparkSession, sf: str) -> DataFrame:
    """(lang, word, C16 .. C20): z of quality by language and century."""

    def make() -> DataFrame:
        out = N.with_zscores(rated(spark, sf, True), ["lang", "century"], {"z": "quality"}, 9)
        return N.wide(out, ["lang", "word"], "century", "z", [f"C{c}" for c in CENTURIES])

    return kept(spark, "century_norms", _states(spark, sf), make)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """_id, corpus, lang, year, genre, score."""

    def make() -> DataFrame:
        own = scoring.weighted_means(*both(spark, sf, norms), ["lang", "word"], ["_id"], ["z_quality"])
        return texts(spark, sf, ("genre",)).join(own.select("_id", F.col("z_quality").alias("score")), "_id")

    return kept(spark, "scores", _states(spark, sf), make)


def groups(spark: SparkSession, sf: str) -> DataFrame:
    """(_id, group_id) of texts that are copies of each other, after trim and lower. Texts are hashed once in a session."""

    def make() -> DataFrame:
        # hashes are saved first: the texts would be read and hashed for either side of the join
        own = table(spark, sf, "documents").select(T.text_id(F.col("source"), F.col("doc_id")).alias("_id"), F.md5(F.lower(F.trim("text"))).alias("group_id"))
        own = Scratch(spark, "groups").save(own, "hashes")
        again = own.groupBy("group_id").count().where("count > 1").select("group_id")
        return own.join(again, "group_id", "left_semi").select("_id", "group_id")

    return kept(spark, "groups", table_state(spark, sf, "documents"), make)


def contrasts(spark: SparkSession, sf: str, frequent: bool = False) -> DataFrame:
    """(contrast, word, band) of the English words, by z of quality; for look-ups whether the word is frequent, of these alone: other languages take none of their places."""
    out = _norms(spark, sf).where("lang = 'en' and z_quality is not null").drop("frequent")
    out = scoring.frequent(out) if frequent else out
    band = F.when(F.col("z_quality") <= -1, "neg").when(F.col("z_quality") >= 0.3, "pos").otherwise("neither")
    return out.select(F.lit("quality").alias("contrast"), "word", band.alias("band"), *(["frequent"] if frequent else []))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with year, segment and nation, for work on relational data."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    out = o.join(c, o["o_custkey"] == c["c_custkey"])
    return out.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("price"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("c_nationkey").alias("nation"), F.concat(F.lit("n"), F.pmod("c_nationkey", F.lit(5)).cast("string")).alias("corpus"))


# The same for DuckDB. Its \w is ASCII, so classes are named.
TEXTS = """texts AS (SELECT '_' || source || '/' || doc_id AS _id, doc_id, source AS corpus, lang, CAST(1500 + (doc_id * 7919) % 500 AS INTEGER) AS year,
  ['Fiction', 'Poetry', 'Periodical'][doc_id % 3 + 1] AS genre, text, n_chars FROM documents)"""
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+')"
TOKENS = r"[\p{L}\p{N}_'']+|[.,!?; \-—–\n]"
FREQS = f"freqs AS (SELECT _id, doc_id, corpus, lang, year, genre, word, count(*) AS cnt FROM (SELECT * EXCLUDE (text), unnest({WORDS}) AS word FROM texts) GROUP BY ALL)"
RATED = f"{TEXTS}, {FREQS}, rated AS (SELECT lang, word, avg(quality) AS quality, avg(toxic) AS toxic, count(*) AS n FROM freqs JOIN labels USING (doc_id) GROUP BY ALL HAVING count(*) >= 3)"
_z = lambda c, by: f"round(({c} - avg({c}) OVER (PARTITION BY {by})) / nullif(stddev_pop({c}) OVER (PARTITION BY {by}), 0), 9)"
NORMS = f"""{RATED}, norms2 AS (SELECT lang, word, {_z("quality", "lang")} AS z_quality, {_z("toxic", "lang")} AS z_toxic FROM rated),
  norms AS (SELECT *, round(CASE WHEN z_quality IS NULL THEN z_toxic WHEN z_toxic IS NULL THEN z_quality ELSE (z_quality + z_toxic) / 2 END, 9) AS z_median FROM norms2)"""
LONG = f"{NORMS}, long AS (SELECT lang, word, norm, z FROM (UNPIVOT norms ON z_quality, z_toxic, z_median INTO NAME norm VALUE z))"
CENTURY_NORMS = f"""{TEXTS}, {FREQS}, crated AS (SELECT lang, 'C' || (year // 100 + 1) AS century, word, avg(quality) AS quality FROM freqs JOIN labels USING (doc_id) GROUP BY ALL HAVING count(*) >= 3),
  cz AS (SELECT lang, century, word, {_z("quality", "lang, century")} AS z FROM crated),
  cnorms AS (SELECT lang, word, {", ".join(f"min(z) FILTER (century = 'C{c}') AS C{c}" for c in CENTURIES)} FROM cz GROUP BY ALL)"""
SCORES = f"{NORMS}, own AS (SELECT _id, sum(cnt * z_quality) / sum(cnt) FILTER (z_quality IS NOT NULL) AS score FROM freqs JOIN norms USING (lang, word) GROUP BY _id), scores AS (SELECT t._id, doc_id, corpus, lang, year, genre, score FROM texts t JOIN own USING (_id))"
GROUPS = "allg AS (SELECT '_' || source || '/' || doc_id AS _id, md5(lower(trim(text, ' '))) AS group_id FROM documents), groups AS (SELECT * FROM allg WHERE group_id IN (SELECT group_id FROM allg GROUP BY 1 HAVING count(*) > 1))"
CONTRASTS = f"{NORMS}, contrasts AS (SELECT word, CASE WHEN z_quality <= -1 THEN 'neg' WHEN z_quality >= 0.3 THEN 'pos' ELSE 'neither' END AS band FROM norms WHERE lang = 'en' AND z_quality IS NOT NULL)"
ORDERS = "o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS price, c_mktsegment AS segment, o_orderpriority AS priority, c_nationkey AS nation, 'n' || (c_nationkey % 5) AS corpus FROM orders JOIN customer ON o_custkey = c_custkey)"
