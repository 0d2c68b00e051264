"""Queries on tokens, ratings, scores and counting windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexitide.functions import bins
from lexitide.functions import text as T
from lexitide.operators import counting, scoring
from lexitide.operators import norms as N
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded, t_p_sql
from lexitide.runtime import spread, table

PCT = ", ".join(
    f"round(coalesce(sum(cnt) FILTER (z_quality {op} {c}), 0) / sum(cnt) FILTER (z_quality IS NOT NULL), 6) AS pct_{n}_{t}_z_quality" for t, c in (("05", 0.5), ("10", 1.0)) for n, op, c in (("abs", "<=", -c), ("conc", ">=", c))
)
DIFF = ", ".join(
    f"round((coalesce(sum(cnt) FILTER (z_quality <= -{c}), 0) - coalesce(sum(cnt) FILTER (z_quality >= {c}), 0)) / sum(cnt) FILTER (z_quality IS NOT NULL), 6) AS pct_absconc_{t}_z_quality" for t, c in (("05", 0.5), ("10", 1.0))
)


def _mean(c):
    return f"round(sum(cnt * {c}) / sum(cnt) FILTER ({c} IS NOT NULL), 6) AS {c}"


MEANS = ", ".join(map(_mean, ("z_quality", "z_toxic", "z_median")))
COLUMNS = ["z_quality", "z_toxic", "z_median"]


@query(f"WITH {S.NORMS} SELECT _id, {MEANS} FROM freqs JOIN norms USING (lang, word) GROUP BY _id")
def score_weighted(spark, sf):
    return rounded(scoring.weighted_means(*S.both(spark, sf, S.norms), ["lang", "word"], ["_id"], COLUMNS))


@query(f"WITH {S.NORMS} SELECT _id, {MEANS} FROM freqs LEFT JOIN norms USING (lang, word) GROUP BY _id")
def score_weighted_keep_unrated(spark, sf):
    return rounded(scoring.weighted_means(*S.both(spark, sf, S.norms), ["lang", "word"], ["_id"], COLUMNS, keep_unrated=True))


@query(f"WITH {S.NORMS} SELECT _id, {PCT}, {DIFF} FROM freqs JOIN norms USING (lang, word) GROUP BY _id")
def score_proportions(spark, sf):
    return rounded(scoring.proportions(*S.both(spark, sf, S.norms), ["lang", "word"], ["_id"], ["z_quality"]))


@query(f"WITH {S.LONG} SELECT _id, norm, CAST(CASE WHEN z = 3 THEN 30 ELSE floor(round(z * 10, 9)) + 1 END AS INTEGER) AS bin, sum(cnt) AS cnt FROM freqs JOIN long USING (lang, word) WHERE z >= -3 AND z <= 3 GROUP BY ALL")
def histogram(spark, sf):
    return scoring.histogram(*S.both(spark, sf, S.norms_long), ["lang", "word"], ["_id"])


@query(
    f"WITH {S.LONG}, h AS (SELECT _id, norm, CAST(CASE WHEN z = 3 THEN 30 ELSE floor(round(z * 10, 9)) + 1 END AS INTEGER) AS bin, cnt FROM freqs JOIN long USING (lang, word) WHERE z >= -3 AND z <= 3) "
    "SELECT _id, norm, round(coalesce(sum(cnt) FILTER (bin <= -9), 0) / sum(cnt), 6) AS pct_abstract, round(coalesce(sum(cnt) FILTER (bin > 10), 0) / sum(cnt), 6) AS pct_concrete FROM h GROUP BY ALL"
)
def histogram_shares(spark, sf):
    return rounded(scoring.histogram_shares(histogram(spark, sf), ["_id"]))


@query(f"WITH {S.NORMS} SELECT lang, word, round(z_quality, 6) AS z_quality, round(z_toxic, 6) AS z_toxic, round(z_median, 6) AS z_median FROM norms")
def norms_wide(spark, sf):
    return rounded(S.norms(spark, sf))


@query(f"WITH {S.LONG} SELECT lang, word, norm, round(z, 6) AS z, CASE WHEN z >= 1 THEN 'Concrete' WHEN z <= -1 THEN 'Abstract' ELSE 'Neither' END AS band FROM long WHERE z IS NOT NULL")
def norms_fields(spark, sf):
    return rounded(N.fields(S.norms_long(spark, sf)))


@query(f"WITH {S.CENTURY_NORMS} SELECT lang, word, {', '.join(f'round(C{c}, 6) AS C{c}' for c in S.CENTURIES)} FROM cnorms")
def norms_by_century(spark, sf):
    return rounded(S.century_norms(spark, sf))


@query(
    f"WITH {S.NORMS}, c AS (SELECT corr(z_quality, z_toxic) AS r, count(*) AS n FROM norms WHERE z_quality IS NOT NULL AND z_toxic IS NOT NULL), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS dof FROM c) "
    f"SELECT 'z_quality' AS a, 'z_toxic' AS b, round(r, 6) AS r, n, round({t_p_sql('t', 'dof')}, 6) AS p FROM t"
)
def norms_correlations(spark, sf):
    return rounded(N.correlations(S.norms(spark, sf), ["z_quality", "z_toxic"]))


@query(f"WITH {S.NORMS} SELECT coalesce(n.lang, c.lang) AS lang, coalesce(n.word, c.word) AS word, round(z_quality, 6) AS z_quality, q FROM norms n FULL JOIN (SELECT lang, word, max(cnt) AS q FROM freqs WHERE cnt >= 20 GROUP BY ALL) c ON n.lang = c.lang AND n.word = c.word")
def norms_combined(spark, sf):
    often = S.freqs(spark, sf).where("cnt >= 20").groupBy("lang", "word").agg(F.max("cnt").alias("q"))
    return rounded(N.combined([S.norms(spark, sf).select("lang", "word", "z_quality"), often], ["lang", "word"]))


@query(f"WITH {S.NORMS} SELECT lang, word FROM norms WHERE lower(word) NOT IN (SELECT word FROM freqs WHERE cnt >= 20)")
def norms_without_common(spark, sf):
    return N.without(S.norms(spark, sf).select("lang", "word"), S.freqs(spark, sf).where("cnt >= 20"))


@query(
    f"WITH {S.TEXTS}, {S.FREQS}, m AS (SELECT corpus AS model, 'C' || (year // 100 + 1) AS century, word, sum(cnt) AS n FROM freqs WHERE lang = 'en' GROUP BY ALL), ic AS (SELECT century, word, log2(sum(n) OVER (PARTITION BY model) / n) AS ic FROM m), "
    "c AS (SELECT century, word, median(ic) AS ic FROM ic GROUP BY ALL) SELECT word, round(median(ic), 6) AS ic FROM c GROUP BY word"
)
def information_content(spark, sf):
    f = S.freqs(spark, sf, "corpus", "lang", "year").where("lang = 'en'")
    return rounded(N.information(f.groupBy(F.col("corpus").alias("model"), bins.century_label(F.col("year")).alias("century"), "word").agg(F.sum("cnt").alias("n"))))


@query(f"WITH {S.TEXTS}, {S.FREQS} SELECT _id, sum(cnt) AS n_words FROM freqs GROUP BY _id HAVING sum(cnt) >= 100")
def gate_minimum_words(spark, sf):
    return scoring.long_enough(S.freqs(spark, sf), ["_id"])


@query(f"WITH {S.TEXTS}, {S.FREQS} SELECT _id, round(sum(CASE WHEN word IN ('the', 'of', 'and', 'is', 'in') THEN cnt ELSE 0 END) / sum(cnt), 6) AS marker_share FROM freqs GROUP BY _id HAVING sum(CASE WHEN word IN ('the', 'of', 'and', 'is', 'in') THEN cnt ELSE 0 END) / sum(cnt) >= 0.05")
def gate_english(spark, sf):
    return rounded(scoring.marked_language(S.freqs(spark, sf), ["_id"], ["the", "of", "and", "is", "in"]))


@query(
    f"WITH {S.NORMS}, spelling AS (SELECT lang, word, max(left(word, length(word) - 1)) AS modern FROM freqs WHERE word LIKE '%s' AND length(word) > 3 GROUP BY ALL), s2 AS (SELECT word, max(modern) AS modern FROM spelling GROUP BY word), "
    "r AS (SELECT DISTINCT word AS modern FROM norms), x AS (SELECT _id, lang, coalesce(r.modern, f.word) AS word, cnt FROM freqs f LEFT JOIN s2 ON f.word = s2.word LEFT JOIN r ON s2.modern = r.modern) SELECT _id, lang, word, sum(cnt) AS cnt FROM x GROUP BY ALL"
)
def modern_spelling(spark, sf):
    f = S.freqs(spark, sf)
    spelling = f.where("word like '%s' and length(word) > 3").select("word", F.expr("left(word, length(word) - 1)").alias("modern")).distinct()
    return scoring.modern_words(f, spelling, S.norms(spark, sf))


@query(f"SELECT doc_id, len(t) AS n_tokens, length(array_to_string(t, '')) AS n_chars FROM (SELECT doc_id, regexp_extract_all(text, '{S.TOKENS}') AS t FROM documents)")
def tokens(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?s)[\p{L}\p{N}_'']+|[^\p{L}\p{N}_'']'), '¦') AS tokens, text FROM documents WHERE length(text) > 0")
def tokens_lossless(spark, sf):
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.array_join(T.lossless_tokens(F.col("text")), "¦").alias("tokens"), F.array_join(T.lossless_tokens(F.col("text")), "").alias("text"))


@query(
    f"WITH {S.NORMS}, p AS (SELECT _id, lang, regexp_extract_all(lower(text), '{S.TOKENS}') AS t FROM texts), r AS (SELECT _id, lang, unnest(t) AS word, unnest(range(len(t))) AS position FROM p) "
    "SELECT _id, CAST(position AS INTEGER) AS position, r.word, round(z_quality, 6) AS z, CASE WHEN z_quality >= 1 THEN 'Concrete' WHEN z_quality <= -1 THEN 'Abstract' ELSE 'Neither' END AS class FROM r LEFT JOIN norms USING (lang, word) WHERE regexp_matches(r.word, '^\\p{L}')"
)
def word_rows(spark, sf):
    return rounded(scoring.word_rows(S.texts(spark, sf, ("text",)), S.norms(spark, sf), ["lang", "word"], ["_id", "lang"], "z_quality").select("_id", "position", "word", "z", "class"))


@query(
    f"WITH {S.NORMS}, r AS (SELECT _id, lang, unnest(regexp_extract_all(lower(text), '{S.TOKENS}')) AS word FROM texts) SELECT _id, count(*) FILTER (z_quality <= -1) AS n_abs, count(*) FILTER (z_quality >= 1) AS n_conc, "
    "count(*) FILTER (coalesce(z_quality, 0) > -1 AND coalesce(z_quality, 0) < 1) AS n_neutral FROM r LEFT JOIN norms USING (lang, word) WHERE regexp_matches(r.word, '^\\p{L}') GROUP BY _id"
)
def passage_word_classes(spark, sf):
    return scoring.word_class_counts(S.texts(spark, sf, ("text",)), S.norms(spark, sf), ["lang", "word"], ["_id", "lang"], "z_quality").drop("lang")


CHUNKS = "w AS (SELECT _id, lang, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM texts), ch AS (SELECT _id, lang, w, unnest(range((len(w) - 1) // 200 + 1)) AS chunk FROM w)"


@query(f"WITH {S.TEXTS}, {CHUNKS} SELECT _id, CAST(chunk AS INTEGER) AS chunk, array_to_string(w[chunk * 200 + 1 : chunk * 200 + 200], ' ') AS text FROM ch")
def text_chunks(spark, sf):
    t = S.texts(spark, sf, ("text",)).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    return scoring.chunks(t, ["_id"], 200)


@query(
    f"WITH {S.NORMS}, {CHUNKS}, cw AS (SELECT _id, lang, chunk, unnest(regexp_extract_all(lower(array_to_string(w[chunk * 200 + 1 : chunk * 200 + 200], ' ')), '[\\p{{L}}\\p{{N}}_'']+')) AS word FROM ch), "
    "cs AS (SELECT _id, chunk, sum(z_quality) / count(z_quality) AS s FROM cw JOIN norms USING (lang, word) GROUP BY ALL) SELECT _id, CAST(chunk AS INTEGER) AS chunk, round(s, 6) AS z_quality, round(avg(s) OVER (PARTITION BY _id), 6) AS text_mean FROM cs"
)
def trajectories(spark, sf):
    t = S.texts(spark, sf, ("text",)).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    return rounded(scoring.trajectories(t, S.norms(spark, sf, True), ["lang", "word"], ["_id", "lang"], "z_quality", 200).drop("lang"))


PERIODS = [(1500 + 100 * i, 1600 + 100 * i, f"C{16 + i}") for i in range(4)] + [(1900, 2101, "C20")]


@query(
    f"WITH {S.NORMS}, {S.CENTURY_NORMS[S.CENTURY_NORMS.index('crated'):]}, n2 AS (SELECT * FROM norms JOIN cnorms USING (lang, word)), "
    f"s AS (SELECT _id, year, sum(cnt * z_quality) / sum(cnt) FILTER (z_quality IS NOT NULL) AS m, {', '.join(f'sum(cnt * C{c}) / sum(cnt) FILTER (C{c} IS NOT NULL) AS C{c}' for c in S.CENTURIES)} FROM freqs JOIN n2 USING (lang, word) GROUP BY ALL), "
    f"p AS (SELECT _id, m, CASE {' '.join(f'WHEN year >= {a} AND year < {b} THEN {c}' for a, b, c in PERIODS)} END AS v, CASE {' '.join(f'WHEN year >= {a} AND year < {b} THEN {chr(39)}{c}{chr(39)}' for a, b, c in PERIODS)} END AS l FROM s) "
    "SELECT _id, round(coalesce(v, m), 6) AS period_score, CASE WHEN v IS NULL THEN 'z_quality' ELSE l END AS period_score_source FROM p"
)
def period_score(spark, sf):
    both = S.norms(spark, sf, True).join(S.century_norms(spark, sf), ["lang", "word"])
    cols = ["z_quality", *(f"C{c}" for c in S.CENTURIES)]
    out = scoring.weighted_means(S.freqs(spark, sf, "_id", "lang", "year"), both, ["lang", "word"], ["_id", "year"], cols)
    return rounded(scoring.period_score(out, "year", PERIODS, "z_quality").select("_id", "period_score", "period_score_source"))


_ROWS = (
    f"p AS (SELECT doc_id, regexp_extract_all(text, '{S.TOKENS}') AS t FROM documents WHERE lang = 'en'), r AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS position FROM p), "
    "b AS (SELECT doc_id, position, token, lower(token) AS word, band FROM r LEFT JOIN contrasts ON contrasts.word = lower(token)), "
    "win AS (SELECT *, coalesce(count(band) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50 AS win FROM b)"
)


counting_windows_sql = (
    f"WITH {S.CONTRASTS}, {_ROWS}, g AS (SELECT doc_id, win, count(*) FILTER (band = 'neg') AS num_abs, count(*) FILTER (band = 'pos') AS num_conc, count(*) FILTER (band = 'neither') AS num_neither, count(band) AS num_total, "
    "count(*) FILTER (regexp_matches(token, '^\\p{L}')) AS num_words, count(DISTINCT CASE WHEN band IS NOT NULL THEN word END) AS num_types FROM win GROUP BY ALL HAVING count(band) > 0) "
    "SELECT doc_id, num_abs, num_conc, num_neither, num_total, num_words, num_types, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY win) AS INTEGER) AS slice FROM g"
)


@query(counting_windows_sql)
def counting_windows(spark, sf):
    docs = spread(table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "text"))
    return counting.window_counts(docs, S.contrasts(spark, sf, True), ["doc_id"], 50, names=["quality"]).drop("contrast", "window")


@query(
    f"WITH {S.CONTRASTS}, {_ROWS}, c AS (SELECT doc_id, band, word, count(*) AS n FROM b WHERE band IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, band ORDER BY n DESC, word) AS i FROM c) SELECT doc_id, band, string_agg(word, ',' ORDER BY i) AS words FROM k WHERE i <= 5 GROUP BY ALL"
)
def counting_top_words(spark, sf):
    docs = table(spark, sf, "documents").where("lang = 'en'")
    return counting.top_words(docs, S.contrasts(spark, sf, True), ["doc_id"]).drop("contrast")


@query()
def sentence_runs(spark, sf):
    return counting.sentences_of(table(spark, sf, "documents"), ["doc_id"], 25)


@query(
    f"WITH t AS (SELECT doc_id, {S.WORDS} AS w FROM documents), r AS (SELECT doc_id, w, unnest(range(len(w) // 25)) AS part FROM t) SELECT doc_id, part, array_to_string(w[part * 25 + 1 : part * 25 + 25], ' ') AS words FROM r"
)
def fixed_word_groups(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("position", "word"))
    return counting.fixed_groups(rows, ["doc_id"], 25).select("doc_id", "part", F.array_join("words", " ").alias("words"))


@query("SELECT page_id, regexp_replace(html, '<[^\\n\\r]*?>', '', 'g') AS text FROM pages")
def pages_without_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.without_tags(F.col("html")).alias("text"))


@query(
    "SELECT doc_id, lower(regexp_replace('DocNumber' || doc_id, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, CASE WHEN length(CAST(doc_id AS VARCHAR)) < 3 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS filled, "
    "source || '.' || doc_id AS dotted, source AS corpus FROM documents"
)
def identifier_rewrites(spark, sf):
    d = table(spark, sf, "documents")
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    own = T.text_id(F.col("source"), F.col("doc_id"))
    return d.select("doc_id", T.snake(F.concat(F.lit("DocNumber"), F.col("doc_id").cast("string"))).alias("snake"), T.zero_filled(F.col("doc_id").cast("string"), 3).alias("filled"), T.slash_to_dot(key).alias("dotted"), T.corpus_of(own).alias("corpus"))
