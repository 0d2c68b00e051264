"""Queries on word vectors, sentences, effects, partitions, samples, stored tables, sessions and quotations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators import draws, effects, embeddings, gram, order, quotes, sentences, vectors
from lexitide.plans import q_scoring
from lexitide.plans import stand_in as S
from lexitide.plans.catalog import query, rounded
from lexitide.runtime import Scratch, spread, table
from lexitide.sources.buckets import Buckets
from lexitide.streaming import sessions

# word vectors


def _lines(spark, sf):
    """English documents as lines of 25 words, by corpus and half of the time."""
    t = S.texts(spark, sf, ("text",)).where("lang = 'en'")
    # an array of one binds the words to a name, so that a text is cut into words once and not once for each line
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / 25), F.lit(0)).cast("int")), lambda i: F.slice(w, i * 25 + 1, 25))
    line = F.explode(F.get(F.transform(F.array(T.words(F.col("text"))), cut), F.lit(0)))
    period = F.when(F.col("year") < 1750, "early").otherwise("late")
    return t.select(F.lit("en").alias("corpus"), period.alias("period"), "doc_id", line.alias("words")).where(F.size("words") > 0)


@query(
    f"WITH t AS (SELECT {S.WORDS} AS w FROM documents WHERE lang = 'en'), l AS (SELECT w[i * 25 + 1 : i * 25 + 25] AS w FROM (SELECT w, unnest(range((len(w) + 24) // 25)) AS i FROM t)), "
    "p AS (SELECT w[i] AS a, unnest(w[i + 1 : i + 3]) AS b, unnest([1.0, 2 / 3, 1 / 3][1 : least(3, len(w) - i)]) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM l)) SELECT a, b, round(sum(n), 6) AS n FROM p GROUP BY ALL"
)
def skipgram_pairs(spark, sf):
    return rounded(vectors.pairs(_lines(spark, sf).select("words"), [], 3))


@query()
def word_vectors(spark, sf):
    """Vectors of one model, and each word's nearest of the model's ten most frequent words."""
    lines = _lines(spark, sf).select(F.lit(0).alias("run"), "words")
    words = Scratch(spark, "lines").save(vectors.vocabulary(lines, ["run"], 20), "words")
    v = Scratch(spark, "vectors").save(vectors.train(lines, ["run"], size=16, window=5, least=20, epochs=3, words=words), "vectors")
    often = words.orderBy(F.desc("n"), "word").limit(10).select("run", F.col("word").alias("near"))
    near = v.join(often.withColumnRenamed("near", "word"), ["run", "word"]).select("run", F.col("word").alias("near"), F.col("vector").alias("u"))
    met = v.join(F.broadcast(near), "run").where("word <> near").select("run", "word", "near", F.round(embeddings.cosine(F.col("vector"), F.col("u")), 6).alias("cosine"))
    return met.groupBy("run", "word").agg(F.max_by("near", F.struct("cosine", "near")).alias("near"), F.max("cosine").alias("cosine"))


@query()
def vector_norms(spark, sf):
    """From texts to norms: models by period and run, axes, z-scores, medians."""
    lines = _lines(spark, sf).select("corpus", "period", "words")
    out, names = vectors.vector_norms(lines, S.contrasts(spark, sf).where("band in ('pos', 'neg')"), runs=2, size=16, window=5, least=20, epochs=2)
    return rounded(out.select("word", *(F.col(f"`{n}`").alias(n.replace(".", "_")) for n in names)))


@query(
    "WITH v AS (SELECT label, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 3 = 0 THEN 'pos' WHEN vec_id % 3 = 1 THEN 'neg' END AS band, vec_id FROM embeddings), "
    "x AS (SELECT label, band, unnest(e) AS x, unnest(range(len(e))) AS i FROM v WHERE band IS NOT NULL), m AS (SELECT label, band, i, avg(x) AS x FROM x GROUP BY ALL), "
    "k AS (SELECT label FROM v GROUP BY label HAVING count(*) FILTER (band = 'pos') >= 15 AND count(*) FILTER (band = 'neg') >= 15), d AS (SELECT label, i, max(x) FILTER (band = 'pos') - max(x) FILTER (band = 'neg') AS x FROM m JOIN k USING (label) GROUP BY ALL) "
    "SELECT label, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM d"
)
def unit_axes(spark, sf):
    """Axes of length one, from at least 15 anchors of each pole."""
    v = table(spark, sf, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "label", F.col("embedding").alias("vector"), "vec_id")
    poles = v.where("vec_id % 3 < 2").select(F.lit("c").alias("contrast"), "word", F.when(F.col("vec_id") % 3 == 0, "pos").otherwise("neg").alias("band"))
    out = embeddings.axes(v.select("word", "label", "vector"), poles, ["label"], 15, True)
    return rounded(out.select("label", F.posexplode("axis").alias("i", "x")))


# sentences

_PIECES = r"WITH p AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\s*\S+\s*'), lambda x: regexp_replace(regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g'), ' '), '^[\"''(\[{«“‘„—-]*', ''), '[\"'')\]}»”’]*$', '')) AS c FROM documents)"
_TYPES = (
    _PIECES + r", t AS (SELECT unnest(c) AS token FROM p), k AS (SELECT lower(regexp_replace(token, '[.,;:!?]+$', '')) AS low, regexp_matches(token, '[^.]\.$') AS dotted FROM t), "
    r"types AS (SELECT CASE WHEN regexp_matches(low, '^[0-9][0-9.,]*$') THEN '##number##' ELSE low END AS type, count(*) AS n, count(*) FILTER (dotted) AS dotted FROM k GROUP BY 1)"
)


@query(f"{_TYPES} SELECT type, n, dotted FROM types")
def period_types(spark, sf):
    return sentences.types_of(table(spark, sf, "documents"))


_LL = "dotted * ln({p}) + CASE WHEN n > dotted THEN (n - dotted) * ln(1 - {p}) ELSE 0 END"


@query(
    f"{_TYPES}, a AS (SELECT sum(n) AS an, sum(dotted) AS ad FROM types), s AS (SELECT type, -2 * (({_LL.format(p='(ad / an)')}) - ({_LL.format(p='0.99')})) AS r, length(regexp_replace(type, '[^.]', '', 'g')) AS dots, n - dotted AS free FROM types, a WHERE dotted > 0 AND regexp_matches(type, '\\p{{L}}')), "
    "f AS (SELECT type, r * exp(-(length(type) - dots)) * (dots + 1) * power(greatest(length(type) - dots, 1), -free) AS score FROM s) SELECT type, round(score, 6) AS score FROM f WHERE score >= 0.3"
)
def abbreviation_scores(spark, sf):
    counted = Scratch(spark, "types").save(sentences.types_of(table(spark, sf, "documents")), "types")
    return rounded(sentences.abbreviations(counted, counted.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted"))))


@query()
def sentence_spans(spark, sf):
    """Sentences of all texts by learned boundaries; they add up to the texts."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return sentences.split(d, ["doc_id"], sentences.train(d))


# effects and partitions

_WITHIN = "m AS (SELECT y, x - avg(x) OVER (PARTITION BY g) AS dx, y - avg(y) OVER (PARTITION BY g) AS dy FROM x), s AS (SELECT sum(dx * dx) AS xx, sum(dx * dy) AS xy, sum(dy * dy) AS yy, count(*) AS n, var_pop(y) * count(*) AS sst FROM m)"


@query(
    f"WITH x AS (SELECT l_extendedprice AS y, l_quantity AS x, year(l_shipdate) * 100 + month(l_shipdate) AS g FROM lineitem), {_WITHIN}, d AS (SELECT *, n - 1 - (SELECT count(DISTINCT g) FROM x) AS dof, yy - xy * xy / xx AS sse FROM s) "
    "SELECT 'l_quantity' AS term, round(xy / xx, 3) AS beta, round(sqrt(sse / dof / xx), 4) AS se, round(xy / xx / sqrt(sse / dof / xx), 2) AS t, n, round(1 - sse / sst, 6) AS r2, round(1 - (sse / sst) * (n - 1) / dof, 6) AS adjusted_r2 FROM d"
)
def regression_with_two_effects(spark, sf):
    """Effects of the month and of its year: the years cost no degree of freedom besides the months."""
    li = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", F.year("l_shipdate").alias("year"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("month"))
    out = effects.least_squares(li, "l_extendedprice", ["l_quantity"], ["month", "year"])
    return out.select("term", F.round("beta", 3).alias("beta"), F.round("se", 4).alias("se"), F.round("t", 2).alias("t"), "n", F.round("r2", 6).alias("r2"), F.round("adjusted_r2", 6).alias("adjusted_r2"))


def _determinant(names: list[str]) -> str:
    """SQL of the determinant of correlations, by permutations of up to four names."""
    from itertools import permutations

    terms = []
    for p in permutations(range(len(names))):
        sign = "-" if sum(a > b for a, b in combinations(p, 2)) % 2 else "+"
        terms.append(sign + " * ".join(f"r_{min(i, j)}{max(i, j)}" if i != j else "1.0" for i, j in ((names[a], names[b]) for a, b in enumerate(p))))
    return f"({' '.join(terms)})"


def _r2(x: str) -> str:
    """SQL of the R2 of y on the columns x (letters): one less the determinants' ratio."""
    return f"(1 - {_determinant(list(x) + ['y'])} / {_determinant(list(x))})" if x else "0.0"


_CORR = "r AS (SELECT " + ", ".join(f"corr({a}, {b}) AS r_{min(a, b)}{max(a, b)}" for a, b in combinations("abcy", 2)) + " FROM (SELECT l_quantity AS a, l_discount AS b, l_tax AS c, l_extendedprice AS y FROM lineitem))"
_PARTS = [("(all)", None, "abc"), ("quantity", None, "a"), ("quantity", "l_quantity", "a"), ("terms", None, "bc"), ("terms", "l_discount", "b"), ("terms", "l_tax", "c")]


@query(
    f"WITH {_CORR} "
    + " UNION ALL ".join(f"SELECT '{b}' AS block, {f'{chr(39)}{f}{chr(39)}' if f else 'CAST(NULL AS VARCHAR)'} AS feature, round({_r2(x)}, 6) AS alone, round({_r2('abc')} - {_r2(''.join(c for c in 'abc' if c not in x))}, 6) + 0 AS added FROM r" for b, f, x in _PARTS)
)
def variance_partition(spark, sf):
    li = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return rounded(gram.partition(li, {"quantity": ["l_quantity"], "terms": ["l_discount", "l_tax"]}, "l_extendedprice"))


@query(
    "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), f AS (SELECT *, CAST(label = 3 AS DOUBLE) AS three, CAST(label AS DOUBLE) AS lab FROM e), "
    "c AS (SELECT i, covar_pop(x, three) AS a, covar_pop(x, lab) AS b, var_pop(x) AS v FROM f GROUP BY i), v AS (SELECT avg(CAST(label = 3 AS DOUBLE)) AS pa, var_pop(CAST(label = 3 AS DOUBLE)) AS va, avg(label) AS pb, var_pop(label) AS vb FROM embeddings) "
    "SELECT 'one' AS \"group\", 'three' AS feature, round(sum(a * a) / max(va) / sum(v), 8) AS r2, round(max(pa), 8) AS prevalence FROM c, v UNION ALL SELECT 'two', 'lab', round(sum(b * b) / max(vb) / sum(v), 8), round(max(pb), 8) FROM c, v"
)
def marginal_r2(spark, sf):
    """All components are kept here, which SQL can tell; fewer are tested against a plain version."""
    e = table(spark, sf, "embeddings").select("embedding", F.when(F.col("label") == 3, 1.0).otherwise(0.0).alias("three"), F.col("label").cast("double").alias("lab"))
    return rounded(gram.marginal(e, {"one": ["three"], "two": ["lab"]}, "embedding", 64), 8)


# samples

_DRAW = "('0x' || substr(md5('draw 7|' || k || '|' || {by}), 1, 12))::BIGINT / 281474976710656.0"


@query(
    f"WITH {S.ORDERS}, r AS (SELECT segment, o_orderkey, row_number() OVER (PARTITION BY segment ORDER BY md5('7|' || o_orderkey), o_orderkey) - 1 AS place, count(*) OVER (PARTITION BY segment) AS n FROM o), "
    f"d AS (SELECT segment, k AS draw, least(floor({_DRAW.format(by='segment')} * n), n - 1) AS place FROM (SELECT DISTINCT segment, n FROM r), (SELECT unnest(range(1, 201)) AS k)) SELECT segment, o_orderkey, CAST(draw AS INTEGER) AS draw FROM d JOIN r USING (segment, place)"
)
def sample_with_replacement(spark, sf):
    return draws.draws(S.orders(spark, sf).select("segment", "o_orderkey"), ["segment"], "o_orderkey", 200, seed=7)


_WINDOWS = q_scoring.counting_windows_sql


@query(
    f"WITH w AS ({_WINDOWS}), p AS (SELECT doc_id, slice, CAST(1500 + (doc_id * 7919) % 500 AS INTEGER) AS year, num_abs - num_conc AS abs_conc, num_abs, num_conc, num_neither FROM w), "
    f"z AS (SELECT *, {', '.join(f'({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS {c}_z' for c in ('abs_conc', 'num_abs', 'num_conc', 'num_neither'))} FROM p), "
    "b AS (SELECT *, CASE WHEN abs_conc_z >= 1 THEN 'Abs' WHEN abs_conc_z <= -1 THEN 'Conc' ELSE 'Neither' END AS zbin, year // 100 * 100 AS ybin, doc_id || '|' || slice AS id FROM z), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY ybin, zbin ORDER BY md5('7|' || id), id) - 1 AS place, count(*) OVER (PARTITION BY ybin, zbin) AS n FROM b), "
    f"d AS (SELECT DISTINCT ybin, zbin, least(floor({_DRAW.format(by=chr(39) + chr(39) + ' || ybin || ' + chr(39) + '|' + chr(39) + ' || zbin')} * n), n - 1) AS place FROM (SELECT DISTINCT ybin, zbin, n FROM r), (SELECT unnest(range(1, 21)) AS k)) "
    f"SELECT doc_id, slice, ybin, zbin, {', '.join(f'round({c}_z, 6) AS {c}_z' for c in ('abs_conc', 'num_abs', 'num_conc', 'num_neither'))} FROM d JOIN r USING (ybin, zbin, place)"
)
def book_passages(spark, sf):
    w = q_scoring.counting_windows(spark, sf).withColumn("year", (1500 + F.pmod(F.col("doc_id") * 7919, F.lit(500))).cast("int"))
    out = draws.book_passages(w, ["doc_id", "slice"], 20, 7)
    return rounded(out.select("doc_id", "slice", F.col("ybin").alias("ybin"), "zbin", "abs_conc_z", "num_abs_z", "num_conc_z", "num_neither_z"))


# a table changed in place


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'changed' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0")
def changed_in_place(spark, sf):
    """Orders stored, a fifth changed in place, an eleventh deleted."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stored = Buckets(spark, f"{Scratch(spark, 'buckets').base}/orders")
    stored.create(o, ["o_orderkey"], 32)
    stored.upsert(o.where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("changed")))
    stored.delete(o.where("o_orderkey % 11 = 0").select("o_orderkey"))
    return stored.read()


@query("SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1")
def sums_added_in_place(spark, sf):
    """Sums by customer of the orders before and after a date, added up in a stored table."""
    o = table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    sums = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    stored = Buckets(spark, f"{Scratch(spark, 'buckets').base}/sums")
    stored.create(sums(o.where("o_orderdate < '1995-01-01'")), ["o_custkey"], 16)
    stored.add(sums(o.where("o_orderdate >= '1995-01-01' or o_orderdate is null")), ["n", "cents"])
    return stored.read()


# sessions


@query(
    "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s"
)
def event_sessions(spark, sf):
    return rounded(sessions.sessions(table(spark, sf, "events").select("user_id", "ts", "value"), ["user_id"]), 4)


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) = 1")
def first_events(spark, sf):
    return sessions.once(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT event_type AS _id, count(*) AS n, round(sum(event_id % 7), 4) AS weight, round(sum(value * (event_id % 7)) / nullif(sum(event_id % 7), 0), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1")
def running_scores(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("_id"), "ts", F.col("value").alias("score"), (F.col("event_id") % 7).alias("weight"))
    return rounded(sessions.running_scores(e).drop("upto"))


# quotations

_TURNS = "t AS (SELECT conv_id, turn, role, list_concat(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+'), []) AS w FROM conversations), k AS (SELECT conv_id || '-' || turn AS id, unnest(w) AS word, unnest(range(len(w))) AS position FROM t), "
_QUOTES = (
    "q AS (SELECT conv_id || '-' || turn AS id, 1 AS quote, role AS speaker, 0 AS first, len(w) - 1 AS last FROM t UNION ALL SELECT conv_id || '-' || turn, 2, 'narrator', 3, 9 FROM t UNION ALL SELECT conv_id || '-' || turn, 3, 'other', 7, 20 FROM t), "
    "m AS (SELECT k.*, quote, speaker FROM k JOIN q USING (id) WHERE position BETWEEN first AND last AND first <= last QUALIFY row_number() OVER (PARTITION BY id, position ORDER BY last - first, -first, quote) = 1)"
)


def _turns(spark, sf):
    t = table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "turn", "role", T.words(F.col("text")).alias("w"))
    tokens = t.select("id", F.posexplode("w").alias("position", "word"), F.lit(None).cast("string").alias("tag"), (1600 + F.pmod("turn", F.lit(2)) * 200).cast("int").alias("year"))
    own = F.array(*(F.struct(F.lit(n).alias("quote"), s.alias("speaker"), a.alias("first"), b.alias("last")) for n, s, a, b in ((1, F.col("role"), F.lit(0), F.size("w") - 1), (2, F.lit("narrator"), F.lit(3), F.lit(9)), (3, F.lit("other"), F.lit(7), F.lit(20)))))
    return tokens, t.select("id", F.inline(own))


@query(f"WITH {_TURNS}{_QUOTES} SELECT id, quote, speaker, count(*) AS n FROM m GROUP BY ALL")
def quoted_tokens(spark, sf):
    """Tokens of each quotation; turns hold two others, which overlap."""
    tokens, own = _turns(spark, sf)
    return quotes.attributed(tokens, own, "id").groupBy("id", "quote", "speaker").agg(F.count("*").alias("n"))


@query(
    f"WITH {S.CENTURY_NORMS}, n AS (SELECT word, avg(z) AS early, avg(C18) AS late FROM (SELECT lang, word, coalesce(C16, C17, C18, C19, C20) AS z, C18 FROM cnorms) GROUP BY word), {_TURNS}{_QUOTES}, "
    "v AS (SELECT id, quote, speaker, CASE WHEN CAST(split_part(id, '-', 2) AS INTEGER) % 2 = 1 THEN coalesce(late, early) ELSE early END AS v FROM m JOIN n USING (word)) SELECT id, quote, speaker, count(v) AS n, round(avg(v), 6) AS mean FROM v WHERE v IS NOT NULL GROUP BY ALL"
)
def quote_scores(spark, sf):
    """Mean rating of what is said in each quotation, by the period's ratings; the general one where a word has none."""
    tokens, own = _turns(spark, sf)
    c = S.century_norms(spark, sf)
    norms = c.groupBy("word").agg(F.avg(F.coalesce("C16", "C17", "C18", "C19", "C20")).alias("early"), F.avg("C18").alias("late"))
    return rounded(quotes.quote_scores(tokens, own, norms, "id", quotes.period_value(F.col("year"), [(1800, 1900, "late")], "early")))


@query(
    f"WITH {S.NORMS}, n AS (SELECT word, avg(z_quality) AS z FROM norms GROUP BY word), {_TURNS}d AS (SELECT id, position % 3 AS character, CASE WHEN position % 2 = 0 THEN 'mod' ELSE 'agent' END AS role, word FROM k), "
    "r AS (SELECT id, 'c' || character AS name, unnest([role, '(all)']) AS role, z FROM d LEFT JOIN n USING (word) WHERE character < 2) SELECT id, name, role, count(*) AS n, count(z) AS n_rated, round(avg(z), 6) AS mean FROM r GROUP BY ALL"
)
def descriptor_scores(spark, sf):
    tokens, _ = _turns(spark, sf)
    d = tokens.select("id", F.pmod("position", F.lit(3)).alias("character"), F.when(F.col("position") % 2 == 0, "mod").otherwise("agent").alias("role"), "word")
    names = d.select("id", "character").distinct().withColumn("name", F.when(F.col("character") < 2, F.concat(F.lit("c"), F.col("character").cast("string"))))
    norms = S.norms(spark, sf).groupBy("word").agg(F.avg("z_quality").alias("z"))
    return rounded(quotes.descriptor_scores(d, names, norms, "id", F.col("z")))


@query("WITH c AS (SELECT bin, median(v) AS v FROM (SELECT year(o_orderdate) AS bin, o_totalprice AS v FROM orders) GROUP BY 1) SELECT bin, round(v, 4) AS v FROM c")
def medians_by_year(spark, sf):
    return rounded(order.medians(table(spark, sf, "orders").select(F.year("o_orderdate").cast("long").alias("bin"), F.col("o_totalprice").alias("v")), ["bin"], "v"), 4)

