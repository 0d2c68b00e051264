"""Annotation records: labels, characters, tags, vocabularies, markup, and the joins that bring them to texts and scores."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators import scoring
from lexitide.runtime import bound_batches

#: Tokens whose new form a task remembers.
SEEN = 1 << 19

UNTAGGED, UNKNOWN_FORM = "(untagged)", "(unknown)"

# How names that are types begin, and the endings of classical names.
TYPE_ARTICLES, CLASSICAL = r"^(the |a |an )", r"(us|ia|issa|andra|ander|enes|oles|inda|etta|ina)$"
GENERIC = ("the ", "a ", "an ", "his ", "her ", "my ", "our ", "any ", "some ", "this ", "that ", "unnamed", "unknown", "generic", "people", "persons")


def columns_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def score_columns(df: DataFrame, wanted: list[str] | None = None, key: str = "_id") -> list[str]:
    """The columns wanted, or all but the key; ValueError if there is none or one is unknown."""
    out = [c for c in df.columns if c != key] if wanted is None else known(df, *wanted)
    if not out:
        raise ValueError("no score columns")
    return out


def rated_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, source, period) of the columns named prefix.source.period."""
    return [(m[0], m[1], m[2]) for m in (re.fullmatch(r"[^.]+\.(.+)\.([^.]+)", c) for c in df.columns) if m]


def known(df: DataFrame, *names: str) -> list[str]:
    """names, if df has them all; else ValueError."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return list(names)


def checked_id(value: str, pattern: str = r"_?[A-Za-z0-9_.-]+(/[^\x00-\x1f]+)?") -> str:
    """An identifier from outside, if it is well-formed; else ValueError."""
    import re

    if not re.fullmatch(pattern, value or ""):
        raise ValueError(f"not an identifier: {value!r}")
    return value


def confirmed_or_unknown(lang: Column, wanted: str) -> Column:
    return lang.isNull() | (lang == wanted)


def ordinal(value: Column, order: list[str]) -> Column:
    """Place of a label in its order, from 0; null for others."""
    return F.when(value.isin(*order), F.array_position(F.array(*map(F.lit, order)), value) - 1).cast("int")


def plotted_value(kind: str, low: float | None = None, high: float | None = None) -> Column:
    """One of seven values of a row of counts (num_abs, num_conc, num_neither, num_total), held between low and high."""
    a, c, n, total = (F.col(f"num_{k}") for k in ("abs", "conc", "neither", "total"))
    share = lambda x: 100 * F.try_divide(x, total)
    kinds = {"abs/conc": F.try_divide(a, c), "abs-conc": a - c, "conc-abs": c - a, "abs+conc": a + c, "abs": share(a), "conc": share(c), "neither": share(n)}
    if kind not in kinds:
        raise ValueError(f"no such value: {kind}")
    out = kinds[kind].cast("double")
    out = out if low is None else F.when(out.isNotNull(), F.greatest(out, F.lit(float(low))))
    return out if high is None else F.when(out.isNotNull(), F.least(out, F.lit(float(high))))


def discourse_mode(space: Column, time: Column, setting: Column) -> Column:
    """commentary: nowhere, in a moment, generic; scene: some metres, minutes or hours, a particular place; else other."""
    nowhere = (space == "none") & (time == "moment") & (setting == "generic")
    scene = space.isin("1m", "10m", "100m") & time.isin("minutes", "hours") & setting.isin("typed", "named", "fully_described")
    return F.when(scene, "scene").when(nowhere, "commentary").otherwise("other")


def named_character(kind: Column, name: Column) -> Column:
    """A character with a proper name: not a collective, nor one called after what it is."""
    own = F.trim(name)
    generic = F.lit(False)
    for p in GENERIC:
        generic = generic | F.startswith(F.lower(own), F.lit(p))
    return F.coalesce((kind == "character") & own.rlike(r"^\p{Lu}") & ~generic, F.lit(False))


def classified_names(df: DataFrame, name: str, realistic: DataFrame | None = None) -> DataFrame:
    """name_class of each row: unknown, type, realistic (a word is in realistic (word)), classical or other, in this order."""
    own = F.col(name)
    df = df.withColumn("__real", F.lit(False))
    if realistic is not None:
        words = df.select(own.alias("__n")).distinct().select("__n", F.explode(F.split("__n", r"\s+")).alias("__w"))
        found = words.join(realistic.select(F.lower("word").alias("__x")).distinct(), F.lower(F.btrim("__w", F.lit(".,"))) == F.col("__x"), "left_semi").select("__n").distinct().withColumn("__yes", F.lit(True))
        df = df.join(found, own == F.col("__n"), "left").withColumn("__real", F.coalesce("__yes", F.lit(False))).drop("__n", "__yes")
    first = F.lower(F.split(own, r"\s+")[0])
    kind = F.when(own.isNull() | (own == ""), "unknown").when(F.lower(own).rlike(TYPE_ARTICLES) | own.rlike(r"^[A-Z][a-z]+'s "), "type")
    return df.withColumn("name_class", kind.when(F.col("__real"), "realistic").when(first.rlike(CLASSICAL), "classical").otherwise("other")).drop("__real")


def matching(column: Column, *alternatives: str) -> Column:
    """Any of the patterns, whatever the case; null doesn't match."""
    return F.coalesce(column.rlike(f"(?i){'|'.join(alternatives)}"), F.lit(False))


# Joins


def with_metadata(scores: DataFrame, texts: DataFrame) -> DataFrame:
    """Scores (_id, source, ...) with the texts' columns; where a text has no metadata, its corpus is the score's source."""
    own = scores.join(texts, "_id", "left")
    return own.withColumn("corpus", F.coalesce(F.nullif("corpus", F.lit("")), "source"))


def with_tags(scores: DataFrame, texts: DataFrame, tags: DataFrame) -> DataFrame:
    """Scored texts, a row for each tag; texts without one have the tag (untagged)."""
    return scores.join(texts, "_id").join(tags, "_id", "left").withColumn("tag", F.coalesce("tag", F.lit(UNTAGGED)))


def tag_arrays(tagged: DataFrame, keys: list[str], *kept: str) -> DataFrame:
    """Sorted tags of each key, and the smallest value of the kept columns."""
    return tagged.groupBy(*keys).agg(F.array_sort(F.collect_set("tag")).alias("tags"), *(F.min(c).alias(c) for c in kept))


def narrative_forms(texts: DataFrame, groups: DataFrame, described: DataFrame) -> DataFrame:
    """(_id, form): the first form of a described text (_id, meta) in the same match group, of the smallest _id that states one."""
    form = F.trim(F.split(F.get_json_object("meta", "$.narrative_form"), r"\|")[0])
    stated = described.select(F.col("_id").alias("__d"), form.alias("form")).where("form <> ''").join(groups.select(F.col("_id").alias("__d"), "group_id"), "__d")
    by_group = stated.groupBy("group_id").agg(F.min_by("form", "__d").alias("form"), F.min("__d").alias("__d"))
    own = texts.select("_id").join(groups, "_id").join(by_group, "group_id").groupBy("_id").agg(F.min_by("form", "__d").alias("form"))
    return texts.select("_id").join(own, "_id", "left").select("_id", F.coalesce("form", F.lit(UNKNOWN_FORM)).alias("form"))


def passages_with_all(features: DataFrame, texts: DataFrame, scores: DataFrame, vectors: DataFrame) -> DataFrame:
    """Features by (_id, seq) with metadata and vectors, which they need, and scores, where there are any."""
    return features.join(texts, "_id").join(vectors, ["_id", "seq"]).join(scores, ["_id", "seq"], "left")


def labels_with_passages(labels: DataFrame, passages: DataFrame, keys: list[str]) -> DataFrame:
    """Exploded labels with what is said once for each passage: repeated passages don't multiply labels."""
    return labels.join(passages.groupBy(*keys).agg(*(F.min(c).alias(c) for c in passages.columns if c not in keys)), keys, "left")


def without_members(df: DataFrame, of: DataFrame, key: str = "_id") -> DataFrame:
    """df less the rows whose key is in of: a delete by a subquery, as a write of what stays."""
    return df.join(of.select(key).distinct(), key, "left_anti")


# Aggregates


def member_shares(df: DataFrame, by: list[str], field: str, member: str, least: int) -> DataFrame:
    """Rows, rows whose JSON array holds the member, and their percentage; groups with at least so many."""
    has = F.array_contains(F.from_json(field, "array<string>"), member)
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(has).alias("n_with"))
    return out.where(F.col("n_with") >= least).withColumn("pct", F.round(100.0 * F.col("n_with") / F.col("n"), 1))


def bucket_shares(values: DataFrame, by: list[str], value: str, taxonomy: DataFrame) -> DataFrame:
    """(by, bucket, pct) of values that the taxonomy (value, bucket) knows, trimmed and lower-cased; others are no base."""
    own = values.select(*by, F.lower(F.trim(value)).alias("__v")).where("__v <> ''")
    counted = own.groupBy(*by, "__v").agg(F.count("*").alias("n"))
    mapped = counted.join(taxonomy.select(F.lower(F.trim("value")).alias("__v"), "bucket").distinct(), "__v").groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))  # a row for each bucket
    return mapped.select(*by, "bucket", F.round(100 * F.col("n") / total, 1).alias("pct"))


def role_means(rows: DataFrame, by: list[str], role: str, value: str, roles: list[str]) -> DataFrame:
    """The mean over all rows, and of each role's."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), *(F.avg(F.when(F.col(role) == r, F.col(value))).alias(f"mean_{r}") for r in roles))


def means_of_means(rows: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Means by inner key, then their unweighted mean and the sum of the values by outer key."""
    first = rows.groupBy(*outer, *inner).agg(F.avg(value).alias("__m"), F.sum(value).alias("__s"))
    return first.groupBy(*outer).agg(F.avg("__m").alias("mean"), F.sum("__s").alias("total"), F.count("*").alias("n"))


def band_summary(rows: DataFrame, by: list[str], word: str, z: str, cut: float = 1.0) -> DataFrame:
    """Abstract and concrete tokens, their distinct words, and the ratio."""
    low, high = F.col(z) <= -cut, F.col(z) >= cut
    out = rows.groupBy(*by).agg(F.count_if(low).alias("n_abs"), F.count_if(high).alias("n_conc"), F.countDistinct(F.when(low, F.col(word))).alias("words_abs"), F.countDistinct(F.when(high, F.col(word))).alias("words_conc"))
    return out.withColumn("ratio", F.try_divide("n_abs", "n_conc"))


def vocabulary_coverage(vocabulary: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """Of counted words (by, word, cnt): how many kinds and tokens the vocabulary (word) has."""
    own = counts.join(vocabulary.select("word").distinct().withColumn("__in", F.lit(1)), "word", "left")
    kinds = lambda test: F.count_if(test)
    return own.groupBy(*by).agg(kinds(F.col("__in").isNotNull()).alias("kinds"), F.count("*").alias("all_kinds"), (F.sum(F.when(F.col("__in").isNotNull(), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("token_share"))


def caption(df: DataFrame, by: str, each: str) -> DataFrame:
    """(by, caption): texts of each kind, most first, like 'a (3), b (1)'."""
    n = df.groupBy(by, each).agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(each).alias("v"))))
    return n.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["v"], F.lit(" ("), (-x["n"]).cast("string"), F.lit(")"))), ", ").alias("caption"))


# Rows in order


def first_appearances(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """is_first for the first row of each key in the order."""
    return df.withColumn("is_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def extreme_places(df: DataFrame, by: list[str], place: str, value: str) -> DataFrame:
    """Where the value is largest and smallest; of equals the earliest place."""
    return df.groupBy(*by).agg(F.min_by(place, F.struct(-F.col(value), place)).alias("highest"), F.min_by(place, F.struct(value, place)).alias("lowest"))


def with_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each row with the number of rows of its key, by an aggregate joined back: no key's rows meet in one task for it."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(name)), key)


def ordered_by_anchor(df: DataFrame, category: str, place: str, value: str) -> DataFrame:
    """Categories numbered by their value at their first place."""
    anchor = df.groupBy(category).agg(F.min_by(value, place).alias("anchor"))
    return anchor.withColumn("position", F.row_number().over(Window.orderBy("anchor", category)))  # a row for each category


def exact_sample(df: DataFrame, key: str, n: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """n rows (of each group of by), those with the smallest hashes of key and seed; all if there are fewer.

    Rows are counted by the hash's first three digits: only the digits in which the n-th row falls are sorted, 1/4096 of the rows."""
    by = by or []
    rows = df.withColumn("__h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))).withColumn("__b", F.substring("__h", 1, 3))
    sizes = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    sizes = sizes.withColumn("__upto", upto).where(F.col("__upto") - F.col("__n") < n)
    if not by:
        sizes = F.broadcast(sizes)  # at most 4,096 rows
    sizes = sizes.select(*(F.col(k).alias(f"__by_{k}") for k in by), F.col("__b").alias("__at"), "__n", "__upto")
    both = rows.join(sizes, [F.col("__b") == F.col("__at"), *(F.col(k).eqNullSafe(F.col(f"__by_{k}")) for k in by)])
    edge = both.where(F.col("__upto") > n).withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key)))
    edge = edge.where(F.col("__upto") - F.col("__n") + F.col("__r") <= n)
    return both.where(F.col("__upto") <= n).select(*df.columns).unionAll(edge.select(*df.columns))


# Text


#: A token's word, from its first letter or digit to the last one, and what stands around it.
TOKEN = re.compile(r"([\W_]*)(.*?)([\W_]*)", re.S)


def respelled(df: DataFrame, keys: list[str], text: str, spelling: DataFrame) -> DataFrame:
    """(keys, text) with every word in its modern form; lines, spaces and the punctuation around words stay.

    A token between spaces is what stands before its first letter or digit, the word, and what follows the last one. Up to scoring.HEAD spellings are sent to the tasks, and
    texts stay where they are; beyond that a row for each token is shuffled, and keys tell rows apart."""
    modern = spelling.groupBy("word").agg(F.max("modern").alias("modern"))
    few = modern.limit(scoring.HEAD + 1).toArrow()
    if len(few) > scoring.HEAD:
        return _respelled_by_tokens(df, keys, text, modern)
    spark = df.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(few)

    def of_task(batches):
        forms = {w: m for w, m in zip(*(sent.value[c].to_pylist() for c in ("word", "modern"))) if m is not None}
        seen = {}

        def fixed(token: str) -> str:
            out = seen.get(token)
            if out is None:
                if len(seen) >= SEEN:
                    seen.clear()
                before, word, after = TOKEN.fullmatch(token).groups()
                out = seen[token] = f"{before}{forms.get(word, word)}{after}"
            return out

        for batch in batches:
            new = ["\n".join([" ".join([fixed(t) for t in line.split(" ")]) for line in x.split("\n")]) for x in batch[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(new, pa.string())], names=[*keys, text])

    own = df.where(F.col(text).isNotNull()).select(*keys, text)
    return own.mapInArrow(of_task, "".join(f"`{k}` {t}, " for k, t in own.select(*keys).dtypes) + f"`{text}` string")


def _respelled_by_tokens(df: DataFrame, keys: list[str], text: str, modern: DataFrame) -> DataFrame:
    core = r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"
    rows = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("__l", "__line"))
    rows = rows.select(*keys, "__l", F.posexplode(F.split("__line", " ")).alias("__t", "__token"))
    rows = rows.select(*keys, "__l", "__t", *(F.regexp_extract("__token", core, i).alias(n) for i, n in ((1, "__pre"), (2, "__word"), (3, "__post"))))
    modern = modern.select(F.col("word").alias("__word"), F.col("modern").alias("__modern"))
    token = F.concat("__pre", F.coalesce("__modern", "__word"), "__post")
    lines = rows.join(modern, "__word", "left").groupBy(*keys, "__l").agg(F.array_sort(F.collect_list(F.struct("__t", token.alias("s")))).alias("__ts"))
    lines = lines.select(*keys, "__l", F.array_join(F.transform("__ts", lambda x: x["s"]), " ").alias("__line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__l", "__line"))), lambda x: x["__line"]), "\n").alias(text))


def word_style(z: Column, top: float = 3.0) -> Column:
    """CSS of a word: an outline that grows with abstractness, a ground and weight that grow with concreteness."""
    share = F.least(F.abs(z), F.lit(top)) / top
    low = F.format_string("outline:%dpx solid rgba(0,0,0,%.2f); outline-offset:0px; border-radius:2px", (1 + F.bround(share * 3)).cast("int"), 0.15 + share * 0.70)
    high = F.format_string("font-weight:%d; background:rgba(0,0,0,%.2f); border-radius:2px", (400 + F.bround(share * 500)).cast("int"), 0.04 + share * 0.36)
    return F.when(z <= 0, low).when(z > 0, high)


def rendered(texts: DataFrame, keys: list[str], text: str, norms: DataFrame, spelling: DataFrame | None = None, keep_lines: bool = False) -> DataFrame:
    """(keys, html): paragraphs, each rated word in a span with its style. norms: word, z.

    A word is looked up in its modern spelling (word, modern) where it has one, and shown as it stands. keep_lines: line feeds become <br>."""
    paragraphs = texts.select(*keys, F.posexplode(T.paragraphs(F.trim(text))).alias("__p", "__par"))
    tokens = paragraphs.select(*keys, "__p", F.posexplode(T.lossless_tokens(F.col("__par"))).alias("__i", "__t")).withColumn("__l", F.lower("__t"))
    if spelling is not None:
        modern = spelling.groupBy(F.col("word").alias("__l")).agg(F.max("modern").alias("__m"))
        tokens = tokens.join(modern, "__l", "left").withColumn("__l", F.coalesce("__m", "__l"))
    rated = tokens.join(norms.select(F.col("word").alias("__w"), "z"), F.col("__l") == F.col("__w"), "left")
    safe = F.replace(F.replace(F.replace(F.col("__t"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    safe = F.replace(safe, F.lit("\n"), F.lit("<br>\n")) if keep_lines else safe
    kind = F.when(F.col("z") <= -1, "abstract").when(F.col("z") >= 1, "concrete").otherwise("neither")
    token = F.when(F.col("z").isNotNull(), F.concat(F.lit('<span class="'), kind, F.lit('" style="'), word_style(F.col("z")), F.lit('">'), safe, F.lit("</span>"))).otherwise(safe)
    joined = lambda order, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, x.alias("s")))), lambda y: y["s"]), "")
    body = rated.groupBy(*keys, "__p").agg(joined("__i", token).alias("__body"))
    first = F.when(F.col("__p") == 0, '<p class="psg-para psg-first">').otherwise('<p class="psg-para">')
    parts = F.array_sort(F.collect_list(F.struct("__p", F.concat(first, "__body", F.lit("</p>")).alias("s"))))
    return body.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda y: y["s"]), "\n").alias("html"))


#: Fixed: what the marks of a rendered passage mean.
LEGEND = '<p class="legend"><span class="abstract">abstract</span> <span class="concrete">concrete</span></p>'


def side_by_side(html: DataFrame, by: list[str], order: str, title: str | None = None, legend: bool = True) -> DataFrame:
    """(by, html): the rendered passages (by, order, html[, title]) of each group as the cells of one table row."""
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = F.when(F.length(title) > 0, F.concat(F.lit("<h4>"), safe(title), F.lit("</h4>"))).otherwise("") if title else F.lit("")
    cell = F.concat(F.lit("<td>"), head, F.lit('<div class="passage">'), "html", F.lit("</div></td>"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct(order, cell.alias("s")))), lambda x: x["s"])
    return html.groupBy(*by).agg(F.concat(F.lit(LEGEND if legend else ""), F.lit("<table><tr>"), F.array_join(cells, ""), F.lit("</tr></table>")).alias("html"))


def marked_passages(tokens: DataFrame, keys: list[str], bands: DataFrame) -> DataFrame:
    """(keys, passage): recognised words marked by band, other words bare, punctuation and n't set to the word before.

    tokens: keys, position, token; bands: word, band (neg, pos, neither)."""
    own = tokens.join(bands.select(F.col("word").alias("__w"), "band"), F.lower("token") == F.col("__w"), "left")
    t = F.col("token")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    glued = (t == "n't") | ~t.rlike(r"^\p{L}")
    shown = F.when(F.col("band") == "neg", tag("i", tag("b", t))).when(F.col("band") == "pos", tag("i", tag("u", t))).when(F.col("band") == "neither", tag("i", t)).otherwise(t)
    piece = F.when(glued, t).otherwise(F.concat(F.lit(" "), shown))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", piece.alias("s")))), lambda x: x["s"]), "")
    return own.groupBy(*keys).agg(F.replace(F.regexp_replace(joined, r"^\s+|\s+$", ""), F.lit("\n"), F.lit("\n<br>")).alias("passage"))


def pooled_strings(nested: Column) -> Column:
    """All strings of an array of arrays in one text."""
    return F.array_join(F.filter(F.flatten(F.filter(nested, lambda x: x.isNotNull())), lambda x: x.isNotNull() & (x != "")), " ")


# Nested records

SLICES = "array<struct<id: string, concabs: double, summary: string, narrative_mode: string, key_abstractions: array<string>, key_concretions: array<string>, character_descriptions: array<struct<name: string, description: string, quote: string, mode: string>>>>"


def slice_rows(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """A row for each slice of the JSON replies: its number, mode and how many of each thing it lists."""
    s = replies.select(*keys, F.explode(F.from_json(T.fenced_json(F.col(reply)), SLICES)).alias("s"))
    n = lambda f: F.greatest(F.size(F.col(f"s.{f}")), F.lit(0))
    return s.select(
        *keys, F.col("s.id").alias("slice_id"), F.split("s.id", "_")[1].cast("int").alias("slice_num"), F.col("s.concabs").alias("concabs"), F.coalesce("s.narrative_mode", F.lit("")).alias("narrative_mode"), n("key_abstractions").alias("n_abstractions"), n("key_concretions").alias("n_concretions"), n("character_descriptions").alias("n_characters"), F.col("s.character_descriptions").alias("characters")
    )


def character_rows(slices: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each character of a slice, with its modes as a list: a single one may be given as a string."""
    c = slices.select(*keys, "slice_id", "slice_num", F.explode("characters").alias("c"))
    many = F.from_json("c.mode", "array<string>")
    modes = F.when(F.col("c.mode").startswith("["), many).when(F.col("c.mode").isNotNull(), F.array("c.mode")).otherwise(F.array().cast("array<string>"))
    return c.select(*keys, "slice_id", "slice_num", F.col("c.name").alias("name"), F.col("c.description").alias("description"), F.col("c.quote").alias("quote"), modes.alias("modes"))
