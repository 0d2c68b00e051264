"""Scores of texts: frequency-weighted means of ratings, proportions by band, histograms, word rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import bins
from lexitide.functions import text as T

#: Ratings that are broadcast at most.
HEAD = 200_000


def word_counts(texts: DataFrame, keys: list[str], letters: bool = False) -> DataFrame:
    """(keys, word, cnt): the long bag of words. The partial counts of a task shrink before the shuffle."""
    out = texts.select(*keys, F.explode(T.words(F.col("text"))).alias("word"))
    if letters:
        out = out.where(T.only_letters(F.col("word")))
    return out.groupBy(*keys, "word").agg(F.count("*").alias("cnt"))


def bags(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bag): the words of each row with their counts, in the row itself: nothing is shuffled. Rows without words have null.

    Words are sorted; a count is the distance between two places where the word changes."""

    def counted(w):
        changes = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        # arrays of one bind a value to a name, so that it is computed once for a row
        runs = F.transform(F.array(changes), lambda c: F.transform(c, lambda at, k: F.struct(F.get(w, at).alias("word"), (F.coalesce(F.get(c, k + 1), F.size(w)) - at).cast("long").alias("cnt"))))
        return F.when(F.size(w) > 0, F.get(runs, F.lit(0)))

    return texts.select(*keys, F.get(F.transform(F.array(F.sort_array(T.words(F.col("text")))), counted), F.lit(0)).alias("bag"))


def of_one_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """bags() of saved rows in which no word of a key stands twice; only rows whose key is repeated meet, as a row for each word."""
    again = rows.groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    if again.isEmpty():
        return rows
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    met = rows.join(again, same, "left_semi").select(*keys, F.inline("bag")).groupBy(*keys, "word").agg(F.sum("cnt").alias("cnt"))
    return rows.join(again, same, "left_anti").unionByName(met.select(*keys, F.array(F.struct("word", "cnt")).alias("bag")))


def frequent(rated: DataFrame, n: str = "n") -> DataFrame:
    """rated with the column frequent: true for at most HEAD rows, those of the largest n (by eighths of its binary logarithm)."""
    step = F.floor(F.log2(F.col(n)) * 8)
    most, total = None, 0
    for r in sorted(rated.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):  # some hundred
        total += r["rows"]
        if total > HEAD:
            break
        most = r["step"]
    return rated.withColumn("frequent", step >= most if most is not None else F.lit(False))


def looked_up(freqs: DataFrame, ratings: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """freqs joined to ratings. With a column frequent in ratings, these rows are broadcast, so most words stay where they are; the others are shuffled."""
    if "frequent" not in ratings.columns:
        return freqs.join(ratings, on, how)
    few, rest = ratings.where("frequent").drop("frequent"), ratings.where("not frequent").drop("frequent")
    if rest.isEmpty():
        return freqs.join(F.broadcast(few), on, how)
    seldom = freqs.join(F.broadcast(few.select(*on).distinct()), on, "left_anti").join(rest, on, how)
    return freqs.join(F.broadcast(few), on).unionByName(seldom)


def _columns(ratings: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    return ratings.select(*on, *columns, *(c for c in ratings.columns if c == "frequent"))


def weighted_means(freqs: DataFrame, norms: DataFrame, on: list[str], keys: list[str], columns: list[str], keep_unrated: bool = False) -> DataFrame:
    """Mean of each rating column over a text's words, weighted by count.

    Each column's weight counts only words that have a value in it. Texts without any rated word are absent, or, with
    keep_unrated, have nulls. Of the rating table only frequent rows are broadcast (looked_up)."""
    joined = looked_up(freqs, _columns(norms, on, columns), on, "left" if keep_unrated else "inner")
    means = [(F.sum(F.col("cnt") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("cnt")))).alias(c) for c in columns]
    return joined.groupBy(*keys).agg(*means)


def proportions(freqs: DataFrame, norms: DataFrame, on: list[str], keys: list[str], columns: list[str], cuts=((0.5, "05"), (1.0, "10"))) -> DataFrame:
    """Shares of rated words at or beyond each cut: pct_abs, pct_conc, and their difference, for each column."""
    joined = looked_up(freqs, _columns(norms, on, columns), on)
    out = []
    for c in columns:
        z, total = F.col(c), F.sum(F.when(F.col(c).isNotNull(), F.col("cnt")))
        for cut, name in cuts:
            low, high = (F.coalesce(F.sum(F.when(test, F.col("cnt"))), F.lit(0)) / total for test in (z <= -cut, z >= cut))
            out += [low.alias(f"pct_abs_{name}_{c}"), high.alias(f"pct_conc_{name}_{c}"), (low - high).alias(f"pct_absconc_{name}_{c}")]
    return joined.groupBy(*keys).agg(*out)


def histogram(freqs: DataFrame, norms_long: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """(keys, norm, bin, cnt): counts by 0.1-wide z bin, named by its upper edge in tenths; beyond 3 dropped."""
    joined = looked_up(freqs, norms_long, on).withColumn("bin", bins.histogram_bin(F.col("z")))
    return joined.where("bin is not null").groupBy(*keys, "norm", "bin").agg(F.sum("cnt").alias("cnt"))


def histogram_shares(hist: DataFrame, keys: list[str], cut: float = 1.0) -> DataFrame:
    """Abstract: upper edge <= -cut + 0.1; concrete: upper edge > cut."""
    tenths = round(cut * 10)
    total = F.sum("cnt")
    return hist.groupBy(*keys, "norm").agg(
        (F.coalesce(F.sum(F.when(F.col("bin") <= 1 - tenths, F.col("cnt"))), F.lit(0)) / total).alias("pct_abstract"),
        (F.coalesce(F.sum(F.when(F.col("bin") > tenths, F.col("cnt"))), F.lit(0)) / total).alias("pct_concrete"),
    )


def modern_words(freqs: DataFrame, spelling: DataFrame, norms: DataFrame) -> DataFrame:
    """A word takes its modern form only if that is rated; counts that meet are summed. spelling: word, modern."""
    rated = norms.select(F.col("word").alias("modern")).distinct().withColumn("rated", F.lit(True))
    out = freqs.join(spelling.groupBy("word").agg(F.max("modern").alias("modern")), "word", "left").join(rated, "modern", "left")
    out = out.withColumn("word", F.when(F.col("rated"), F.col("modern")).otherwise(F.col("word"))).drop("modern", "rated")
    return out.groupBy(*[c for c in freqs.columns if c != "cnt"]).agg(F.sum("cnt").alias("cnt"))


def marked_language(freqs: DataFrame, keys: list[str], markers: list[str], least: float = 0.05) -> DataFrame:
    """Texts of which the marker words are at least this share."""
    share = F.sum(F.when(F.col("word").isin(*markers), F.col("cnt")).otherwise(0)) / F.sum("cnt")
    return freqs.groupBy(*keys).agg(share.alias("marker_share")).where(F.col("marker_share") >= least)


def long_enough(freqs: DataFrame, keys: list[str], least: int = 100) -> DataFrame:
    return freqs.groupBy(*keys).agg(F.sum("cnt").alias("n_words")).where(F.col("n_words") >= least)


def word_rows(texts: DataFrame, norms: DataFrame, on: list[str], keys: list[str], column: str) -> DataFrame:
    """One row for each word token: position among all tokens, z, and its class."""
    rows = texts.select(*keys, F.posexplode(T.tokens(F.lower("text"))).alias("position", "word")).where(T.starts_with_letter(F.col("word")))
    rows = rows.join(norms.select(*on, F.col(column).alias("z")), on, "left")
    return rows.withColumn("class", bins.word_class(F.col("z")))


def word_class_counts(texts: DataFrame, norms: DataFrame, on: list[str], keys: list[str], column: str) -> DataFrame:
    """Abstract, concrete and neutral words of a text; unrated words are neutral."""
    rows = word_rows(texts, norms, on, keys, column)
    count = lambda name: F.count_if(F.col("class") == name)
    return rows.groupBy(*keys).agg(count("Abstract").alias("n_abs"), count("Concrete").alias("n_conc"), count("Neither").alias("n_neutral"))


def chunks(texts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, chunk, text): every size white-space words, with the shorter rest."""
    split = F.split(F.trim("text"), r"\s+")
    starts = F.sequence(F.lit(0), F.greatest(F.size(split) - 1, F.lit(0)), F.lit(size))
    out = texts.select(*keys, split.alias("__w"), F.posexplode(starts).alias("chunk", "__s"))
    return out.select(*keys, "chunk", F.array_join(F.slice("__w", F.col("__s") + 1, size), " ").alias("text"))


def trajectories(texts: DataFrame, norms: DataFrame, on: list[str], keys: list[str], column: str, size: int) -> DataFrame:
    """Chunk scores, and the text's unweighted mean over its chunks. With a column frequent in norms these are broadcast (looked_up)."""
    part = [*keys, "chunk"]
    # tokens stay in their text's task, where their sums shrink to a row for each chunk
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
    pieces = F.get(F.transform(F.array(F.split(F.trim("text"), r"\s+")), cut), F.lit(0))  # an array of one binds the words to a name
    rows = texts.select(*keys, F.posexplode(pieces).alias("chunk", "__t")).select(*part, F.explode(T.words(F.col("__t"))).alias("word"))
    counts = rows.withColumn("cnt", F.lit(1))
    scores = weighted_means(counts, norms, on, part, [column])
    return scores.withColumn("text_mean", F.avg(column).over(Window.partitionBy(*keys)))


def period_score(scores: DataFrame, year: str, periods: list[tuple[int, int, str]], fallback: str) -> DataFrame:
    """The column of the year's period, or the fallback where that is null, with the name of what was taken."""
    value, label = F.lit(None).cast("double"), F.lit(None).cast("string")
    for lo, hi, c in periods:
        here = (F.col(year) >= lo) & (F.col(year) < hi) & F.col(c).isNotNull()
        value, label = F.when(here, F.col(c)).otherwise(value), F.when(here, F.lit(c)).otherwise(label)
    return scores.withColumn("period_score", F.coalesce(value, F.col(fallback))).withColumn("period_score_source", F.coalesce(label, F.lit(fallback)))


def version_means(scores: DataFrame, group: str, columns: list[str], primary: str) -> DataFrame:
    """Unweighted means over the versions of a work, their number, and the primary column's deviation (0 for one)."""
    return scores.groupBy(group).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n_versions"), F.coalesce(F.stddev_samp(primary), F.lit(0.0)).alias("score_sd"))


def score_maps(means: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, scores): the columns that aren't null as one map by name."""
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns)), lambda e: e["value"].isNotNull())
    return means.select(*keys, F.map_from_entries(entries).alias("scores"))
