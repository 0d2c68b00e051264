"""Words over time: decade counts, trends, contributions, shifts of rating. All in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.bins import bin_start
from lexitide.functions.numeric import correlation
from lexitide.functions.text import only_letters


def by_decade(freqs: DataFrame, size: int = 10) -> DataFrame:
    """(decade, word, cnt) of lower-cased words of letters."""
    return freqs.withColumn("word", F.lower("word")).where(only_letters(F.col("word"))).groupBy(bin_start(F.col("year"), size).alias("decade"), "word").agg(F.sum("cnt").alias("cnt"))


def most_frequent(decades: DataFrame, top: int) -> DataFrame:
    """Rows of the top words by total, ties by word. decades is read twice."""
    best = decades.groupBy("word").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "word").limit(top).select("word")
    return decades.join(best, "word", "left_semi")


def by_decade_of_most_frequent(freqs: DataFrame, top: int, size: int = 10) -> DataFrame:
    """most_frequent of by_decade: the top words are found first and broadcast, so only their counts by decade are shuffled. freqs is read twice."""
    own = freqs.select("year", F.lower("word").alias("word"), "cnt").where(only_letters(F.col("word")))
    best = own.groupBy("word").agg(F.sum("cnt").alias("n")).orderBy(F.desc("n"), "word").limit(top).select("word")
    return own.join(F.broadcast(best), "word", "left_semi").groupBy(bin_start(F.col("year"), size).alias("decade"), "word").agg(F.sum("cnt").alias("cnt"))


def added(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("decade", "word").agg(F.sum("cnt").alias("cnt"))


def shares(decades: DataFrame, norms: DataFrame, least: int = 1) -> DataFrame:
    """(decade, word, z, p): shares among the rated, frequent words of the decade, zeros included."""
    kept = decades.join(norms.select("word", "z").where("z is not null"), "word")
    kept = kept.withColumn("n", F.sum("cnt").over(Window.partitionBy("word"))).where(F.col("n") >= least)
    total = kept.groupBy("decade").agg(F.sum("cnt").alias("__all"))  # few rows; a window would put a decade's words in one task
    share = kept.join(F.broadcast(total), "decade").withColumn("p", F.col("cnt") / F.col("__all"))
    by_word = share.groupBy("word", "z").agg(F.map_from_entries(F.collect_list(F.struct("decade", "p"))).alias("p"))
    every = kept.select("decade").distinct().agg(F.array_sort(F.collect_list("decade")).alias("decades"))  # as many as decades
    filled = by_word.join(F.broadcast(every)).select("word", "z", "p", F.explode("decades").alias("decade"))
    return filled.select("decade", "word", "z", F.coalesce(F.col("p")[F.col("decade")], F.lit(0.0)).alias("p"))


def trends(share: DataFrame) -> DataFrame:
    """Each word's Pearson correlation with the overall score of the decades; null for a constant word."""
    score = share.groupBy("decade").agg(F.sum(F.col("p") * F.col("z")).alias("score"))
    return share.join(F.broadcast(score), "decade").groupBy("word", "z").agg(correlation(F.col("p"), F.col("score")).alias("r"), F.avg("p").alias("mean_p"))


def contributions(share: DataFrame, early: tuple[int, int], late: tuple[int, int]) -> DataFrame:
    """(p_late - p_early) x z; a period's share is the mean of its decades' shares."""
    mean = lambda span: F.coalesce(F.avg(F.when((F.col("decade") >= span[0]) & (F.col("decade") <= span[1]), F.col("p"))), F.lit(0.0))
    out = share.groupBy("word", "z").agg(mean(early).alias("p_early"), mean(late).alias("p_late"))
    change = F.col("p_late") - F.col("p_early")
    return out.withColumn("contribution", change * F.col("z")).withColumn("freq_change_pct", F.when(F.col("p_early") > 0, change / F.col("p_early") * 100))


def shifts(norms: DataFrame, periods: list[str], least: int) -> DataFrame:
    """Change from the first to the last period that a word is rated in, with its values by period."""
    values = F.filter(F.array(*(F.struct(F.lit(p).alias("period"), F.col(p).alias("z")) for p in periods)), lambda x: x["z"].isNotNull())
    out = norms.select("word", values.alias("v")).where(F.size("v") >= max(least, 1))
    first, last = F.element_at("v", 1), F.element_at("v", -1)
    return out.select("word", F.size("v").alias("n_periods"), first["z"].alias("first_z"), last["z"].alias("last_z"), (last["z"] - first["z"]).alias("shift"), F.map_from_entries("v").alias("trajectory"))
