"""Rating tables: word -> z-scores by source and period, long and wide, and the contrasts built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.bins import word_class
from lexitide.functions.numeric import correlation
from lexitide.functions.pvalues import pearson_p


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing everywhere here; an average over NaN would be NaN."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def with_zscores(df: DataFrame, by: list[str], columns: dict[str, str], digits: int | None = None) -> DataFrame:
    """df with z-scores, {name: value column}, by the population's standard deviation of each group of by; null if that is 0.

    Means and deviations are an aggregate of a few rows joined back: a window would put a whole language into one task.
    df is read twice, so it should be a saved table where it is dear."""
    stats = [f(F.col(v).cast("double")).alias(f"__{s}_{name}") for name, v in columns.items() for s, f in (("m", F.avg), ("s", F.stddev_pop))]
    if by:
        keys = {k: f"__by_{k}" for k in by}
        few = df.groupBy(*(F.col(k).alias(x) for k, x in keys.items())).agg(*stats)
        both = df.join(few, [df[k].eqNullSafe(few[x]) for k, x in keys.items()], "left")
    else:
        both = df.join(F.broadcast(df.agg(*stats)))  # one row
    z = {name: (F.col(v) - F.col(f"__m_{name}")) / F.nullif(F.col(f"__s_{name}"), F.lit(0.0)) for name, v in columns.items()}
    return both.select(*(df[c] for c in df.columns), *((F.round(c, digits) if digits is not None else c).alias(name) for name, c in z.items()))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a stated order."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def rate(ratings: DataFrame, keys: list[str], source: str, value: str) -> DataFrame:
    """Long ratings with z by source and the other keys but the word: duplicates are averaged by their median."""
    own = ratings.groupBy(*keys, "word", source).agg(F.median(value).alias("value"))
    return with_zscores(own, [*keys, source], {"z": "value"})


def row_median(*columns: Column) -> Column:
    """Median of the values that aren't null."""
    kept = F.sort_array(F.filter(F.array(*columns), lambda x: x.isNotNull()))
    n = F.size(kept)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(kept, low) + F.get(kept, high)) / 2)


def wide(norms_long: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One column for each name; of duplicates the smallest, as files give no order."""
    return norms_long.groupBy(*keys).pivot(name, names).agg(F.min(value))


def long(norms: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return norms.unpivot(keys, columns, "norm", "z").where("z is not null")


def combined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Parts with different columns joined on the word; a word needs to be in one only."""
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def without(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose lower-cased word isn't in excluded (word)."""
    names = excluded.select(F.lower("word").alias("__x")).distinct()
    return df.join(names, F.lower(df["word"]) == F.col("__x"), "left_anti")


def fields(norms_long: DataFrame, cut: float = 1.0) -> DataFrame:
    """Words of each norm by band: the contrast's two poles and what lies between."""
    return norms_long.withColumn("band", word_class(F.col("z"), cut))


def united(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(word, value) of base, and of extra for the words base lacks: one population for the z-scores."""
    return base.where("value is not null").select("word", "value").unionAll(extra.where("value is not null").select("word", "value").join(base.where("value is not null").select("word"), "word", "left_anti"))


def row_mean(*columns: Column) -> Column:
    """Mean of the values that aren't null."""
    kept = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def originals(sources: dict[str, DataFrame], flipped: list[str] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Ratings of one language, {source: (word, value)}, as a z-score for each source and their median.

    Flipped sources rate the other way round. Repeated words of a source keep the smallest value. Excluded words go after the z-scores."""
    parts = [df.where("value is not null").groupBy("word").agg(F.min((-F.col("value") if name in (flipped or []) else F.col("value")).cast("double")).alias("value")).withColumn("source", F.lit(name)) for name, df in sources.items()]
    z = with_zscores(reduce(DataFrame.unionByName, parts), ["source"], {"z": "value"})
    out = wide(z, ["word"], "source", "z", list(sources))
    out = out if excluded is None else without(out, excluded)
    return out.withColumn("median", row_median(*(F.col(f"`{c}`") for c in sources)))


def information(counts: DataFrame) -> DataFrame:
    """(word, ic): -log2 of the word's share, median over models in a century, then over centuries.

    counts: model, century, word, n."""
    total = counts.groupBy("model").agg(F.sum("n").alias("__all"))  # a window would put a whole model in one task
    by_century = counts.join(total, "model").withColumn("ic", F.log2(F.col("__all") / F.col("n"))).groupBy("century", "word").agg(F.median("ic").alias("ic"))
    return by_century.groupBy("word").agg(F.median("ic").alias("ic"))


def correlations(norms: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson's r, the number of complete rows and the two-sided p for each pair a < b of columns."""
    pairs = [(a, b) for i, a in enumerate(sorted(columns)) for b in sorted(columns)[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), correlation(F.col(a), F.col(b)).alias("r"), F.count_if(both(a, b)).alias("n")) for a, b in pairs]
    return norms.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).withColumn("p", pearson_p(F.col("r"), F.col("n")))


def fingerprint(norms_long: DataFrame) -> DataFrame:
    """One row: a version digest that doesn't depend on row order, and the number of rows.

    Rows are strings of their columns, nulls left out, joined by |; the first 13 hexadecimal digits of their MD5 are summed."""
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in norms_long.columns))), 1, 13), 16, 10).cast("decimal(38,0)")
    return norms_long.agg(F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.coalesce(F.sum(digits), F.lit(0)).cast("string")), 256), 1, 12).alias("version"), F.count("*").alias("n"))
