"""Word and passage vectors: axes, distances, pooling, training, reduced dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.operators.norms import with_zscores


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Element-wise means by key. Elements are rows of the aggregation, so sums shrink before the shuffle."""
    rows = df.select(*by, F.posexplode(vector).alias("__i", "__x")).groupBy(*by, "__i").agg(F.avg(F.col("__x").cast("double")).alias("__x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"])
    return rows.groupBy(*by).agg(listed.alias(vector))


def axes(vectors: DataFrame, poles: DataFrame, by: list[str], least: int = 1, unit: bool = False) -> DataFrame:
    """(by, contrast, axis): mean of the pos words' vectors less that of the neg words'. poles: contrast, word, band.

    A contrast needs at least so many words of each pole in a model. unit: of length one."""
    own = vectors.join(poles.where("band in ('pos', 'neg')"), "word")
    keys = [*by, "contrast", "band"]
    means = mean_vectors(own, keys, "vector").join(own.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least), keys)
    pick = lambda b: F.first(F.when(F.col("band") == b, F.col("vector")), ignorenulls=True)
    both = means.groupBy(*by, "contrast").agg(pick("pos").alias("p"), pick("neg").alias("n")).where("p is not null and n is not null")
    out = both.select(*by, "contrast", F.zip_with("p", "n", lambda x, y: x - y).alias("axis"))
    length = F.nullif(F.sqrt(dot(F.col("axis"), F.col("axis"))), F.lit(0.0))
    return out.withColumn("axis", F.transform("axis", lambda x: x / length)) if unit else out


def axis_scores(vectors: DataFrame, axes_: DataFrame, by: list[str]) -> DataFrame:
    """(by, contrast, word, z): cosine with the axis, standardised by model and contrast; words begin with a letter."""
    own = vectors.where(F.col("word").rlike(r"^\p{L}"))
    rows = own.join(axes_, by) if by else own.join(F.broadcast(axes_))  # without models one axis for each contrast
    rows = rows.select(*by, "contrast", "word", cosine(F.col("vector"), F.col("axis")).alias("score"))
    return with_zscores(rows, [*by, "contrast"], {"z": "score"})


def over_runs(scores: DataFrame) -> DataFrame:
    """Exact medians over runs, then over corpora. scores: corpus, period, run, contrast, word, z."""
    runs = scores.groupBy("corpus", "period", "contrast", "word").agg(F.median("z").alias("z"))
    return runs.groupBy("period", "contrast", "word").agg(F.median("z").alias("z"))


def centred(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    means = mean_vectors(df, by, vector).withColumnRenamed(vector, "__m")
    return df.join(means, by).withColumn(vector, F.zip_with(vector, "__m", lambda x, y: x.cast("double") - y)).drop("__m")


def reduced(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Principal components of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    rows = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(rows).transform(rows)
    rows = PCA(k=k, inputCol="__c", outputCol="__p").fit(rows).transform(rows)
    return rows.withColumn("components", vector_to_array("__p")).drop("__v", "__c", "__p")
