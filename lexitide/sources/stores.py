"""Stores that carry a version: score caches, catalog tables, the views behind a service, sampled lines for training."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators import counting, records
from lexitide.sources.sinks import exists


def _folder(path: str, labels: dict[str, str]) -> str:
    for k, v in labels.items():
        if not re.fullmatch(r"[\w.-]+", f"{k}{v}"):
            raise ValueError(f"not fit for a folder's name: {k}={v}")
    return "/".join([path.rstrip("/"), *(f"{k}={v}" for k, v in labels.items())])


def write_version(df: DataFrame, path: str, **labels: str) -> None:
    """Replaces what is stored under these labels (e.g. modernised, norms); other versions stay."""
    df.write.mode("overwrite").parquet(_folder(path, labels))


def read_version(spark: SparkSession, path: str, schema: str, **labels: str) -> DataFrame:
    """What is stored under just these labels; no rows if nothing is, so scores of other norms are never served."""
    at = _folder(path, labels)
    return spark.read.schema(schema).parquet(at) if exists(spark, f"{at}/_SUCCESS") else spark.createDataFrame([], schema)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], **labels: str) -> DataFrame:
    """The stored rows of these labels, else make()'s, stored first. A write that didn't end counts as none."""
    at = _folder(path, labels)
    if not exists(spark, f"{at}/_SUCCESS"):
        write_version(make(), path, **labels)
    return spark.read.parquet(at)


def create_table(spark: SparkSession, name: str, columns: list[str], drop: bool = False) -> None:
    """An empty table (_id string, columns float) unless there is one."""
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (_id STRING, {', '.join(f'`{c}` FLOAT' for c in columns)}) USING parquet")


def insert_by_name(df: DataFrame, name: str) -> None:
    """Appends to a table by its columns' names; what df lacks is null, what the table lacks is refused."""
    want = df.sparkSession.table(name).schema
    if extra := set(df.columns) - set(want.names):
        raise ValueError(f"{name} has no columns {sorted(extra)}")
    df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want)).write.insertInto(name)


def upload_norms(norms: DataFrame, name: str, drop: bool = False) -> bool:
    """A table of one row for each word (of repeated ones that whose JSON sorts first); False if one of as many words is there."""
    spark, row = norms.sparkSession, F.struct(*(f"`{c}`" for c in norms.columns))
    values = [F.col(f"`{c}`").cast("float").alias(c) if t == "double" else F.col(f"`{c}`") for c, t in norms.dtypes]
    words = norms.where("word is not null").groupBy("word").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*").select(*values)
    if drop:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if spark.catalog.tableExists(name) and spark.table(name).count() == norms.where("word is not null").select("word").distinct().count():
        return False
    words.write.mode("overwrite").saveAsTable(name)
    return True


def language_pruned(scores: DataFrame, texts: DataFrame, languages: DataFrame) -> DataFrame:
    """scores less the texts whose known language isn't that of their arc (languages: arc_corpus, lang); others stay."""
    wrong = scores.select("_id", "arc_corpus").join(languages.select("arc_corpus", F.col("lang").alias("__own")), "arc_corpus")
    wrong = wrong.join(texts.where("lang is not null").select("_id", "lang"), "_id").where("lang <> __own").select("_id", "arc_corpus").distinct()
    return scores.join(wrong, ["_id", "arc_corpus"], "left_anti")


def serve(scores: dict[str, DataFrame], texts: DataFrame, languages: DataFrame) -> dict[str, DataFrame]:
    """Views {name} and {name}_texts: pruned scores, and these with their metadata (corpus falls back to the source)."""
    views = {}
    for name, df in scores.items():
        views[name] = language_pruned(df, texts, languages)
        views[f"{name}_texts"] = records.with_metadata(views[name].withColumnRenamed("source_corpus", "source"), texts)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def training_lines(texts: DataFrame, length: int = 100, years: tuple = (None, None), least: int = 10, size: int | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """(corpus, period, line) of texts (_id, corpus, year, text): runs of sentences of least words, or groups of size words.

    With most, so many lines of each corpus and period, by a seeded hash. Texts without a year have no lines."""
    start = F.floor(F.col("year") / length) * length
    rows = texts.where("year is not null").withColumn("period", F.concat_ws("-", start, start + length))
    for bound, keep in zip(years, ("year >= {}", "year < {}")):
        rows = rows if bound is None else rows.where(keep.format(int(bound)))
    keys = ["corpus", "period", "_id"]
    if size:
        tokens = rows.select(*keys, F.posexplode(T.words(F.col("text"))).alias("position", "word"))
        lines = counting.fixed_groups(tokens, keys, size).select(*keys, F.col("part").alias("seq"), F.array_join("words", " ").alias("line"))
    else:
        lines = counting.sentences_of(rows, keys, least).select(*keys, "seq", F.array_join(T.words(F.col("sentence")), " ").alias("line"))
    if most is not None:
        lines = records.exact_sample(lines.withColumn("__key", F.concat_ws("|", "_id", "seq")), "__key", most, seed, ["corpus", "period"])
    return lines.select("corpus", "period", "line")


def write_training_lines(lines: DataFrame, path: str) -> None:
    """Gzipped text by corpus and period; those that are there already aren't written again."""
    spark = lines.sparkSession
    if exists(spark, path):
        done = spark.read.schema("value string, corpus string, period string").text(path).select("corpus", "period").distinct()
        lines = lines.join(done, ["corpus", "period"], "left_anti")
    lines.write.mode("append").partitionBy("corpus", "period").text(path, compression="gzip")
