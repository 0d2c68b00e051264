"""Writers that can be resumed: what is done is found by an anti-join, not by reading files on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def check_schema(have: StructType, new: StructType) -> None:
    """Raises ValueError if names or types differ."""
    a, b = ([(f.name, f.dataType.simpleString()) for f in s.fields] for s in (have, new))
    if a != b:
        raise ValueError(f"the stored columns {a} aren't those to be written {b}")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table at path lacks; df's own keys are made unique (the row whose JSON sorts first)."""
    spark = df.sparkSession
    if exists(spark, path):
        have = spark.read.parquet(path)
        check_schema(have.schema, df.schema)
        df = df.join(have.select(*keys), keys, "left_anti")
    row = F.struct(*df.columns)
    first = df.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")  # the same row in every run
    first.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that new doesn't replace, and the new ones; columns may differ."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merged_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Long histogram records: the norms that new has for an id replace the old ones."""
    return old.join(new.select("id", "norm").distinct(), ["id", "norm"], "left_anti").unionByName(new)


def as_records(hist: DataFrame) -> DataFrame:
    """(id, norm -> {bin: count}) for export as JSON lines."""
    bins = hist.groupBy("id", "norm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("bin").cast("string"), "cnt")))).alias("bins"))
    return bins.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("norm", F.to_json("bins"))))).alias("norms"))


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True, compression="gzip" if path.endswith("gz") else None)


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are left out."""
    df.write.mode("overwrite").json(path, compression="gzip" if path.endswith("gz") else None)


def word_list(df: DataFrame, path: str) -> None:
    df.select("word").distinct().orderBy("word").write.mode("overwrite").text(path)


def stacked(passages: DataFrame, key: str, order: str, size: int = 100) -> DataFrame:
    """Markdown of size passages for each file number; numbers go on through key's order, equal ones share a file.

    Places come from sorted ranges, so a key with all passages isn't one task."""
    from lexitide.operators.order import places

    at = places(passages, [key], [order]).select(F.col(key).alias("__key"), F.col(order).alias("__order"), F.floor((F.col("__last") - F.col("__n")) / size).alias("file"))
    rows = passages.join(at, F.col(key).eqNullSafe(F.col("__key")) & F.col(order).eqNullSafe(F.col("__order"))).drop("__key", "__order")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: F.concat(F.lit("## "), x[order].cast("string"), F.lit("\n\n"), x["text"])), "\n\n")
    return rows.groupBy(key, "file").agg(body.alias("markdown"))


def save(df: DataFrame, path: str) -> None:
    """Writes by the path's ending: .parquet, .orc, .csv, .tsv, .json, .jsonl or .txt (one string column), the text ones also with .gz."""
    plain = path.removesuffix(".gz")
    packed = "gzip" if path.endswith(".gz") else None
    ending, out = plain.rsplit(".", 1)[-1], df.write.mode("overwrite")
    if ending in ("parquet", "orc") and not packed:
        out.format(ending).save(path)
    elif ending in ("csv", "tsv"):
        out.csv(path, header=True, sep="," if ending == "csv" else "\t", compression=packed)
    elif ending in ("json", "jsonl"):
        out.json(path, compression=packed)
    elif ending == "txt":
        out.text(path, compression=packed)
    else:
        raise ValueError(f"no format for {path}")
