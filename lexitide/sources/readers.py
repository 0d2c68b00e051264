"""Readers of corpora: metadata, texts, frequency files, ratings, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.sources.sinks import exists

METADATA = "id string, author string, title string, year int, major_genre string"


def any_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, csv (gz), tsv, json or jsonl by suffix."""
    name = path.lower().removesuffix(".gz")
    if name.endswith((".csv", ".tsv", ".txt")):
        return spark.read.csv(path, header=True, sep="\t" if not name.endswith(".csv") else ",", multiLine=True, escape='"')
    if name.endswith(".jsonl"):
        return spark.read.json(path, mode="DROPMALFORMED")
    if name.endswith(".json"):
        return spark.read.json(path, multiLine=True)
    return spark.read.parquet(path)


def metadata(spark: SparkSession, path: str, schema: str = METADATA) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"')


def _relative_id(root: str, suffix: str):
    """The path below root without the suffix; ids may hold slashes."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.url_decode(F.input_file_name())
    return F.regexp_replace(F.substring_index(path, f"/{name}/", -1), f"{suffix}$", "")


def texts(spark: SparkSession, root: str) -> DataFrame:
    """(id, text) of plain or gz text files below root."""
    out = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt*").text(root, wholetext=True)
    return out.select(_relative_id(root, r"\.txt(\.gz)?").alias("id"), F.col("value").alias("text"))


def frequencies(spark: SparkSession, root: str) -> DataFrame:
    """(id, word, cnt) of JSON files {word: count}; a file that isn't such an object gives no rows."""
    out = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").text(root, wholetext=True)
    counts = F.from_json("value", T.MapType(T.StringType(), T.LongType()), {"mode": "PERMISSIVE"})
    return out.select(_relative_id(root, r"\.json(\.gz)?").alias("id"), F.explode(counts).alias("word", "cnt"))


def frequency_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, word, cnt) of tab-separated id, word, count lines: bad and non-positive counts go, duplicates are summed."""
    raw = spark.read.csv(path, sep="\t", schema="id string, word string, cnt string", quote="")
    return raw.withColumn("cnt", F.expr("try_cast(cnt as bigint)")).where("cnt > 0").groupBy("id", "word").agg(F.sum("cnt").alias("cnt"))


def fixed_width_ratings(spark: SparkSession, path: str, word: tuple[int, int], value: tuple[int, int], lo: int = 100, hi: int = 700) -> DataFrame:
    """(word, value) of fixed columns (start, length), null outside the scale; duplicates by their median."""
    line = spark.read.text(path).select(F.lower(F.trim(F.substring("value", *word))).alias("word"), F.trim(F.substring("value", *value)).alias("v"))
    rated = line.withColumn("v", F.expr("try_cast(v as double)")).withColumn("value", F.when(F.col("v").between(lo, hi), F.col("v")))
    return rated.where("word <> ''").groupBy("word").agg(F.median("value").alias("value"))


def ratings(df: DataFrame, word: str, value: str, order: str | None = None) -> DataFrame:
    """(word, value): lower, trimmed, not empty; of duplicates the first in order, or the smallest."""
    rows = df.select(F.lower(F.trim(word)).alias("word"), F.expr(f"try_cast(`{value}` as double)").alias("value"), *([F.col(order).alias("__o")] if order else []))
    rows = rows.where("word <> ''")
    return rows.groupBy("word").agg((F.min_by("value", "__o") if order else F.min("value")).alias("value"))


def pairs_file(spark: SparkSession, path: str) -> DataFrame:
    """(word, modern) of tab-separated lines; # comments and lines without a tab are skipped, the last duplicate counts."""
    # one file of a fixed size: the line number says what comes last
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id()).where("value not like '#%' and value like '%\t%'")
    parts = F.split("value", "\t", 2)
    return lines.select(F.trim(parts[0]).alias("word"), F.trim(parts[1]).alias("modern"), "n").groupBy("word").agg(F.max_by("modern", "n").alias("modern"))


def score_files(spark: SparkSession, glob: str) -> DataFrame:
    """All score csv files of a pattern with the corpus from the file name; missing columns are null."""
    out = spark.read.csv(glob, header=True, inferSchema=True, enforceSchema=False)
    return out.withColumn("corpus", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.csv(?:\.gz)?$", 1))


def count_records(spark: SparkSession, path: str) -> DataFrame:
    """(id, norm, bin, cnt) of JSON lines {id, norm: {upper edge: count}}; bad lines are skipped, edges become tenths."""
    raw = spark.read.text(path).select(F.get_json_object("value", "$.id").alias("id"), F.from_json("value", "map<string,string>").alias("m")).where("id is not null")
    rows = raw.select("id", F.explode("m").alias("norm", "v")).where("norm <> 'id'")
    rows = rows.select("id", "norm", F.explode(F.from_json("v", "map<string,double>")).alias("edge", "cnt"))
    return rows.select("id", "norm", F.round(F.expr("try_cast(edge as double)") * 10).cast("int").alias("bin"), F.round("cnt").cast("long").alias("cnt"))


def skipgram_lines(spark: SparkSession, path: str, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(words) of white-space separated lines, optionally a seeded sample."""
    lines = spark.read.text(path)
    lines = lines.sample(share, seed) if share < 1 else lines
    return lines.select(F.split(F.trim("value"), r"\s+").alias("words"))


def model_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """corpus, period and run of .../corpus/period/run_NN paths."""
    part = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)/run_(\d+)/?[^/]*$", k)
    return df.withColumn("corpus", part(1)).withColumn("period", part(2)).withColumn("run", F.nullif(part(3), F.lit("")).cast("int"))


def corpus_scores(spark: SparkSession, root: str, corpus: str, parents: dict[str, str] | None = None) -> DataFrame:
    """root/corpus.csv, or that of the parent whose prefix the corpus has; FileNotFoundError if there is neither."""
    for name in [corpus, *(p for prefix, p in (parents or {}).items() if corpus.startswith(prefix))]:
        if exists(spark, path := f"{root.rstrip('/')}/{name}.csv"):
            return spark.read.csv(path, header=True, inferSchema=True)
    raise FileNotFoundError(f"no scores of {corpus} below {root}")


def word_set(spark: SparkSession, *paths: str) -> DataFrame:
    """(word) of the lists' lines, trimmed, lower, once each: stop words, names or both."""
    return spark.read.text(list(paths)).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def frequent(vectors: DataFrame, least: int, count: str = "count") -> DataFrame:
    """A model's words with at least so many occurrences."""
    return vectors.where(F.col(count) >= least)


def with_ids(scores: DataFrame, ids: DataFrame | None = None, key: str = "_id") -> DataFrame:
    """Scores of the wanted ids, or all."""
    return scores if ids is None else scores.join(ids.select(key), key, "left_semi")


def resolved(metadata: DataFrame, wanted: str, *order: str, key: str = "id") -> DataFrame:
    """The first row, in a stated order, whose id holds the wanted one literally; none if no id does."""
    return metadata.where(F.col(key).cast("string").contains(wanted)).orderBy(*(order or (key,))).limit(1)
