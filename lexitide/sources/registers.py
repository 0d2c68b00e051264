"""First names out of registers: wide rows of dates and names, comma-separated lines, ranked columns by year.

All give (name, year) in one pass without a shuffle; tally() counts them by register. Null and unusable names and dates give no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: what surrounds a name, and what a name is made of
_AROUND = r"""^[,.;:'"\-]+|[,.;:'"\-]+$"""
_NAME = r"^[A-Za-zÀ-ÿ'\-]{3,}$"


def first_name(name: Column) -> Column:
    """The first word in lower case without punctuation around it; null unless it has three or more letters, apostrophes and hyphens."""
    word = F.regexp_replace(F.regexp_extract(name, r'^[\s"]*(\S+)', 1), _AROUND, "")
    return F.when(word.rlike(_NAME), F.lower(word))


def year_of(date: Column) -> Column:
    """The first four digits in a row; null without them."""
    return F.nullif(F.regexp_extract(date.cast("string"), r"(\d{4})", 1), F.lit("")).cast("int")


def wide(df: DataFrame, dates: dict[str, str], since: int, until: int) -> DataFrame:
    """(name, year) of the name columns, {name column: its date column}, dated from since to until."""
    cells = F.array(*(F.struct(first_name(F.col(name)).alias("name"), year_of(F.col(date)).alias("year")) for name, date in dates.items()))
    return df.select(F.inline(cells)).where(F.col("name").isNotNull() & F.col("year").between(since, until))


def lines(spark: SparkSession, path: str, until: int, name_at: int = 4, year_at: int = 2) -> DataFrame:
    """(name, year) of comma-separated lines that begin with a digit and reach the name's field; heads, notes and bad years go."""
    rows = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").rlike("^[0-9]")).select(F.split("line", ",").alias("v"))
    rows = rows.where(F.size("v") > max(name_at, year_at)).select(first_name(F.col("v")[name_at]).alias("name"), F.expr(f"try_cast(trim(v[{year_at}]) as int)").alias("year"))
    return rows.where(F.col("name").isNotNull() & (F.col("year") <= until))


def ranked(df: DataFrame, rank: str, until: int, most: int = 100) -> DataFrame:
    """(name, year) of the first ranks of columns named by years, whose cells are a name and a count in parentheses."""
    years = [c for c in df.columns if c.isdigit() and int(c) <= until]
    if not years:
        return df.limit(0).select(F.lit("").alias("name"), F.lit(0).alias("year"))
    tall = df.where(F.col(rank) <= most).select(F.inline(F.array(*(F.struct(F.col(f"`{c}`").cast("string").alias("cell"), F.lit(int(c)).alias("year")) for c in years))))
    return tall.select(first_name(F.regexp_extract("cell", r"^\s*([A-Za-z\- ]+?)\s*\(", 1)).alias("name"), "year").where("name is not null")


def tally(registers: dict[str, DataFrame], least: int = 1) -> DataFrame:
    """(name, n, n_registers, first_year, last_year) of the names that occur least times in {register: (name, year)}."""
    rows = reduce(DataFrame.unionByName, (df.select("name", "year").withColumn("register", F.lit(k)) for k, df in registers.items()))
    out = rows.groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("register").alias("n_registers"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return out.where(F.col("n") >= least)
