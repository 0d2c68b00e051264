"""Who says what: words of quotations and descriptors of characters, scored by the period of their text.

Quotations are ranges of tokens of a text, which may nest and overlap. They are indexed by slices of SLICE tokens, so a
token meets only the quotations of its own slice, by an equal join, and a long text is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 256

#: Fixed: part-of-speech tags of words that aren't scored.
SKIPPED_TAGS = ["DT", "IN", "CC", "TO", "PRP", "PRP$", "WP", "WP$", "WDT", "WRB", "MD", "EX", "PDT", "RP", "UH", ".", ",", ":", "``", "''", "-LRB-", "-RRB-", "CD", "SYM", "LS", "FW", "XX"]


def period_value(year: Column, periods: list[tuple[int, int, str]], rest: str) -> Column:
    """The column of the period (first year, year after, column) that the year falls in, else rest; also where that column is null."""
    out = F.lit(None).cast("double")
    for lo, hi, name in periods:
        out = F.when((year >= lo) & (year < hi), F.col(name)).otherwise(out)
    return F.coalesce(out, F.col(rest))


def attributed(tokens: DataFrame, quotations: DataFrame, text: str, innermost: bool = True) -> DataFrame:
    """tokens (text, position, ...) with quote and speaker of each quotation (text, quote, speaker, first, last) that holds them, ends included.

    innermost: only the shortest such quotation; of equal ones that which begins last, then the smaller quote. Tokens outside are left out, and
    quotations without a speaker, or whose last token stands before the first, hold none."""
    own = quotations.where("speaker is not null and first <= last").select(F.col(text).alias("__t"), "quote", "speaker", "first", "last")
    own = own.withColumn("__s", F.explode(F.sequence(F.floor(F.col("first") / SLICE), F.floor(F.col("last") / SLICE))))
    here = (F.col(text) == F.col("__t")) & (F.floor(F.col("position") / SLICE) == F.col("__s")) & F.col("position").between(F.col("first"), F.col("last"))
    met = tokens.join(own, here)
    if not innermost:
        return met.select(*tokens.columns, "quote", "speaker")
    order = F.struct(F.col("last") - F.col("first"), -F.col("first"), "quote")
    others = [c for c in tokens.columns if c not in (text, "position")]
    best = met.groupBy(text, "position").agg(F.min_by(F.struct(*others, "quote", "speaker"), order).alias("__b"))
    return best.select(text, "position", "__b.*").select(*tokens.columns, "quote", "speaker")


def quote_scores(tokens: DataFrame, quotations: DataFrame, norms: DataFrame, text: str, value: Column, innermost: bool = True) -> DataFrame:
    """(text, quote, speaker, n, mean) of the rated words of each quotation; quotations without any are left out.

    tokens: text, position, word, tag, and what value needs besides norms' columns (word, ...), such as the year. Tags of SKIPPED_TAGS don't count."""
    kept = tokens.where(F.col("tag").isNull() | ~F.col("tag").isin(SKIPPED_TAGS))
    words = attributed(kept.withColumn("word", F.lower("word")), quotations, text, innermost)
    scored = words.join(norms, "word").withColumn("__v", value).where("__v is not null")
    return scored.groupBy(text, "quote", "speaker").agg(F.count("*").alias("n"), F.avg("__v").alias("mean"))


def descriptor_scores(descriptors: DataFrame, characters: DataFrame, norms: DataFrame, text: str, value: Column) -> DataFrame:
    """(text, name, role, n, n_rated, mean): descriptors (text, character, role, word, ...) of the named characters (text, character, name), by role.

    The role (all) stands for all of them."""
    own = descriptors.withColumn("word", F.lower("word")).join(characters.where("name is not null").select(text, "character", "name"), [text, "character"])
    scored = own.join(norms, "word", "left").withColumn("__v", value)
    scored = scored.withColumn("role", F.explode(F.array("role", F.lit("(all)"))))
    return scored.groupBy(text, "name", "role").agg(F.count("*").alias("n"), F.count("__v").alias("n_rated"), F.avg("__v").alias("mean"))
