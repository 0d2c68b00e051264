"""Bins, bands and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_start(year: Column, size: int) -> Column:
    """Mathematical floor: -5 in bins of 10 starts at -10."""
    return (F.floor(year / size) * size).cast("int")


def passage_period(year: Column, size: int = 100, first: int = 1500) -> Column:
    return F.when(year >= first, bin_start(year, size)).when(year.isNotNull(), first - size)


def z_band(z: Column, cut: float = 1.0) -> Column:
    """Here positive is Abs, unlike the scores."""
    return F.when(z >= cut, "Abs").when(z <= -cut, "Conc").otherwise("Neither")


def word_class(z: Column, cut: float = 1.0) -> Column:
    """Scores: negative is abstract; both ends inclusive; null is Neither."""
    return F.when(z >= cut, "Concrete").when(z <= -cut, "Abstract").otherwise("Neither")


def labelled_periods(year: Column, edges: list[int]) -> Column:
    """lo-(hi-1) for lo <= year < hi, else null."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((year >= lo) & (year < hi), f"{lo}-{hi - 1}").otherwise(out)
    return out


def cut_right(value: Column, edges: list[float], labels: list[str], rest: str | None = None) -> Column:
    """labels[i] for edges[i] < value <= edges[i + 1], else rest."""
    out = F.lit(rest).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def length_class(n_words: Column) -> Column:
    top = float("inf")
    edges, labels = [0, 10_000, 30_000, 80_000, 150_000, top], ["<10k", "10-30k", "30-80k", "80-150k", ">150k"]
    return cut_right(F.coalesce(n_words, F.lit(0)).cast("double"), edges, labels, "nan")


def century_label(year: Column, first: int = 16, last: int = 20) -> Column:
    """C16 for 1500-1599; years before and after go to the first and the last."""
    century = F.greatest(F.least(F.floor(year / 100) + 1, F.lit(last)), F.lit(first))
    return F.when(year.isNotNull(), F.concat(F.lit("C"), century.cast("string")))


def half_century_label(year: Column) -> Column:
    century = (F.floor(year / 100) + 1).cast("string")
    return F.concat(F.lit("C"), century, F.when(F.pmod(year, F.lit(100)) < 50, "e").otherwise("l"))


def compressed_year(year: Column, knee: int = 1600, factor: float = 0.25) -> Column:
    """Years before the knee move closer to it."""
    return F.when(year < knee, knee - (knee - year) * factor).otherwise(year.cast("double"))


def productivity(n: Column) -> Column:
    return F.when(n >= 10, "prolific").when(n >= 3, "moderate").otherwise("single")


def gender(meta: Column) -> Column:
    value = F.lower(F.rtrim(F.get_json_object(meta, "$.gender"), F.lit(".")))
    return F.when(value.isin("m", "male", "man"), "male").when(value.isin("f", "female", "woman"), "female")


def histogram_bin(z: Column) -> Column:
    """Upper edge of the 0.1-wide bin in [-3, 3], in tenths; the last bin is closed; null outside."""
    tenth = F.floor(F.round(z * 10, 9)).cast("int") + 1
    return F.when((z >= -3) & (z < 3), tenth).when(z == 3, 30)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def same_sign_ratio(a: Column, b: Column) -> Column:
    return F.when(a * b > 0, a / b)
