"""Genres, languages and flags from metadata, as column expressions. Dictionaries and lists are small parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def looked_up(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key] if values else F.lit(None).cast("string")


def title_keyword(title: Column, keywords: dict[str, str]) -> Column:
    """The genre of the first keyword, in their order, with which a word of the title begins."""
    own = F.split(F.lower(title), r"[^\p{L}]+")
    begins = lambda k: F.exists(own, lambda t: t.startswith(k))
    return F.coalesce(*(F.when(begins(k), F.lit(genre)) for k, genre in keywords.items()), F.lit(None).cast("string"))


def harmonised_genre(corpus: Column, raw: Column, title: Column, by_corpus: dict[str, str], by_genre: dict[str, str], by_title: dict[str, str]) -> Column:
    """The corpus's own genre, else the row's mapped one, else the row's, else one from the title, else empty."""
    own = F.nullif(F.trim(raw), F.lit(""))
    return F.coalesce(looked_up(corpus, by_corpus), looked_up(own, by_genre), own, title_keyword(title, by_title), F.lit(""))


def first_specific(raw: Column, general: str = "Fiction", pattern: str = "[|,]") -> Column:
    """Of the separated parts the first that isn't the general one, else the first."""
    parts = F.filter(F.transform(F.split(raw, pattern), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.get(F.filter(parts, lambda p: p != general), F.lit(0)), F.get(parts, F.lit(0)))


def mentions(words: list[str], *fields: Column) -> Column:
    """Whether any field holds any of the words, whatever the case; nulls hold nothing."""
    own = F.lower(F.concat_ws(" ", *fields))
    out = F.lit(False)
    for w in words:
        out = out | own.contains(w.lower())
    return out


def resolved_language(explicit: Column, metadata: Column, default: Column, allowed: list[str], last: str = "en") -> Column:
    """The first allowed one of: what was asked for, the metadata, the corpus's default, the last resort."""
    return F.coalesce(*(F.when(F.lower(c).isin(allowed), F.lower(c)) for c in (explicit, metadata, default)), F.lit(last))


def decile(position: Column) -> Column:
    """Positions 0 to 1 in tenths; halves go to the even tenth."""
    return F.bround(position * 10) / 10
