"""Tumbling windows of recognised tokens, and sentence-like folds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import text as T
from lexitide.operators.scoring import looked_up
from lexitide.runtime import Scratch, bound_batches


def token_rows(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.posexplode(T.tokens(F.col("text"))).alias("position", "token"))


def window_counts(texts: DataFrame, contrasts: DataFrame, keys: list[str], size: int, on: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Counts by windows of size recognised tokens, a window ending on the token that fills it.

    contrasts: [on,] contrast, word, band (neg, pos, neither); names are those of the contrasts, if they are known. A token is recognised if its lower-cased form is in the contrast.
    Trailing unrecognised tokens go to the next window, and a last short window stays only if it has a recognised
    token. With names, a column frequent in contrasts (scoring.frequent; a word stands once in a contrast) and without on, tokens stay in their text's row (_of_texts).
    Texts whose keys are repeated are counted as one, by rows of tokens (_of_tokens); their keys are found first."""
    if on or not names or "frequent" not in contrasts.columns:
        return _of_tokens(texts, contrasts, keys, size, on or [], names)
    again = texts.groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    again = Scratch(texts.sparkSession, "windows").save(again, "repeated")
    if again.isEmpty():
        return _of_texts(texts, contrasts, keys, size, names)
    same = _same(keys)
    alone, met = texts.join(again, same, "left_anti"), texts.join(again, same, "left_semi")
    return _of_texts(alone, contrasts, keys, size, names).unionByName(_of_tokens(met, contrasts, keys, size, [], names))


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))


def _of_texts(texts: DataFrame, contrasts: DataFrame, keys: list[str], size: int, names: list[str]) -> DataFrame:
    """Windows of texts with keys of their own. Tokens are split in the row and looked up there, a batch of texts at a time: none is shuffled.

    Frequent words are sent to all tasks (scoring.HEAD rows at most). The others are joined to the distinct words of a text, and what is found goes to the text."""
    spark = texts.sparkSession
    bound_batches(spark)
    own = contrasts.where(F.col("word").isNotNull() & F.col("band").isNotNull() & F.col("contrast").isin(*names)).withColumn("frequent", F.col("frequent") | _mark("word"))
    few, rest = (own.where(which).select("contrast", "word", "band") for which in ("frequent", "not frequent"))
    tokens, texts = T.tokens(F.col("text")), texts.select(*keys, "text")
    found = F.lit(None).cast(LISTED)
    if not rest.isEmpty():
        only = few.select("word").distinct().join(rest.select("word"), "word", "left_anti")
        words = texts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.explode(F.array_distinct(F.transform(tokens, F.lower))).alias("word")).where(~_mark("word"))
        met = words.join(F.broadcast(only), "word", "left_anti").join(rest, "word").groupBy(*(f"__{k}" for k in keys))
        texts = texts.join(met.agg(F.collect_list(F.struct("contrast", "word", "band")).alias("__found")), _same(keys), "left")
        found = F.col("__found")
    # an array of one binds the tokens to a name, so that they are split once for a row
    split = F.transform(F.array(F.coalesce(tokens, F.array().cast("array<string>"))), lambda w: F.struct(F.transform(w, F.lower).alias("word"), F.transform(w, T.starts_with_letter).alias("letter")))
    rows = texts.select(*keys, F.get(split, F.lit(0)).alias("__tokens"), found.alias("__found"))
    ordered, shared = sorted(set(names), key=str.encode), spark.sparkContext.broadcast(few.toArrow())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = {n: _listed(shared.value, n) for n in ordered}
        for b in batches:
            tokens, more = b.column("__tokens"), pa.table(pc.list_flatten(b.column("__found")).flatten(), ["contrast", "word", "band"])
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(tokens.field("word")).to_numpy())
            word, letter = tokens.field("word").flatten(), tokens.field("letter").flatten().to_numpy(zero_copy_only=False)
            slices = np.zeros(b.num_rows, np.int64)
            for name in ordered:
                (few, band), (rest, band_of_rest) = listed[name], _listed(more, name)
                place = pc.fill_null(pc.index_in(word, few), -1).to_numpy()
                if len(rest):
                    beyond = pc.fill_null(pc.index_in(word, rest), -1).to_numpy()
                    place, band = np.where((place < 0) & (beyond >= 0), beyond + len(few), place), np.concatenate([band, band_of_rest])
                at, window, counts = _windows(row, place, letter, band, size)
                first = np.searchsorted(at, at)  # of the windows of its text
                number = slices[at] + np.arange(len(at)) - first + 1
                slices += np.bincount(at, minlength=len(slices))
                columns = [b.column(k).take(pa.array(at)) for k in keys]
                columns += [pa.array([name] * len(at), pa.string()), pa.array(window, pa.int32()), *(pa.array(c, pa.int64()) for c in counts), pa.array(number, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "contrast", "window", *COUNTS, "slice"])

    of_keys = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(work, f"{of_keys}, contrast string, window int, {', '.join(f'{c} long' for c in COUNTS)}, slice int")


LISTED = "array<struct<contrast:string,word:string,band:string>>"
BANDS = ["neg", "pos", "neither"]
COUNTS = ["num_abs", "num_conc", "num_neither", "num_total", "num_words", "num_types"]


def _mark(word: str) -> Column:
    """One of the ten tokens that aren't words; nearly every text has them."""
    return F.col(word).rlike(r"^[.,!?; \-—–\n]$")


def _listed(words: pa.Table, contrast: str) -> tuple[pa.Array, np.ndarray]:
    """Words of a contrast, and the places of their bands in BANDS (others: behind them). A word that several texts have found is looked up at its first place."""
    own = words.filter(pc.equal(words["contrast"], contrast)).combine_chunks()
    return own["word"], pc.fill_null(pc.index_in(own["band"], pa.array(BANDS)), len(BANDS)).to_numpy()


def _windows(row: np.ndarray, place: np.ndarray, letter: np.ndarray, band: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row, number and COUNTS of the windows with a recognised token. Of each token, in order: its row, the place of its word among those that have a band (-1: none), whether it begins with a letter."""
    kept = letter | (place >= 0)  # other tokens, as spaces, are counted nowhere
    row, place, letter = row[kept], place[kept], letter[kept]
    known = place >= 0
    before = np.cumsum(known) - known
    window = (before - before[np.searchsorted(row, row)]) // size
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
    at, n = np.cumsum(new) - 1, int(new.sum())
    count = lambda which: np.bincount(at[which], minlength=n)
    of_band = np.bincount(at[known] * (len(BANDS) + 1) + band[place[known]], minlength=n * (len(BANDS) + 1)).reshape(n, len(BANDS) + 1).T[: len(BANDS)]
    types = np.bincount(np.unique(at[known] * max(len(band), 1) + place[known]) // max(len(band), 1), minlength=n)
    total = count(known)
    full = total > 0
    return row[new][full], window[new][full], [c[full] for c in (*of_band, total, count(letter), types)]


def _of_tokens(texts: DataFrame, contrasts: DataFrame, keys: list[str], size: int, on: list[str], names: list[str] | None) -> DataFrame:
    """Windows by rows of tokens. The order of tokens is kept inside a text only, so a window function by (text, contrast) does it; no text
    is larger than a row was."""
    rows = token_rows(texts, list(dict.fromkeys([*keys, *on]))).withColumn("word", F.lower("token"))
    if names:  # known: nothing is read for them
        rows = rows.withColumn("contrast", F.explode(F.array(*(F.lit(n) for n in names))) if len(names) > 1 else F.lit(names[0]))
    else:
        rows = rows.join(contrasts.select(*on, "contrast").distinct(), on) if on else rows.crossJoin(contrasts.select("contrast").distinct())  # a few contrasts for each key
    rows = looked_up(rows, contrasts, [*on, "contrast", "word"], "left")
    # other tokens, as spaces, are counted nowhere
    rows = rows.withColumn("__letter", T.starts_with_letter(F.col("token"))).where("band is not null or __letter").drop("token")
    seen = F.sum(F.when(F.col("band").isNotNull(), 1).otherwise(0))
    before = seen.over(Window.partitionBy(*keys, "contrast").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("window", F.floor(F.coalesce(before, F.lit(0)) / size).cast("int"))
    count = lambda band: F.count_if(F.col("band") == band)
    out = rows.groupBy(*keys, "contrast", "window").agg(
        count("neg").alias("num_abs"),
        count("pos").alias("num_conc"),
        count("neither").alias("num_neither"),
        F.count("band").alias("num_total"),
        F.count_if("__letter").alias("num_words"),
        F.countDistinct(F.when(F.col("band").isNotNull(), F.col("word"))).alias("num_types"),
    )
    out = out.where("num_total > 0")
    # slices are numbered on through the contrasts of a text
    return out.withColumn("slice", F.row_number().over(Window.partitionBy(*keys).orderBy("contrast", "window")))


def top_words(texts: DataFrame, contrasts: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k most frequent words of each band of a text, joined by commas; ties by word."""
    counted = looked_up(token_rows(texts, keys).withColumn("word", F.lower("token")).drop("token", "position"), contrasts, ["word"]).groupBy(*keys, "contrast", "band", "word").count()
    ranked = counted.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "contrast", "band").orderBy(F.desc("count"), "word")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), ",")
    return ranked.where(F.col("n") <= k).groupBy(*keys, "contrast", "band").agg(listed.alias("words"))


RUNS = "array<struct<start:int,n:int>>"


def _runs(sizes: pd.Series, least: pd.Series) -> pd.Series:
    """(start, number of sentences) of the runs whose sizes reach least."""

    def fold(own, enough):
        out, start, total = [], 0, 0
        for i, n in enumerate(own):
            total += n
            if total >= enough:
                out.append({"start": start + 1, "n": i + 1 - start})
                start, total = i + 1, 0
        return out

    return pd.Series([fold(s, n) if s is not None else None for s, n in zip(sizes, least)])


def sentences_of(texts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Runs of sentences joined until they have least words; a shorter tail is dropped. Ends at . ! ? and white space.

    Words are counted once for each sentence; only the counts are folded, in Python, as a fold by columns copies its state at every step."""
    parts = F.split(F.trim("text"), r"(?<=[.!?])\s+")
    sizes = F.transform(parts, lambda s: F.size(F.regexp_extract_all(s, F.lit(T.WORD), F.lit(0))))
    rows = texts.select(*keys, parts.alias("__p"), sizes.alias("__n")).withColumn("__r", F.pandas_udf(_runs, RUNS)("__n", F.lit(least)))
    joined = F.transform("__r", lambda r: F.trim(F.array_join(F.slice("__p", r["start"], r["n"]), " ")))
    return rows.select(*keys, F.posexplode(joined).alias("seq", "sentence"))


def fixed_groups(tokens: DataFrame, keys: list[str], size: int, keep_rest: bool = False) -> DataFrame:
    """(keys, part, words) of size tokens in order; the shorter rest only if asked for."""
    parts = tokens.withColumn("part", F.floor(F.col("position") / size)).groupBy(*keys, "part")
    out = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "word"))), lambda x: x["word"]).alias("words"))
    return out if keep_rest else out.where(F.size("words") == size)
