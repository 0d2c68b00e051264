"""Sentence boundaries learned from the texts themselves, without a list of abbreviations (Kiss and Strunk, 2006).

Training counts types in Spark: how often a type ends in a period, what follows it, and how the type is written. Log-likelihood ratios tell
abbreviations from words that happen to end sentences, pairs that stand together across a period, and words that often begin
sentences. The result is a table, (first, second, breaks), of pairs around a period; texts look their own pairs up by a join. So neither counts nor
results pass through the driver, and the vocabulary may be of any size.

A piece is a run of characters other than white space and the white space behind it; a text is the sum of its pieces, and sentences are runs of pieces,
so they add up to the text exactly. ! and ? end a sentence; so does a period, unless the pair's row says no.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.runtime import Scratch, bound_batches, find_package

#: Fixed thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Opening and closing marks around a token, and what Java's $ lets follow the end.
OPEN, CLOSE, LATER = "\"'([{«“‘„—-", "\"')]}»”’", ("\u0085", "\u2028", "\u2029")

PIECE, WHITE = r"\s*\S+\s*", " \t\n\x0b\f\r"
#: A part of a text up to the white space behind a piece that has a full stop or a mark, or the rest.
PART = r"[^.!?]*+[.!?]\S*\s*|[^.!?]+"
OWN_PART, BLANKS = re.compile("[^.!?]*+[.!?][^ ]*+ *+|[^.!?]+"), str.maketrans(dict.fromkeys("\t\n\x0b\f\r", " "))
#: Tokens whose pairs are counted at a time, about, and rows of a batch of pairs.
PLACES, BATCH = 1 << 21, 10_000
#: Tokens whose form a task remembers.
KEPT = 1 << 19
NUMBER = re.compile("[0-9][0-9.,]*[\x85\u2028\u2029]?")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def tokens(text: Column) -> Column:
    """The pieces without their white space."""
    return bound(F.btrim(text, F.lit(WHITE)), lambda own: F.when(own == "", F.array().cast("array<string>")).otherwise(F.split(own, r"\s+")))


# Tokens are many, so their form is told without patterns where plain comparisons do: bytes of UTF-8 compare as characters do.


def _ends_late(token: Column) -> Column:
    return token.endswith(LATER[0]) | token.endswith(LATER[1]) | token.endswith(LATER[2])


def core(token: Column) -> Column:
    """The token without marks around it; of closing marks alone the first stays."""
    plain = F.regexp_replace(token, f"^[{_listed(OPEN)}]*|[{_listed(CLOSE)}]*$", "")
    opened = F.rtrim(F.ltrim(token, F.lit(OPEN)), F.lit(CLOSE))
    closed = bound(F.rtrim(token, F.lit(CLOSE)), lambda own: F.when(own == "", F.left(token, F.lit(1))).otherwise(own))
    first = F.left(token, F.lit(1))
    return F.when(_ends_late(token), plain).when(F.lit(OPEN).contains(first), opened).otherwise(closed)


def _listed(marks: str) -> str:
    return marks.replace("[", "\\[").replace("]", "\\]")


def has_period(token: Column) -> Column:
    """Ends in one period; an ellipsis is none."""
    return F.when(_ends_late(token), token.rlike(r"[^.]\.$")).otherwise(token.endswith(".") & ~token.endswith("..") & (token != "."))


def has_mark(token: Column) -> Column:
    return F.when(_ends_late(token), token.rlike(r"[!?]$")).otherwise(token.endswith("!") | token.endswith("?"))


def kind(token: Column) -> Column:
    """Lower-cased type without the last period; numbers are one type."""
    bare = F.when(_ends_late(token), F.regexp_replace(token, r"[.,;:!?]+$", "")).otherwise(F.rtrim(token, F.lit(".,;:!?")))
    return bound(F.lower(bare), lambda low: F.when((low >= "0") & (low < ":") & low.rlike(r"^\d[\d.,]*$"), F.lit("##number##")).otherwise(low))


def upper_first(token: Column) -> Column:
    return F.when(token < "\x80", (token >= "A") & (token < "[")).otherwise(token.rlike(r"^\p{Lu}"))


def lower_first(token: Column) -> Column:
    return F.when(token < "\x80", (token >= "a") & (token < "{")).otherwise(token.rlike(r"^\p{Ll}"))


def bound(value: Column, f) -> Column:
    """f(value), where value is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def form(token: str) -> tuple:
    """(kind, has_period, has_mark, upper_first, lower_first) of the core() of a token, as the columns have them."""
    body, later = (token[:-1], token[-1]) if token[-1:] in LATER else (token, "")
    if body[:1] in OPEN:
        body = body.lstrip(OPEN).rstrip(CLOSE)
    else:
        body = body.rstrip(CLOSE) or body[:1]
    if not later and body[-1:] in LATER:
        body, later = body[:-1], body[-1]
    low = (body.rstrip(".,;:!?") + later).lower()
    first = body[:1] or later
    upper, lower = ("A" <= first <= "Z", "a" <= first <= "z") if first < "\x80" else ((c := unicodedata.category(first)) == "Lu", c == "Ll")
    number = "0" <= low[:1] <= "9" and NUMBER.fullmatch(low)
    return "##number##" if number else low, body[-1:] == "." and len(body) > 1 and body[-2] != ".", body[-1:] in ("!", "?"), upper, lower


def remembered(token: str, known: dict) -> tuple:
    """form(), kept in known for some tokens."""
    told = known.get(token)
    if told is None:
        if len(known) >= KEPT:
            known.clear()
        told = known[token] = form(token)
    return told


def _told(tokens: list[str], known: dict) -> tuple[np.ndarray, np.ndarray, pa.Table, pa.Table]:
    """For each token the row of (kind, dotted, marked) and that of (kind, upper, lower), of which row 0 is null; and these rows."""
    firsts, seconds, at = {(None,) * 3: 0}, {(None,) * 3: 0}, np.empty((2, len(tokens)), np.int64)
    for i, token in enumerate(tokens):
        told = remembered(token, known)
        at[0, i] = firsts.setdefault(told[:3], len(firsts))
        at[1, i] = seconds.setdefault((told[0], *told[3:]), len(seconds))
    kinds = (pa.string(), pa.bool_(), pa.bool_())
    rows = lambda of, names: pa.table([pa.array(c, t) for c, t in zip(zip(*of), kinds)], names=names)
    return at[0], at[1], rows(firsts, ["first", "dotted", "marked"]), rows(seconds, ["second", "upper", "lower"])


def _cut(batches, counted):
    """counted(tokens, which text each is of, how many texts, known) of some PLACES tokens at a time."""
    waiting, places, known = [], 0, {}

    def numbered():
        texts = pa.concat_arrays(waiting)
        every = texts.flatten()
        full = pc.not_equal(every, "").to_numpy(zero_copy_only=False)  # an empty text is one empty token
        own = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False))[full]
        return every.filter(pa.array(full)).dictionary_encode(), own, len(texts), known

    for batch in batches:
        waiting.append(pc.ascii_split_whitespace(pc.ascii_trim_whitespace(batch[0])))
        places += len(waiting[-1].flatten())
        if places >= PLACES:
            yield from counted(*numbered()).combine_chunks().to_batches(BATCH)
            waiting, places = [], 0
    if waiting:
        yield from counted(*numbered()).combine_chunks().to_batches(BATCH)


def _followers(batches):
    """neighbours() of some PLACES tokens at a time, each pair once."""
    return _cut(batches, _counted)


def _counted(tokens: pa.DictionaryArray, own: np.ndarray, texts: int, known: dict) -> pa.Table:
    first, second, firsts, seconds = _told(tokens.dictionary.to_pylist(), known)
    code = tokens.indices.to_numpy(zero_copy_only=False)
    a, b = first[code], second[code]
    new = np.diff(own, prepend=-1) > 0
    before = np.where(new, 0, np.concatenate([[0], a[:-1]])) if len(a) else a
    last = np.zeros(texts, np.int64)  # of texts without tokens null
    last[own] = a  # the last one stays
    pair, n = np.unique(np.concatenate([before * len(seconds) + b, last * len(seconds)]), return_counts=True)
    left, right = firsts.take(pa.array(pair // len(seconds))), seconds.take(pa.array(pair % len(seconds)))
    return pa.table([*left.columns, *right.columns, pa.array(n)], names=[*left.column_names, *right.column_names, "n"])


TALLIES = ["n", "dotted", "upper_inside", "upper_all", "lower_all", "lower_first", "begins"]


def _tallied(tokens: pa.DictionaryArray, own: np.ndarray, texts: int, known: dict) -> pa.Table:
    """tallies() of tokens: a row for each type, and one for each pair across a period."""
    told = [remembered(t, known) for t in tokens.dictionary.to_pylist()]
    kinds = {}
    kind = np.array([kinds.setdefault(t[0], len(kinds)) for t in told], np.int64)
    code = tokens.indices.to_numpy(zero_copy_only=False)
    dotted, marked, upper, lower = (np.array([t[i] for t in told], bool)[code] for i in range(1, 5))
    kind, size = kind[code], len(kinds)
    new, last = np.diff(own, prepend=-1) > 0, np.diff(own, append=texts) > 0  # texts without tokens have neither
    after = lambda flag: np.concatenate([[False], flag[:-1]])[: len(flag)] & ~new
    paired, sure = after(dotted), new | after(marked)
    inside = ~new & ~paired & ~sure
    flags = (np.ones(len(kind), bool), dotted, upper & inside, upper & ~paired, lower & ~paired, lower & sure, sure)
    sums = [np.bincount(kind[x], minlength=size) for x in flags]
    nothing = [0] * (len(TALLIES) - 1) + [texts - int(new.sum()) + int((marked & last).sum())]  # ends of texts after what surely ends
    at = np.flatnonzero(paired)
    key = np.concatenate([((kind[at - 1] * (size + 1) + kind[at] + 1) << 2) | (upper[at] << 1) | lower[at], (kind[dotted & last] * (size + 1)) << 2])
    key, n = np.unique(key, return_counts=True)
    names, none = pa.array([*kinds, None], pa.string()), (key >> 2) % (size + 1) == 0
    second = pa.array((key >> 2) % (size + 1) - 1, mask=none)
    form_ = [pa.array((key & bit) > 0, mask=none) for bit in (2, 1)]
    one = pa.table([names, pa.nulls(size + 1, pa.string()), *[pa.nulls(size + 1, pa.bool_())] * 2, pa.array(np.zeros(size + 1, bool)), *(pa.array(np.append(x, y).astype(np.int64)) for x, y in zip(sums, nothing))], names=["first", "second", "upper", "lower", "pair", *TALLIES])
    two = pa.table([names.take(pa.array((key >> 2) // (size + 1))), names.take(second), *form_, pa.array(np.ones(len(n), bool)), pa.array(n), *[pa.array(np.zeros(len(n), np.int64))] * (len(TALLIES) - 1)], names=one.column_names)
    return pa.concat_tables([one, two])


def tallies(texts: DataFrame, text: str = "text") -> DataFrame:
    """What train() needs of neighbours(), (first, second, upper, lower, pair, TALLIES).

    With pair, how often (n) second follows first across a period; first is a type that ends in one. Else of the type first (null: the end of a text) how often it stands, and ends in a period; and, but for
    places after a period, how often its first letter is upper where no sentence begins, upper, lower, lower where one surely does, and how often one surely does."""
    bound_batches(texts.sparkSession)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    rows = rows.mapInArrow(lambda batches: _cut(batches, _tallied), "first string, second string, upper boolean, lower boolean, pair boolean, " + ", ".join(f"{c} long" for c in TALLIES))
    return rows.groupBy("first", "second", "upper", "lower", "pair").agg(*(F.sum(c).alias(c) for c in TALLIES))


def neighbours(texts: DataFrame, text: str = "text") -> DataFrame:
    """(first, dotted, marked, second, upper, lower, n): how often a piece follows another; first is null at the start of a text, second at its end.

    A task numbers its different tokens, looks at each of them once and counts pairs of numbers."""
    bound_batches(texts.sparkSession)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    rows = rows.mapInArrow(_followers, "first string, dotted boolean, marked boolean, second string, upper boolean, lower boolean, n long")
    return rows.groupBy("first", "dotted", "marked", "second", "upper", "lower").agg(F.sum("n").alias("n"))


def types_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """types() of texts whose neighbours aren't asked for: equal pieces are counted first, and only different ones are looked at."""
    different = texts.select(F.explode(tokens(F.col(text))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    told = different.select(core(F.col("p")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    return types(told.select(kind(F.col("c")).alias("first"), has_period(F.col("c")).alias("dotted"), "n"))


def types(near: DataFrame) -> DataFrame:
    """(type, n, dotted): how often a type stands in the texts, and how often a period ends it."""
    return near.where("first is not null").groupBy(F.col("first").alias("type")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("dotted"), F.col("n")).otherwise(0)).alias("dotted"))


def _log(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of k of n at probability p; 0 log 0 is 0."""
    part = lambda x, q: F.when(x > 0, x * F.ln(F.greatest(q, F.lit(1e-300)))).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def abbreviations(counted: DataFrame, total: DataFrame) -> DataFrame:
    """(type, score) of types that end in a period more often than chance: short ones and ones with periods inside gain, places without a period cost.

    counted: types(); total: one row (n, dotted), sums of counted."""
    rows = counted.where("dotted > 0 and type rlike '\\\\p{L}'").crossJoin(F.broadcast(total.select(F.col("n").alias("all_n"), F.col("dotted").alias("all_dotted"))))
    k, n = F.col("dotted").cast("double"), F.col("n").cast("double")
    ratio = -2 * (_log(k, n, F.col("all_dotted") / F.col("all_n")) - _log(k, n, F.lit(0.99)))
    inner = F.length(F.regexp_replace("type", "[^.]", "")).cast("double")
    letters = F.length("type") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(F.greatest(letters, F.lit(1.0)), -(n - k))
    return rows.select("type", score.alias("score")).where(F.col("score") >= ABBREVIATION)


def dunning(both: Column, one: Column, two: Column, n: Column) -> Column:
    """Log-likelihood ratio of two going with one, counted both times, against two alone; of n places."""
    both, one, two, n = (c.cast("double") for c in (both, one, two, n))
    p, p1, p2 = two / n, both / one, F.try_divide(two - both, n - one)
    rest = F.coalesce(p2, F.lit(0.0))
    return -2 * (_log(both, one, p) + _log(two - both, n - one, p) - _log(both, one, p1) - _log(two - both, n - one, rest))


def train(texts: DataFrame, text: str = "text") -> DataFrame:
    """(first, second, capital, breaks) for each pair of types around a period in the texts; capital tells how second is written."""
    scratch = Scratch(texts.sparkSession, "sentences")
    near = scratch.save(tallies(texts, text), "near")
    told, near = near.where("not pair"), near.where("pair").select("first", "second", "upper", "lower", "n")
    counted = scratch.save(told.where("first is not null").select(F.col("first").alias("type"), "n", "dotted"), "types")
    total = scratch.save(counted.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted")), "total")
    short = scratch.save(abbreviations(counted, total).select(F.col("type").alias("first"), F.lit(True).alias("short")), "short")

    # how a type is written where no sentence begins, and where one surely does: after a period of what is neither short nor an initial, too
    sure = F.col("short").isNull() & (F.length("first") != 1)
    tally = lambda c: F.when(c, F.col("n")).otherwise(0)
    after = near.join(short, "first", "left").select(F.col("second").alias("type"), F.lit(0).alias("upper_inside"), tally(F.col("upper")).alias("upper"), tally(F.col("lower")).alias("lower"), tally(F.col("lower") & sure).alias("lower_first"), tally(sure).alias("begins"))
    told = told.select(F.col("first").alias("type"), "upper_inside", F.col("upper_all").alias("upper"), F.col("lower_all").alias("lower"), "lower_first", "begins")
    written = told.unionByName(after).groupBy("type").agg(*(F.sum(c).alias(c) for c in told.columns[1:]))
    written = scratch.save(written, "written")
    places = scratch.save(written.agg(F.sum("begins").alias("places")), "places")
    start = written.where("type is not null").join(counted.select("type", "n"), "type").crossJoin(F.broadcast(places)).crossJoin(F.broadcast(total.select(F.col("n").alias("all_n"))))
    often = dunning(F.col("begins"), F.col("places"), F.greatest(F.col("n"), F.col("begins")), F.col("all_n")) >= STARTER
    starter = often & (F.col("begins") / F.col("places") > F.col("n") / F.col("all_n")) & F.col("type").rlike(r"^\p{L}")
    written = start.select(F.col("type").alias("second"), "upper_inside", "upper", "lower", "lower_first", F.coalesce(starter, F.lit(False)).alias("starter"))

    # pairs that stand together across a period
    around = scratch.save(near.where("second is not null").groupBy("first", "second", F.col("upper").alias("capital"), F.col("lower").alias("small")).agg(F.sum("n").alias("pair")), "around")
    pair = around.groupBy("first", "second").agg(F.sum("pair").alias("both"))
    pair = pair.join(counted.select(F.col("type").alias("first"), F.col("dotted").alias("one")), "first").join(counted.select(F.col("type").alias("second"), F.col("n").alias("two")), "second")
    pair = pair.crossJoin(F.broadcast(total.select(F.col("n").alias("all_n"))))
    together = (dunning(F.col("both"), F.col("one"), F.greatest("two", "both"), F.col("all_n")) >= COLLOCATION) & (F.col("both") / F.col("one") > F.col("two") / F.col("all_n")) & (F.col("both") > 1)
    pair = pair.select("first", "second", together.alias("together"))

    rows = around.join(short, "first", "left").join(written, "second", "left").join(pair, ["first", "second"], "left")
    no = F.lit(False)
    is_short, together, starter = F.coalesce("short", no), F.coalesce("together", no) & ~F.coalesce("starter", no), F.coalesce("starter", no)
    initial, number = (F.length("first") == 1) & F.col("first").rlike(r"\p{L}"), F.col("first") == "##number##"
    # the second word's spelling: true says that a sentence begins, false that none does, null that it doesn't tell
    spelling = F.when(F.col("capital") & (F.col("lower") > 0) & (F.col("upper_inside") == 0), True).when(F.col("small") & ((F.col("upper") > 0) | (F.col("lower_first") == 0)), False)
    never_lower = F.col("capital") & (F.coalesce("lower", F.lit(0)) == 0)
    breaks = (
        F.when(together & (is_short | initial | number), False)
        .when(is_short & ~initial, F.coalesce(spelling, F.col("capital") & starter))
        .when((initial | number) & (F.coalesce(spelling, no) == no) & (spelling.isNotNull() | (initial & never_lower)), False)
        .when(initial & is_short, F.coalesce(spelling, F.col("capital") & starter))
        .otherwise(True)
    )
    return rows.select("first", "second", F.col("capital"), breaks.alias("breaks"))


def _starts(lengths: pd.Series) -> pd.Series:
    """Running sums before each; a fold by columns would copy its state at every step."""
    return pd.Series([np.cumsum(x) - x for x in lengths])


def _ends(batches):
    """(keys, i, sure, first, second, capital) of (keys, __text): the parts of a text, by number, that may end a sentence: surely, or as the model says of two types."""
    known = {}
    for batch in batches:
        rows, out = [], []
        for row, text in enumerate(batch["__text"].to_pylist()):
            parts = OWN_PART.findall(text.translate(BLANKS))
            for i in range(len(parts) - 1):
                one = remembered(parts[i].rstrip(" ").rpartition(" ")[2], known)
                if one[1] or one[2]:
                    two = remembered(parts[i + 1].partition(" ")[0], known)
                    out.append((i, True, None, None, None) if one[2] else (i, False, one[0], two[0], two[3]))
                    rows.append(row)
                elif ellipsis(parts[i].rstrip(" ").rpartition(" ")[2]) and not remembered(parts[i + 1].partition(" ")[0], known)[4]:
                    out.append((i, True, None, None, None))  # after an ellipsis no small letter begins a sentence
                    rows.append(row)
        kinds = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.bool_())
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds)]
        names = [c for c in batch.schema.names if c != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(rows, pa.int64())) for c in names), *columns], names=[*names, "i", "sure", "first", "second", "capital"])


def ellipsis(token: str) -> bool:
    """The core() of a token ends in two periods."""
    body = (token[:-1] if token[-1:] in LATER else token).rstrip(CLOSE)
    return (body[:-1] if body[-1:] in LATER else body).endswith("..")


def split(texts: DataFrame, keys: list[str], model: DataFrame, text: str = "text") -> DataFrame:
    """(keys, seq, start, sentence) of texts whose keys are unique: sentences with the white space behind them, which add up to the text.

    start counts characters from 0. Pairs that the model doesn't know break. Null texts give no row, a text without other characters than
    white space is one sentence, an empty one none."""
    find_package(texts.sparkSession)
    own = Scratch(texts.sparkSession, "sentences").save(texts.where(F.length(text) > 0).select(*keys, F.col(text).alias("__text")), "texts")
    # a sentence ends with a part, so parts are looked at and not all pieces
    parts = F.regexp_extract_all(F.col("__text"), F.lit(PART), F.lit(0))
    bound_batches(texts.sparkSession)
    types = "".join(f"`{c}` {t}, " for c, t in own.select(*keys).dtypes)
    ends = own.mapInArrow(_ends, f"{types}i int, sure boolean, first string, second string, capital boolean")
    no = model.where("not breaks").select("first", "second", "capital")
    cuts = ends.join(no, ["first", "second", "capital"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    whole = own.join(cuts, keys, "left").withColumn("p", parts)
    cuts = F.concat(F.array(F.lit(-1)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.size("p") - 1))
    runs = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda k: F.array_join(F.slice("p", F.get("cuts", k) + 2, F.get("cuts", k + 1) - F.get("cuts", k)), ""))
    out = whole.withColumn("cuts", cuts).select(*keys, runs.alias("r"))
    starts = F.pandas_udf(_starts, "array<int>")(F.transform("r", F.length))
    return out.select(*keys, F.posexplode(F.arrays_zip(starts.alias("start"), F.col("r").alias("sentence"))).alias("seq", "s")).select(*keys, "seq", "s.start", "s.sentence")
