"""Forms of tokens told by comparisons are those of the patterns."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lexitide.operators import sentences as S

OPEN, CLOSE = "[\"'(\\[{«“‘„—-]*", "[\"')\\]}»”’]*"


def test_forms_like_the_patterns(spark):
    draw = random.Random(3)
    signs = list("aZ09.,!?;:'\"()[]{}«»“”‘’„—-éÉǅß") + ["\u0085", " ", " ", "İ", "𝔄", "😀", "x", "B", "..", "3.5"]
    rows = sorted({"".join(draw.choice(signs) for _ in range(draw.randint(1, 6))) for _ in range(4000)} | {")", "))", "()", "')", "(", ".", "..", "...", "-", "—x", "A.", "12", "1,2.", ":", "0", "9:", "[x]", "{.}"})
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    t = F.col("t")
    low = F.lower(F.regexp_replace(t, r"[.,;:!?]+$", ""))
    pairs = {
        "core": (S.core(t), F.regexp_replace(t, f"^{OPEN}|{CLOSE}$", "")),
        "period": (S.has_period(t), t.rlike(r"[^.]\.$")),
        "mark": (S.has_mark(t), t.rlike(r"[!?]$")),
        "kind": (S.kind(t), F.when(low.rlike(r"^\d[\d.,]*$"), F.lit("##number##")).otherwise(low)),
        "upper": (S.upper_first(t), t.rlike(r"^\p{Lu}")),
        "lower": (S.lower_first(t), t.rlike(r"^\p{Ll}")),
    }
    for name, (have, want) in pairs.items():
        wrong = df.select("t", have.alias("h"), want.alias("w")).where("not h <=> w").collect()
        assert not wrong, (name, wrong[:3])
    for token in ("", *rows[:50]):
        assert spark.range(1).select(S.core(F.lit(token)) == F.regexp_replace(F.lit(token), f"^{OPEN}|{CLOSE}$", "")).collect()[0][0], token


def test_tokens_are_the_pieces(spark):
    rows = [(None,), ("",), (" \n ",), ("a",), ("  a\tb\x0b\n c ",), ("a b c d",), (" . . ",)]
    df = spark.createDataFrame(rows, "t string").select(S.tokens(F.col("t")).alias("h"), F.transform(S.pieces(F.col("t")), lambda p: F.btrim(p, F.lit(S.WHITE))).alias("w"))
    assert all(r.h == r.w for r in df.collect())


def test_forms_of_tasks_like_the_columns(spark):
    draw = random.Random(4)
    signs = list("aZ09.,!?;:'\"()[]{}«»“”‘’„—-éÉǅßΣ") + ["\u0085", "\u2028", "\u2029", "İ", "𝔄", "😀", "..", "3.5"]
    rows = sorted({"".join(draw.choice(signs) for _ in range(draw.randint(1, 6))) for _ in range(4000)} | {")", "))", "()", "(", ".", "..", "\u2028", ")\u2028", "(\u2028", "a”\u2028", "1.\u0085", "x.\u2029”"})
    c = S.core(F.col("t"))
    told = spark.createDataFrame([(t,) for t in rows], "t string").select("t", S.kind(c), S.has_period(c), S.has_mark(c), S.upper_first(c), S.lower_first(c), c.rlike(r"\.\.$"))
    wrong = [(tuple(r), S.form(r[0])) for r in told.collect() if tuple(r)[1:] != (*S.form(r[0]), S.ellipsis(r[0]))]
    assert not wrong, wrong[:3]


def test_neighbours_like_plain(spark, monkeypatch):
    """Pairs of each text with its start and end, in runs of a few tokens; odd white space, empty and missing texts."""
    texts = ["Mr. Smith (a) went. “He” saw", " a\tb \n", "", " \n", None, "a b", "one", "x \x0b\f y\u00a0z"] * 3
    want = {}
    for t in texts:
        if t is not None:
            own = [None, *(S.form(w) for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w), None]
            for x, y in zip(own, own[1:]):
                key = (*(x[:3] if x else (None,) * 3), *((y[0], *y[3:]) if y else (None,) * 3))
                want[key] = want.get(key, 0) + 1
    got = S.neighbours(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert {tuple(r)[:6]: r.n for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(S, "PLACES", 4)
    some, rows = {}, 0
    for batch in S._followers([pa.record_batch([pa.array([t], pa.string())], names=["text"]) for t in texts if t is not None]):
        rows += 1
        for r in batch.to_pylist():
            key = tuple(r.values())[:6]
            some[key] = some.get(key, 0) + r["n"]
    assert some == want and rows > 3


def test_tallies_like_neighbours(spark, monkeypatch):
    texts = ["Mr. Smith (a) went. “He” saw! it", "A. b. c. A", " a\tb \n", "", " \n", "a? B. ...", "end.", "end!", "12. x"] * 2
    near = S.neighbours(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    want = {}
    for r in near:
        if r["first"] is not None:
            want.setdefault((r["first"], None, None, None, False), [0] * 7)[0] += r.n
            want[r["first"], None, None, None, False][1] += r.n * r.dotted
        if r.dotted:
            want.setdefault((r["first"], r.second, r.upper, r.lower, True), [0] * 7)[0] += r.n
        else:
            sure = r["first"] is None or r.marked
            row = want.setdefault((r.second, None, None, None, False), [0] * 7)
            for i, flag in enumerate([r.upper and not sure, r.upper, r.lower, r.lower and sure, sure]):
                row[i + 2] += r.n if flag and (r.second is not None or i == 4) else 0
    got = {tuple(r)[:5]: list(r)[5:] for r in S.tallies(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(2)).collect()}
    assert got == want
    monkeypatch.setattr(S, "PLACES", 4)
    some = {}
    for batch in S._cut([pa.record_batch([pa.array([t], pa.string())], names=["text"]) for t in texts], S._tallied):
        for r in batch.to_pylist():
            row = some.setdefault(tuple(r.values())[:5], [0] * 7)
            row[:] = [x + y for x, y in zip(row, tuple(r.values())[5:])]
    assert some == want


def test_parts_add_up_and_end_where_sentences_may(spark):
    text = ' Mr. X (v. 2) said: "No!" ... and e.g. this?! Well...then\u2028a.b c .d  \n'
    rows = [text, " \n ", "no end", "...", "a. b", ". . .", "é! ß"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", F.regexp_extract_all("t", F.lit(S.PART), F.lit(0)).alias("p")).collect()
    for r in got:
        assert "".join(r.p) == r.t
        pieces = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", r.t)
        ends = [sum(map(len, pieces[: i + 1])) for i, x in enumerate(pieces) if set(x) & set(".!?")]
        assert {len("".join(r.p[: i + 1])) for i in range(len(r.p))} >= set(ends) and len(r.p) <= len(ends) + 1


def test_texts_are_cut_once_for_their_ends(spark):
    """One pass finds all ends, whatever decides about them."""
    df = spark.createDataFrame([(1, "Mr. A. went. So! did ... he. B")], "id int, text string")
    plan = S.split(df, ["id"], S.train(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("MapInArrow") == 1
