"""Learned sentence boundaries on planted texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexitide.operators import sentences as S


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with abbreviations before names and numbers, initials, and sentences that end in common words; the true ends by text."""
    draw = random.Random(4)
    nouns = ["house", "river", "letter", "garden", "captain", "market", "winter", "road", "tower", "friend"]
    names = ["Smith", "Jones", "Baker", "Carter", "Moore", "Turner"]
    verbs = ["saw", "met", "called", "found", "left", "heard"]
    rows = []
    for t in range(120):
        text, ends = "  " if t % 7 == 0 else "", []
        for _ in range(30):
            one = draw.choice(["Mr. {n} {v} the {a}", "The {a} {v} Dr. {n} near the {b}", "She {v} the {a}, i.e. the {b}", "The {a} was sold for vol. {k} of the {b}", "A {a} {v} J. {n} there", "He {v} the {a}", "It was the {a} of the {b}"])
            one = one.format(n=draw.choice(names), v=draw.choice(verbs), a=draw.choice(nouns), b=draw.choice(nouns), k=draw.randint(2, 90))
            text += one + draw.choice([".", ".", ".", "!", "?", '."'])
            ends.append(len(text))
            text += draw.choice([" ", " ", "\n", "  "])
        rows.append((t, text, ends))
    return spark.createDataFrame(rows, "id int, text string, ends array<int>"), rows


def test_breaks_and_exact_spans(spark, planted):
    df, rows = planted
    model = S.train(df)
    got = {}
    for r in S.split(df, ["id"], model).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append((r.start, r.sentence))
    wrong = by_rule = total = 0
    for t, text, ends in rows:
        assert "".join(s for _, s in got[t]) == text
        assert all(text[start : start + len(s)] == s for start, s in got[t])
        found = {start + len(s.rstrip()) for start, s in got[t]}
        rule = {m.end() for m in re.finditer(r"[.!?]\"?(?=\s)", text.rstrip())} | {len(text.rstrip())}
        wrong, by_rule, total = wrong + len(found ^ set(ends)), by_rule + len(rule ^ set(ends)), total + len(ends)
    assert wrong <= 0.01 * total and by_rule > 0.3 * total


def test_abbreviations_are_found(spark, planted):
    near = S.neighbours(planted[0])
    counted = S.types(near)
    found = {r.type for r in S.abbreviations(counted, counted.agg(F.sum("n").alias("n"), F.sum("dotted").alias("dotted"))).collect()}
    assert {"mr", "dr", "i.e", "vol"} <= found and not found & {"house", "river", "captain", "the"}


def test_odd_texts(spark, planted):
    model = S.train(planted[0])
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \n "), (3, "no end"), (4, "Wait ... and see. Done"), (5, "One. " * 30_000)], "id int, text string")
    got = {}
    for r in S.split(df, ["id"], model).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.sentence)
    assert set(got) == {2, 3, 4, 5} and got[2] == [" \n "] and got[4] == ["Wait ... and see. ", "Done"] and len(got[5]) == 30_000
    assert S.split(df, ["id"], S.train(df.where("false"))).where("id = 3").count() == 1
