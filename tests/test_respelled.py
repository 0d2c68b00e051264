"""Modern spellings without a shuffle of tokens."""

from __future__ import annotations

import random

import pytest

from lexitide.operators import records as R
from lexitide.operators import scoring


@pytest.fixture(scope="module")
def spelling(spark):
    return spark.createDataFrame([("olde", "old"), ("olde", "auld"), ("é", "e"), ("2nd", "second"), ("a-b", "ab"), ("gone", None), ("x²", "xx"), ("of", "o'")], "word string, modern string")


def test_texts_in_place_like_rows_of_tokens(spark, spelling, monkeypatch):
    """Odd signs, spaces and lines; missing and empty texts."""
    draw = random.Random(7)
    signs = ["olde", "é", "2nd", "a-b", "gone", "x²", "of", "Ⅷ", "中", "é", "_", "-", ".", "'", "“", " ", "  ", "\n", "\r", "\t", " ", "\u0085", " ", "😀"]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 12))) for _ in range(600)] + ["", " ", "\n\n", "olde", "(olde)\r\n", "_olde_"]
    df = spark.createDataFrame([(i, i % 3, t) for i, t in enumerate(texts)] + [(-1, 0, None)], "id int, part int, text string").repartition(3)
    have = {(r.id, r.part): r.text for r in R.respelled(df, ["id", "part"], "text", spelling).collect()}
    monkeypatch.setattr(scoring, "HEAD", 3)  # fewer than there are spellings
    want = {(r.id, r.part): r.text for r in R.respelled(df, ["id", "part"], "text", spelling).collect()}
    assert have == want and len(have) == len(texts)


def test_texts_are_not_shuffled(spark, spelling):
    df = spark.createDataFrame([(1, "olde of")], "id int, text string")
    out = R.respelled(df, ["id"], "text", spelling)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.collect()[0].text == "old o'"
