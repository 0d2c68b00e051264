"""Chunk scores without a shuffle of tokens."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexitide.operators import scoring

TEXTS = [(1, "en", "The cat's mat, the cat! sat the MAT"), (2, "en", ""), (3, "en", None), (4, None, "cat mat"), (5, "fr", "cat zzz ; ; mat"), (6, "en", " cat  \n mat\tsat - "), (7, "en", "zzz " * 9 + "cat"), (1, "en", "sat")]


def plain(size, z):
    out = {}
    for i, lang, text in TEXTS:
        for k, piece in enumerate((text or "").strip(" ").split()):
            word = piece.lower().strip(",!;-")
            if lang and (lang, word) in z:
                out.setdefault((i, k // size), []).append(z[lang, word])
    out = {k: sum(v) / len(v) for k, v in out.items()}
    of = {i: [v for (j, _), v in out.items() if j == i] for i, _ in out}
    return {k: (pytest.approx(v), pytest.approx(sum(of[k[0]]) / len(of[k[0]]))) for k, v in out.items()}


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_chunks_with_frequent_ratings(spark, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)
    z = {("en", "cat"): 1.0, ("en", "mat"): -2.0, ("en", "sat"): 0.5, ("fr", "cat"): 4.0, ("en", "the"): 0.25}
    rated = spark.createDataFrame([(*k, v, 2 ** (i + 1)) for i, (k, v) in enumerate(z.items())], "lang string, word string, z double, n long")
    texts = spark.createDataFrame(TEXTS, "id int, lang string, text string")
    for size in (1, 2, 50):
        for norms in (rated.drop("n"), scoring.frequent(rated).drop("n")):
            got = scoring.trajectories(texts, norms, ["lang", "word"], ["id", "lang"], "z", size).collect()
            assert {(r.id, r.chunk): (r.z, r.text_mean) for r in got} == plain(size, z) and dict(zip(got[0].__fields__, map(type, got[0])))["chunk"] is int


def test_only_chunks_are_shuffled(spark):
    """All ratings being frequent, tokens meet them where they are and are added up before the first exchange."""
    texts = spark.createDataFrame([(1, "en", "a b")], "id int, lang string, text string")
    norms = spark.createDataFrame([("en", "a", 1.0, True)], "lang string, word string, z double, frequent boolean")
    out = scoring.trajectories(texts, norms, ["lang", "word"], ["id", "lang"], "z", 2)
    lines = out._jdf.queryExecution().sparkPlan().toString().splitlines()
    assert sum("Aggregate" in x for x in lines) <= 2 and not any("word#" in x for x in lines if "Aggregate" in x and "keys=" in x)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "word" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
