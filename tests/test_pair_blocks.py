"""Pairs of words as rows of arrays, and lines cut from texts."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexitide.operators import vectors
from lexitide.plans import q_models


@pytest.fixture(scope="module")
def lines(spark):
    draw = np.random.default_rng(5)
    rows = [("C18" if i % 3 else "C19", [f"w{k}" for k in draw.integers(0, 30, draw.integers(0, 20))]) for i in range(120)]
    rows += [("C18", None), ("C18", ["w1"]), ("C18", ["w1", None, "w1", "rare", "w2"]), (None, ["w1", "w2"]), ("other", ["w1", "w2"])]
    return spark.createDataFrame(rows, "period string, words array<string>").repartition(3)


@pytest.mark.parametrize("head", [200_000, 0])
def test_a_row_holds_the_pairs_of_two_shards(spark, lines, monkeypatch, head):
    """The same pairs as in rows, whether known words are sent to the tasks or lines meet them; and each word's sum."""
    monkeypatch.setattr(vectors.scoring, "HEAD", head)
    shards, window = 3, 4
    words = [(p, f"w{i}", (i // shards) * shards + i % shards, 1 - i / 64) for p in ("C18", "C19") for i in range(28)]
    words = spark.createDataFrame(words, "period string, word string, id long, kept double")
    want, sums = {}, Counter()
    for r in vectors.numbered_pairs(lines, ["period"], window, words).collect():
        want[r.period, r.a, r.b] = round(r.n * window)
        for x, y in ((r.a, r.b), (r.b, r.a)):
            sums[r.period, x] += r.n * window * (1 - y / 64)
    got, told, rows = {}, {}, vectors.numbered_pairs(lines, ["period"], window, words, shards).collect()
    assert len(rows) == len({(r.period, r.one, r.two) for r in rows}) <= 2 * (shards * (shards + 1) // 2 + shards)
    for r in rows:
        p = np.frombuffer(r.p, "<u2").astype(int) * shards + r.one
        if r.two < 0:
            told |= {(r.period, int(x)): f for x, f in zip(p, np.frombuffer(r.low))}
            continue
        q = np.frombuffer(r.q, "<u2").astype(int) * shards + r.two
        assert r.one <= r.two
        got |= {(r.period, int(min(x, y)), int(max(x, y))): int(n) for x, y, n in zip(p, q, vectors._weights(r.low, r.high))}
    assert got == want and told == pytest.approx(dict(sums))


def test_chunks_add_up_to_the_lines(monkeypatch):
    """Runs of a few places at a time give the pairs of all lines, weights beyond a byte too."""
    lines = [["a", "b", "x", "a"], [], ["b"], ["c", "a", None, "b"]] * 60
    own = pa.array(["a", "b", "c"])
    want = Counter()
    for line in lines:
        for i, x in enumerate(line):
            for d in range(1, 4):
                if i + d < len(line) and {x, line[i + d]} <= set("abc"):
                    want[tuple(sorted("abc".index(w) for w in (x, line[i + d])))] += 4 - d
    for places in (5, 1 << 21):
        monkeypatch.setattr(vectors, "PLACES", places)
        got, runs = Counter(), 0
        for a, b, w in vectors._met(pa.array(lines), own, 3):
            runs += 1
            got.update({(int(x), int(y)): int(n) for x, y, n in zip(a, b, w)})
        assert got == want and (runs > 9) == (places == 5)
    w = np.array([1, 255, 256, 70_000, 1 << 33])
    assert (vectors._weights((w & 255).astype(np.uint8).tobytes(), (w >> 8).astype("<u4").tobytes()) == w).all()


def test_training_does_not_look_at_the_cores(spark, lines, monkeypatch):
    """The shards, and so the vectors, are those of the words alone."""
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 1))
    how = dict(size=4, window=3, least=2, epochs=1, shard=8)
    one = {(r.period, r.word): r.vector for r in vectors.train(lines, ["period"], **how).collect()}
    monkeypatch.undo()
    words = vectors.Scratch(spark, "t").save(vectors.vocabulary(lines, ["period"], 2))
    two = {(r.period, r.word): r.vector for r in vectors.train(lines.repartition(5), ["period"], words=words, **how).collect()}
    assert one == two and len(one) > 50


def test_lines_are_all_words(spark, sf):
    got = q_models._lines(spark, sf).groupBy("doc_id").agg(F.sum(F.size("words")).alias("n"), F.max(F.size("words")).alias("most"), F.count("*").alias("lines"))
    texts = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'")
    n = texts.select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\w']+"), F.lit(0))).alias("n")).where("n > 0")
    assert {(r.doc_id, r.n, r.lines) for r in got.where("most <= 25").collect()} == {(r.doc_id, r.n, -(-r.n // 25)) for r in n.collect()}
