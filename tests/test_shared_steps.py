"""Word counts and look-ups of ratings: the same rows as plain joins and sums, without shuffling all words."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexitide.operators import counting, scoring, words
from lexitide.plans import stand_in as S
from lexitide.runtime import Scratch


@pytest.fixture
def texts(spark):
    rows = [("a", "en", "The cat, the cat's the"), ("b", None, "x"), ("c", "en", ""), ("d", "en", None), ("a", "en", "the end"), (None, "en", "x x"), (None, "en", "x y")]
    return spark.createDataFrame(rows, "id string, lang string, text string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bags_hold_the_counts_of_each_text_and_repeated_keys_meet(spark, texts):
    keys = ["id", "lang"]
    saved = Scratch(spark, "t").save(scoring.bags(texts, keys))
    assert "Exchange" not in plan(scoring.bags(texts, keys))
    got = scoring.of_one_text(saved, keys).select(*keys, F.inline("bag"))
    assert rows_of(got) == rows_of(scoring.word_counts(texts, keys))


def test_word_counts_of_a_session_shuffle_nothing(spark, sf):
    assert "Exchange" not in plan(S.counted(spark, sf))


@pytest.mark.parametrize("head", [0, 3, 1000])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_looked_up_is_the_join(spark, monkeypatch, head, how):
    monkeypatch.setattr(scoring, "HEAD", head)
    freqs = spark.createDataFrame([(i % 5, f"w{i % 7}", i) for i in range(60)] + [(1, None, 1)], "id int, word string, cnt long")
    rated = spark.createDataFrame([(f"w{i}", 2**i, float(i)) for i in range(6)], "word string, n long, z double")
    ratings = scoring.frequent(rated).drop("n")
    assert ratings.where("frequent").count() == min(head, 6)
    assert rows_of(scoring.looked_up(freqs, ratings, ["word"], how)) == rows_of(freqs.join(rated.drop("n"), ["word"], how))


def test_top_words_by_decade(spark):
    rows = [(1500 + 7 * i % 90 if i % 9 else None, w, i) for i, w in enumerate("The cat sat on the mat 12 a-b the Cat".split() * 6)]
    freqs = spark.createDataFrame(rows, "year int, word string, cnt long")
    assert rows_of(words.by_decade_of_most_frequent(freqs, 3)) == rows_of(words.most_frequent(words.by_decade(freqs), 3).select("decade", "word", "cnt"))


@pytest.mark.parametrize("head", [0, 1, 1000])
def test_windows_and_top_words_with_frequent_contrasts(spark, monkeypatch, head):
    monkeypatch.setattr(scoring, "HEAD", head)
    texts = spark.createDataFrame([(1, "Cat sat, on the 42 mat. The cat - ran! 42 cats"), (2, "; ;"), (3, "mat mat sat"), (4, None)], "id int, text string")
    rated = spark.createDataFrame([("q", "cat", "neg", 9), ("q", "mat", "pos", 5), ("q", "42", "neither", 2), ("q", "sat", "neg", 1)], "contrast string, word string, band string, n long")
    plain, split = rated.drop("n"), scoring.frequent(rated).drop("n")
    for work in (lambda c: counting.window_counts(texts, c, ["id"], 2, names=["q"]), lambda c: counting.top_words(texts, c, ["id"])):
        assert rows_of(work(split)) == rows_of(work(plain))


@pytest.mark.parametrize("head", [0, 2, 1000])
def test_windows_of_texts_are_those_of_token_rows(spark, monkeypatch, head):
    """Two contrasts, repeated and missing keys, odd texts, words with odd bands, marks that are listed."""
    import numpy as np

    monkeypatch.setattr(scoring, "HEAD", head)
    draw = np.random.default_rng(head)
    known = ["rock", "virtue", "man", "9", "été", "don't", "."]
    rows = [(int(i), "en", " ".join(draw.choice(["Rock", "VIRTUE", "zzz", "9", "man", "Été", "don't", ". ", "_a", "-"], draw.integers(0, 60)))) for i in range(40)]
    rows += [(100, "en", None), (101, "en", ""), (102, None, "man"), (None, "en", "rock man"), (None, None, "rock"), (7, "en", None), (103, "en", ";;"), (104, "en", "zzz zzz")]
    texts = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    rated = [("b", w, ["neg", "pos", "neither", "odd"][i % 4], 2 ** (i + 1)) for i, w in enumerate(known)] + [("é", w, ["pos", "neg"][i % 2], 3**i) for i, w in enumerate(known[:5])]
    rated = spark.createDataFrame([*rated, ("b", "zzz", None, 5), ("other", "zzz", "neg", 99)], "contrast string, word string, band string, n long")
    plain, split = rated.drop("n"), scoring.frequent(rated).drop("n")
    for size in (1, 3, 50):
        got = counting.window_counts(texts, split, ["id", "lang"], size, names=["é", "b"])
        want = counting.window_counts(texts, plain, ["id", "lang"], size, names=["é", "b"])
        assert got.dtypes == want.dtypes and rows_of(got) == rows_of(want)
    # a text whose key is repeated is counted with the other
    twice = texts.union(spark.createDataFrame([(101, "en", "rock virtue man"), (None, None, None)], texts.schema))
    got, want = (counting.window_counts(twice, c, ["id", "lang"], 50, names=["b"]) for c in (split, plain))
    assert rows_of(got) == rows_of(want) and (101, "en", "b", 0) in {r[:4] for r in rows_of(got)}


def test_contrasts_are_frequent_among_themselves(spark, sf, monkeypatch):
    monkeypatch.setattr(scoring, "HEAD", S.contrasts(spark, sf).count())
    assert S.norms(spark, sf).count() > scoring.HEAD and S.contrasts(spark, sf, True).where("not frequent").isEmpty()
    assert S.contrasts(spark, sf, True).columns == ["contrast", "word", "band", "frequent"] and "n" not in S.norms(spark, sf, True).columns


def test_windows_of_a_session_shuffle_no_tokens(spark, sf):
    from lexitide.plans import q_scoring

    assert "Window" not in plan(q_scoring.counting_windows(spark, sf)) and "posexplode" not in plan(q_scoring.counting_windows(spark, sf))


def test_regression_without_effects_deals_no_rows_by_one_key(spark, monkeypatch):
    from lexitide.operators import fits

    def refused(self, other, on=None, how=None):
        assert on != "__g", "all rows have this key"
        return joined(self, other, on, how)

    df = spark.createDataFrame([(2.0 * i + 1 + i % 3, float(i), float(i * i % 7)) for i in range(30)], "y double, x double, w double")
    joined = type(df).join
    monkeypatch.setattr(type(df), "join", refused)
    import numpy as np

    rows = np.array([list(r) for r in df.collect()])
    beta = np.linalg.lstsq(np.column_stack([np.ones(30), rows[:, 1:]]), rows[:, 0], rcond=None)[0]
    got = {r["term"]: r["beta"] for r in fits.least_squares(df, "y", ["x", "w"]).collect()}
    assert got == {"x": pytest.approx(beta[1]), "w": pytest.approx(beta[2])}


def test_types_of_texts_are_those_of_their_neighbours(spark):
    from lexitide.operators import sentences

    texts = spark.createDataFrame([(' "Dr.  Who" came, at 5.30 p.m.\nHe (the Dr.) left! ',), (None,), ("",), (" \t\x0b",), ("a a. A.... ''",)], "text string")
    assert rows_of(sentences.types_of(texts)) == rows_of(sentences.types(sentences.neighbours(texts)))


def test_labels_of_types_are_matched_too(spark, tmp_path):
    from lexitide.plans import q_more

    spark.createDataFrame([(1, "PROMO TIN", "blue bolt"), (2, "LARGE", "red ring"), (3, "ECO copper", "Red")], "p_partkey long, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    assert rows_of(q_more.labels_matching(spark, str(tmp_path))) == [(1, "TIN"), (2, "red ring"), (3, "Red"), (3, "copper")]


def test_edges_of_a_degree_are_told_apart_once(spark, sf):
    from lexitide.plans import q_tables

    assert "Aggregate" not in plan(q_tables._edges(spark, sf))
