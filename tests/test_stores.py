"""Versioned stores, catalog tables, lookups and training lines on small cases."""

import pytest
from pyspark.sql import functions as F

from lexitide.operators import norms as N
from lexitide.operators import records as R
from lexitide.sources import readers, sinks, stores


def test_versions_are_kept_apart(spark, tmp_path):
    path, calls = str(tmp_path / "c"), []

    def make():
        calls.append(1)
        return spark.createDataFrame([("t", 0.5 * len(calls))], "_id string, s double")

    assert stores.read_version(spark, path, "_id string, s double", norms="a").count() == 0
    assert [r.s for r in stores.cached(spark, path, make, norms="a").collect()] == [0.5]
    assert [r.s for r in stores.cached(spark, path, make, norms="a").collect()] == [0.5]
    assert [r.s for r in stores.cached(spark, path, make, norms="b").collect()] == [1.0] and len(calls) == 2
    (tmp_path / "c" / "norms=b" / "_SUCCESS").unlink()  # as after a writer that was lost
    assert stores.read_version(spark, path, "_id string, s double", norms="b").count() == 0
    assert [r.s for r in stores.cached(spark, path, make, norms="b").collect()] == [1.5]
    assert [r.s for r in stores.read_version(spark, path, "_id string, s double", norms="a").collect()] == [0.5]
    with pytest.raises(ValueError):
        stores.write_version(make(), path, norms="../x")


def test_tables_of_the_catalog(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS stored LOCATION '{tmp_path}/db'")
    try:
        norms = spark.createDataFrame([("rock", 1.5), ("rock", 1.25), ("virtue", -1.5), (None, 9.0)], "word string, `Abs.Median` double")
        assert stores.upload_norms(norms, "stored.norms") and not stores.upload_norms(norms, "stored.norms") and stores.upload_norms(norms, "stored.norms", drop=True)
        assert {tuple(r) for r in spark.table("stored.norms").collect()} == {("rock", 1.25), ("virtue", -1.5)}
        assert dict(spark.table("stored.norms").dtypes)["Abs.Median"] == "float"
        stores.create_table(spark, "stored.scores", ["a", "b"])
        stores.create_table(spark, "stored.scores", ["other"])  # stays as it is
        stores.insert_by_name(spark.createDataFrame([(2.0, "x")], "b double, _id string"), "stored.scores")
        stores.insert_by_name(spark.createDataFrame([("y", 1.0, 3.0)], "_id string, a double, b double"), "stored.scores")
        assert {tuple(r) for r in spark.table("stored.scores").collect()} == {("x", None, 2.0), ("y", 1.0, 3.0)}
        with pytest.raises(ValueError):
            stores.insert_by_name(spark.createDataFrame([("z", 1.0)], "_id string, c double"), "stored.scores")
        stores.create_table(spark, "stored.scores", ["a"], drop=True)
        assert spark.table("stored.scores").columns == ["_id", "a"] and spark.table("stored.scores").count() == 0
    finally:
        spark.sql("DROP DATABASE stored CASCADE")


def test_views_drop_other_languages_only(spark):
    scores = spark.createDataFrame([("a", "arc_fr", "s", 1.0), ("b", "arc_fr", "s", 2.0), ("c", "arc_fr", "s", 3.0), ("d", "own", "s", 4.0), ("a", "own", "s", 5.0)], "_id string, arc_corpus string, source_corpus string, score double")
    texts = spark.createDataFrame([("a", "fr", "x"), ("b", "en", "x"), ("c", None, "")], "_id string, lang string, corpus string")
    stores.serve({"served": scores, "served_rep": scores.limit(0)}, texts, spark.createDataFrame([("arc_fr", "fr")], "arc_corpus string, lang string"))
    assert {(r._id, r.arc_corpus, r.corpus) for r in spark.table("served_texts").collect()} == {("a", "arc_fr", "x"), ("c", "arc_fr", "s"), ("d", "own", "s"), ("a", "own", "x")}
    assert spark.table("served_rep_texts").count() == 0


def test_training_lines(spark, tmp_path):
    rows = [("t1", "c", 1712, "One two three. Four five? Six"), ("t2", "c", 1799, "Seven eight nine ten."), ("t3", "c", 1800, "Eleven twelve thirteen."), ("t4", None, 1705, "A b c. D e f."), ("t5", "c", None, "no year at all"), ("t6", "c", 1750, None)]
    texts = spark.createDataFrame(rows, "_id string, corpus string, year int, text string")
    got = {tuple(r) for r in stores.training_lines(texts, least=3).collect()}
    assert got == {("c", "1700-1800", "one two three"), ("c", "1700-1800", "four five six"), ("c", "1700-1800", "seven eight nine ten"), ("c", "1800-1900", "eleven twelve thirteen"), (None, "1700-1800", "a b c"), (None, "1700-1800", "d e f")}
    assert {r.line for r in stores.training_lines(texts, years=(1710, 1790), size=2).collect()} == {"one two", "three four", "five six"}
    few = stores.training_lines(texts, least=3, most=1, seed=4).groupBy("corpus", "period").count().collect()
    assert {(r.corpus, r.period, r["count"]) for r in few} == {("c", "1700-1800", 1), ("c", "1800-1900", 1), (None, "1700-1800", 1)}
    path, lines = str(tmp_path / "lines"), stores.training_lines(texts, least=3).where("corpus = 'c'")
    stores.write_training_lines(lines.where("period = '1700-1800'"), path)
    for _ in range(2):  # a period that is there isn't written again
        stores.write_training_lines(lines, path)
    assert spark.read.text(path).count() == 4 and list((tmp_path / "lines").glob("corpus=c/period=*/*.gz"))


def test_exact_samples(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    for n in (0, 1, 700, 2999, 3000, 5000):
        a, b = (sorted(r.id for r in R.exact_sample(x, "id", n, 1).collect()) for x in (df, df.repartition(5)))
        assert a == b and len(set(a)) == len(a) == min(n, 3000)
    assert [r["count"] for r in R.exact_sample(df, "id", 90, 1, ["k"]).groupBy("k").count().collect()] == [90] * 3
    assert R.exact_sample(df.withColumn("same", F.lit("x")), "same", 10, 1).count() == 10 and R.exact_sample(df.limit(0), "id", 5, 1).count() == 0


def test_lookups(spark, tmp_path):
    (tmp_path / "library.csv").write_text("_id,s\nx,1.5\n")
    (tmp_path / "stop.txt").write_text("The \n\nof\n")
    (tmp_path / "names.txt").write_text("of\nAnna\n")
    assert [r.s for r in readers.corpus_scores(spark, str(tmp_path), "library_fiction", {"library_": "library"}).collect()] == [1.5]
    with pytest.raises(FileNotFoundError):
        readers.corpus_scores(spark, str(tmp_path), "other", {"library_": "library"})
    assert {r.word for r in readers.word_set(spark, str(tmp_path / "stop.txt"), str(tmp_path / "names.txt")).collect()} == {"the", "of", "anna"}
    ids = spark.createDataFrame([("b/x%1", 2), ("a/x_1", 1)], "id string, n int")
    assert [r.id for r in readers.resolved(ids, "x_").collect()] == ["a/x_1"] and readers.resolved(ids, "none").count() == 0
    assert [r.id for r in readers.resolved(ids, "x", F.col("n").desc()).collect()] == ["b/x%1"]
    sinks.jsonl(ids, str(tmp_path / "out"))
    assert readers.any_table(spark, str(tmp_path / "out" / "*.json")).count() == 2
    df = spark.createDataFrame([("t", 1.0, 2.0)], "_id string, `Abs-Conc.PAV-Conc.C17` double, other double")
    assert R.score_columns(df) == df.columns[1:] and R.score_columns(df, ["other"]) == ["other"] and R.rated_columns(df) == [("Abs-Conc.PAV-Conc.C17", "PAV-Conc", "C17")]
    for wanted in ([], ["absent"]):
        with pytest.raises(ValueError):
            R.score_columns(df, wanted)


def test_original_norms(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "word string, value double")
    out = N.originals({"a": frame(("x", 1.0), ("y", 3.0), ("und", 1.0), ("z", None)), "b": frame(("x", 5.0), ("z", 7.0))}, ["a"], frame(("UND", 0.0)))
    got = {r.word: (r.a, r.b, r["median"]) for r in out.collect()}
    m, s = -5 / 3, (8 / 9) ** 0.5
    assert set(got) == {"x", "y", "z"} and got["y"][1] is None and got["z"] == (None, 1.0, 1.0)
    assert got["x"] == pytest.approx(((-1 - m) / s, -1.0, ((-1 - m) / s - 1) / 2)) and got["y"][0] == pytest.approx((-3 - m) / s)
