"""Every stage on awkward documents and on planted ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lexitide.llm import registry
from tests.llm.conftest import awkward_rows


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = docs
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = (before, docs)
    return out


def test_columns_stay(staged):
    for name, (before, after) in staged.items():
        assert name == "packing" or after.schema.simpleString() == before.schema.simpleString()


def test_decisions_take_effect(spark, sf, staged):
    before, after = staged["near_duplicates"]
    assert after.count() < before.count() == before.select("doc_id").distinct().count()
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda df: {r.doc_id for r in df.collect() if any(i in " ".join(r.text.split()) for i in items)}
    before, after = staged["decontamination"]
    assert holds(before) and not holds(after)
    before, after = staged["personal_data"]
    email = F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")
    assert before.where(email).count() > 0 == after.where(email).count() and after.count() == before.count()
    assert after.where("n_chars <> length(text)").count() == 0
    before, after = staged["packing"]
    assert after.agg(F.sum("n_tokens")).collect()[0][0] == before.agg(F.sum(F.octet_length("text"))).collect()[0][0]


def test_clean_documents_stay(staged):
    before, after = staged["language"]
    assert after.count() >= 0.99 * before.count()


def test_awkward_documents(spark, sf, awkward, empty):
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
        out = stage(spark, awkward, sf)
        n = out.count()
        if name != "packing":
            assert out.columns == awkward.columns
        if name == "near_duplicates":  # a repeated row and a copy go; the null doc_id stays
            assert n == len(awkward_rows()) - 2
        if name in ("decontamination", "personal_data"):
            assert n == len(awkward_rows())


def test_run_and_registry(spark, sf):
    assert len(pipeline.STAGES) == 5 and pipeline.run(spark, sf).count() > 0
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_copies_go_without_a_shuffle_of_texts(spark, awkward, monkeypatch):
    """What goes is looked up, however low Spark's own limit for broadcasts; beyond the pipeline's bound it is joined with the same result."""
    docs = awkward.unionByName(awkward)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        looked = pipeline.near_duplicates(spark, docs, "")
        assert "SortMergeJoin" not in looked._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(pipeline, "LOOKED_UP", 0)
        joined = pipeline.near_duplicates(spark, docs, "")
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, looked.collect())) == sorted(map(repr, joined.collect())) and looked.count() == len(awkward_rows()) - 1  # the row without a doc_id stays twice
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
