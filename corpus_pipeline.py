"""From documents to packed training sequences: five stages, each one of the operators over all that is left.

A stage takes (spark, docs, sf_dir) and returns documents with all their columns; the last returns sequences.
Rows with null doc_ids pass the stages that go by doc_id; extra columns are carried along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.llm import op3_packing, op4_pii, op6_neardup, op7_language, op8_decontaminate
from lexitide.runtime import Scratch, table

#: Documents that go or repeat (ids and hashes) are broadcast, up to this number; more of them are joined in a shuffle.
LOOKED_UP = 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; the rest goes."""
    return op7_language.identified(docs, op7_language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id.

    Of rows with one doc_id and text the one whose columns, written as JSON, sort first stays. Rows with null doc_ids all stay."""
    text_key = F.xxhash64("text")
    found = op6_neardup.near_duplicates(docs, by_text=True).select("doc_id", "text_key", "kept")
    rows = docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"), text_key.alias("text_key")).agg(F.count("*").alias("n"))
    # only what goes or repeats travels on: a document that is neither meets nothing
    known = found.join(rows, ["doc_id", "text_key"]).where("not kept or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("kept").alias("__kept"))
    known = Scratch(spark, "pipeline").save(known, "copies")
    if known.count() <= LOOKED_UP:
        known = F.broadcast(known)  # the texts stay where they are
    here = (docs["doc_id"].cast("long") == known["__id"]) & (text_key == known["__key"])
    clean = docs.join(known, here, "left_anti")
    first = Window.partitionBy("__id", "__key").orderBy(F.to_json(F.struct(*docs.columns)))
    repeated = docs.join(known.where("__kept"), here).withColumn("__n", F.row_number().over(first)).where("__n = 1").select(docs.columns)
    return clean.unionByName(repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op8_decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = op4_pii.redacted(docs, op4_pii.fit(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches."""
    return op3_packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models and MinHash have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
