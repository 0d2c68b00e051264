"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

The tokenizer is a SentencePiece BPE model with identity normalisation, a dummy prefix and byte
fallback. None of its pieces holds the space mark after another character, or a line feed beside
another character, so no merge crosses those places: a text falls into pre-tokens (a run of marks, or
of line feeds, and what follows up to the next), and its count is the sum over them.

1. Every partition tallies pre-tokens and flushes its tally at a bounded size; a shuffle sums them.
2. The model counts the pieces of each distinct pre-token once; the dictionary is written to scratch.
3. The most frequent pre-tokens go to the tasks: all above the frequency that a histogram of 16 classes for each
   doubling puts within HEAD pre-tokens and HEAD_BYTES bytes, so nothing is sorted and no task gathers them. A
   second pass over the texts sums what the head knows and emits (row, pre-token, frequency) for the rest,
   which meet the dictionary in a shuffle join. No ids are made.

Null and empty texts count 0 bytes and 0 tokens; every input row gives one output row, repeated or null
doc_ids included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.runtime import Scratch, bound_batches, table

MODEL, LIMIT = "piece_bpe_32k.model", 4096
HEAD, HEAD_BYTES, HEAD_LONGEST = 1 << 18, 12 << 20, 1 << 16
FLUSH, FLUSH_CHARS = 400_000, 32 << 20

MARK = "▁"
PRETOKENS = re.compile(f"{MARK}+[^{MARK}\n]*|\n+[^{MARK}\n]*")


def pretokens(text: str | None) -> list[str]:
    return PRETOKENS.findall(MARK + text.replace(" ", MARK)) if text else []


def piece_counts(model, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The model puts a mark before what it is given: it replaces the first
    mark here, and is one piece more before a line feed."""
    own = [t[1:] if t[0] == MARK else t for t in tokens]
    return [1 if t == MARK else len(ids) - (t[0] != MARK) for t, ids in zip(tokens, model.encode(own, num_threads=1))]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    chars = 0  # of the texts since the last flush: more than the tally holds

    def flush():
        out = pa.RecordBatch.from_pydict({"pretoken": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for b in batches:
        for text in b.column("text").to_pylist():
            seen.update(pretokens(text))
            chars += len(text or "")
            if len(seen) >= FLUSH or (chars >= FLUSH_CHARS and sum(map(len, seen)) >= FLUSH_CHARS // 2):
                yield flush()
                chars = 0
            elif chars >= FLUSH_CHARS:
                chars = 0
    if seen:
        yield flush()


def dictionary(docs: DataFrame, model_path: str) -> DataFrame:
    """(pretoken, n, pieces) of every distinct pre-token of docs.text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(piece_counts(model, b.column("pretoken").to_pylist()), pa.int64())], ["pretoken", "n", "pieces"])

    tallied = docs.select("text").mapInArrow(_tally, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return tallied.mapInArrow(count, "pretoken string, n long, pieces long")


def frequent(pieces: DataFrame, head: int = HEAD, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(pretoken, pieces) of the most frequent ones, at most head of them and head_bytes bytes."""
    short = pieces.where(F.octet_length("pretoken") <= HEAD_LONGEST)
    level = F.floor(16 * F.log2("n")).cast("int")
    histogram = short.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.octet_length("pretoken")).alias("size")).collect()  # at most 16 x 64 rows
    least, n, size = 1 << 30, 0, 0
    for r in sorted(histogram, reverse=True):
        n, size = n + r["n"], size + r["size"]
        if n > head or size > head_bytes:
            break
        least = r["level"]
    return short.where(level >= least).select("pretoken", "pieces")


def token_counts(docs: DataFrame, model_path: str | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "tokens")
    docs = docs.select("doc_id", "text")
    pieces = scratch.save(dictionary(docs, model_path or public_tokenizers.path(MODEL)), "dictionary")
    known = spark.sparkContext.broadcast({r[0]: r[1] for r in frequent(pieces, head).collect()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for b in batches:
            sizes, sums, rest = [], [], []
            for text in b.column("text").to_pylist():
                total, rare = 0, {}
                for t in pretokens(text):
                    n = get(t)
                    if n is None:
                        rare[t] = rare.get(t, 0) + 1
                    else:
                        total += n
                sizes.append(len(text.encode()) if text else 0)
                sums.append(total)
                rest.append(list(rare.items()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, pa.map_(pa.string(), pa.int64()))],
                ["doc_id", "n_bytes", "n_known", "rest"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    # written, so that the row number is the same for both readers
    rows = scratch.save(docs.mapInArrow(split, f"doc_id {kind}, n_bytes long, n_known long, rest map<string,bigint>").withColumn("row", F.monotonically_increasing_id()), "rows")
    rare = rows.select("row", F.explode("rest").alias("pretoken", "freq")).join(pieces.select("pretoken", "pieces"), "pretoken")
    rare = rare.groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("n_rare"))
    total = F.col("n_known") + F.coalesce("n_rare", F.lit(0))
    return rows.drop("rest").join(rare, "row", "left").select("doc_id", "n_bytes", total.alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
