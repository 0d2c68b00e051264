"""Packing: optimal length buckets from the global histogram, token-budget batches inside each bucket.

Texts longer than MAX_LEN tokens are cut into sequences of MAX_LEN and a rest, so no token is dropped and the
histogram has at most MAX_LEN rows, however large the corpus. Dynamic programming over it picks the BUCKETS
upper bounds with the least total padding. A batch of a bucket holds BUDGET // bound sequences, each padded
to the bound. Batches are numbered by a rank in the bucket, taken in two steps: ranks within small chunks
(bucket and hash of the document) and a running sum over the chunks' sizes; so a bucket that holds most
sequences is spread over many tasks.

Lengths are UTF-8 bytes, the tokens of a byte-level model, unless a length column is named. Null and
empty texts have one sequence of length 0 with null bucket and batch. Repeated rows are packed each; ties are
ordered by doc_id, seq and the row's own number. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexitide.runtime import Scratch, table

MAX_LEN, BUCKETS, BUDGET, CHUNK = 8192, 16, 65_536, 100_000

BOUNDS = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("bucket_len", T.IntegerType())])


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper bounds of at most k buckets with the least sum of count x (bound - length).

    lengths ascend, without repeats. best[j] = min over i < j of best[i] + lengths[j-1] x (number in i..j); the
    best i never falls as j grows, so each layer is found by halving, whole levels at a time."""
    n = len(lengths)
    if n <= k:
        return [int(x) for x in lengths]
    number = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    bound = lengths.astype(np.float64)
    best = np.concatenate([[0.0], bound * number[1:]])  # one bucket
    came = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, k):
        new, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        level = [(1, n, 0, n - 1)]
        while level:
            below = []
            for lo, hi, a, b in level:
                j = (lo + hi) // 2
                i = np.arange(a, min(b, j - 1) + 1)
                cost = best[i] + bound[j - 1] * (number[j] - number[i])
                m = int(np.argmin(cost))
                new[j], arg[j] = cost[m], i[m]
                if lo < j:
                    below.append((lo, j - 1, a, int(i[m])))
                if j < hi:
                    below.append((j + 1, hi, int(i[m]), b))
            level = below
        came.append(arg)
        best = new
    out, j = [], n
    for arg in reversed(came):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(arg[j])
    return sorted(set(out))


def pack(docs: DataFrame, length: str | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """A row for each sequence: doc_id, seq, start and n_tokens (in tokens of the document), bucket, bucket_len, batch, slot."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    own = F.col(length) if length else F.octet_length("text")
    sized = docs.select("doc_id", F.greatest(F.coalesce(own.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("size") - 1) / max_len), F.lit(0)))
    seqs = sized.select("doc_id", "size", F.explode(cuts).alias("seq")).select(
        "doc_id",
        "seq",
        (F.col("seq") * max_len).alias("start"),
        F.least(F.col("size") - F.col("seq") * max_len, F.lit(max_len)).cast("int").alias("n_tokens"),
    )
    seqs = scratch.save(seqs.withColumn("row", F.monotonically_increasing_id()), "sequences")

    histogram = seqs.where("n_tokens > 0").groupBy("n_tokens").count().collect()  # at most max_len rows
    lengths = np.array(sorted(r["n_tokens"] for r in histogram), dtype=np.int64)
    count = {r["n_tokens"]: r["count"] for r in histogram}
    bounds = optimal_bounds(lengths, np.array([count[x] for x in lengths.tolist()], dtype=np.int64), buckets) if len(lengths) else []
    of = np.searchsorted(bounds, lengths)
    chosen = spark.createDataFrame([(int(n), int(b), int(bounds[b])) for n, b in zip(lengths, of)], BOUNDS)

    chunks = max(1, -(-sum(count.values()) // chunk))
    placed = seqs.join(F.broadcast(chosen.withColumnRenamed("length", "n_tokens")), "n_tokens", "left")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "seq", "row"), F.lit(chunks)))
    ahead = placed.where("bucket is not null").groupBy("bucket", "part").count()
    ahead = ahead.withColumn("ahead", F.sum("count").over(Window.partitionBy("bucket").orderBy("part")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "seq", "row")) - 1 + F.coalesce("ahead", F.lit(0))
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("bucket_len")), F.lit(1))
    ranked = placed.join(ahead, ["bucket", "part"], "left").withColumn("rank", rank)
    return ranked.select(
        "doc_id",
        "seq",
        "start",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.when(F.col("bucket").isNotNull(), F.floor(F.col("rank") / capacity)).alias("batch"),
        F.when(F.col("bucket").isNotNull(), F.col("rank") % capacity).alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
