"""Hard-negative mining: product quantisation with stored residual norms, exact integer scores for what its bounds let through.

Vectors are integers. Pairs of components are coded by the nearest of CODES centres; a row keeps its codes and the norm of what they
leave, its residual. An anchor's table of products with the centres gives a row's score by look-ups, and the residual's norm
times the anchor's bounds the error (Cauchy and Schwarz), so lower and upper bounds of every score are certain:

1. Positives: in a slice of rows, those whose upper bound reaches the k-th lower bound, or the k-th exact score so far, are scored exactly.
2. Negatives: each positive opens a window of scores. Rows of other labels whose bounds meet the window are kept, unless the limit's-th lower
   bound of those surely inside is above them; these are scored exactly.

So nothing can be lost, whatever the centres, which are fitted on a sample of at most SAMPLE rows, on the first PAIRS pairs of components; further
pairs use the same centres in turn. Anchors (a stated share of the rows) meet all rows in blocks: slices of rows of about
SLICE_BYTES by groups of anchors of about GROUP_BYTES, each pair of them a group of a cogroup. A group emits a few best rows for each anchor;
Spark merges them.

Rows with a null id or label, a null vector or a null or non-finite component take no part, nor do those whose squares sum to 2^62 or more, as their scores may not fit
64 bits. Rows repeated whole count once. A row never is its own id's positive or negative. Vectors of
different lengths don't meet. Ties go to the smaller id. Anchors without positives, and windows without rows, give none. Empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.llm.bounds import sample
from lexitide.runtime import Scratch, bound_batches, table

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SAMPLE, CODES, PAIRS, ROUNDS = 8192, 256, 64, 4
SLICE_BYTES, GROUP_BYTES, SLICE_ROWS = 32 << 20, 8 << 20, 2048
ROWS, ANCHORS = 8192, 64  # of one table of bounds


def centres_of(points: np.ndarray) -> np.ndarray:
    """[PAIRS, CODES, 2] by k-means over the pairs of components of sampled rows; from distinct starting points."""
    out = np.zeros((PAIRS, CODES, 2))
    for p in range(min(PAIRS, points.shape[1] // 2)):
        x = points[:, 2 * p : 2 * p + 2]
        c = np.unique(x, axis=0)
        c = c[np.linspace(0, len(c) - 1, min(CODES, len(c))).astype(int)]
        for _ in range(ROUNDS):
            near = nearest(x, c)
            n = np.bincount(near, minlength=len(c))
            sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in (0, 1)], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out[p, : len(c)] = c
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1)[None, :] - 2 * part @ c.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])


def even(x: np.ndarray) -> np.ndarray:
    """Columns in pairs; a zero fills the last."""
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def encode(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of components and norms of the residuals."""
    x = even(x.astype(np.float64))
    codes, rest = np.zeros((len(x), x.shape[1] // 2), np.uint8), np.zeros(len(x))
    for p in range(codes.shape[1]):
        own, c = x[:, 2 * p : 2 * p + 2], centres[p % PAIRS]
        codes[:, p] = nearest(own, c)
        rest += ((own - c[codes[:, p]]) ** 2).sum(1)
    return codes, np.sqrt(rest)


class Rows:
    """Rows of one vector length as arrays."""

    def __init__(self, t: pa.Table, dim: int):
        self.key, self.id, self.label = (t[c].to_numpy() for c in ("key", "vec_id", "label"))
        self.x = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim).astype(np.int64)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(1))
        self.codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(t), (dim + 1) // 2)
        self.residual = t["residual"].to_numpy()


def bounds(anchors: Rows, some: slice, rows: Rows, part: slice, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of scores [row, anchor]; rounding of the doubles is allowed for."""
    q = even(anchors.x[some].astype(np.float64))
    score = np.zeros((len(rows.id[part]), len(q)))
    for p in range(rows.codes.shape[1]):
        lookup = centres[p % PAIRS] @ q[:, 2 * p : 2 * p + 2].T
        score += lookup[rows.codes[part, p]]
    error = (rows.residual[part] * (1 + 1e-9) + 1e-9 * rows.norm[part])[:, None] * anchors.norm[some][None, :] + 1e-6
    return score - error, score + error


def kth(values: np.ndarray, k: int) -> float:
    return -np.partition(-values, k - 1)[k - 1] if len(values) >= k else -np.inf


class Best:
    """The k best (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        """A score below this can't be among the best."""
        return float(self.score[-1]) - 1 if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def best_positives(anchors: Rows, rows: Rows, centres: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor key, id, score): the k best of the same label in these rows."""
    best = [Best(k) for _ in anchors.id]
    for a in range(0, len(anchors.id), ANCHORS):
        for r in range(0, len(rows.id), ROWS):
            lower, upper = bounds(anchors, slice(a, a + ANCHORS), rows, slice(r, r + ROWS), centres)
            label, ids = rows.label[r : r + ROWS], rows.id[r : r + ROWS]
            for j in range(lower.shape[1]):
                i = a + j
                own = np.flatnonzero((label == anchors.label[i]) & (ids != anchors.id[i]))
                own = own[upper[own, j] >= max(best[i].floor(), kth(lower[own, j], k))]
                best[i].add(rows.x[own + r] @ anchors.x[i], ids[own])
    for key, b in zip(anchors.key.tolist(), best):
        yield from ((key, x, s) for x, s in zip(b.id.tolist(), b.score.tolist()))


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and largest score with low * positive <= 100 * score <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def best_negatives(anchors: Rows, windows: list[list[tuple[int, int, int]]], rows: Rows, centres: np.ndarray, k: int) -> Iterator[tuple]:
    """(anchor key, number, id, score): of these rows the k best of other labels in each window (number, least, largest) of an anchor."""
    best = [[Best(k) for _ in w] for w in windows]
    for a in range(0, len(anchors.id), ANCHORS):
        for r in range(0, len(rows.id), ROWS):
            lower, upper = bounds(anchors, slice(a, a + ANCHORS), rows, slice(r, r + ROWS), centres)
            label, ids = rows.label[r : r + ROWS], rows.id[r : r + ROWS]
            for j in range(lower.shape[1]):
                i = a + j
                other = np.flatnonzero((label != anchors.label[i]) & (ids != anchors.id[i]))
                low_, high_, wanted = lower[other, j], upper[other, j], np.zeros(len(other), bool)
                for (_, least, most), b in zip(windows[i], best[i]):
                    sure = low_[(low_ >= least) & (high_ <= most)]
                    wanted |= (high_ >= max(least, b.floor(), kth(sure, k))) & (low_ <= most)
                own = other[wanted]
                score, found = rows.x[own + r] @ anchors.x[i], ids[own]
                for (_, least, most), b in zip(windows[i], best[i]):
                    inside = (score >= least) & (score <= most)
                    b.add(score[inside], found[inside])
    for key, w, own in zip(anchors.key.tolist(), windows, best):
        for (number, _, _), b in zip(w, own):
            yield from ((key, number, x, s) for x, s in zip(b.id.tolist(), b.score.tolist()))


def _met(rows: DataFrame, anchors: DataFrame, slices: int, groups: int, work: Callable, columns: list[str]) -> DataFrame:
    """work(anchors' table, rows' table, length) for each slice of rows and group of anchors of one length."""
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("part", every(slices)).withColumn("group", deal("key", groups))
    right = rows.withColumn("part", deal("key", slices)).withColumn("group", every(groups))

    def join(key, a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(work(a, b, key[0].as_py())) if len(a) and len(b) else []
        return pa.table([pa.array(list(c), pa.int64()) for c in (zip(*found) if found else [[]] * len(columns))], columns)

    keys = ["dim", "part", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(join, ", ".join(f"{c} long" for c in columns))


def mine(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, slice_bytes: int = SLICE_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, v (array of whole doubles)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "negatives")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**31))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    own = vectors.where("vec_id is not null and label is not null and v is not null").where(whole).where(squares < 2.0**62)
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("v", lambda x: x.cast("int")).alias("v"))
    own = own.distinct().withColumn("dim", F.size("v")).withColumn("key", F.monotonically_increasing_id())
    own = scratch.save(own, "rows")
    drawn = sample(own.select("key", F.slice("v", 1, 2 * PAIRS).alias("v")), SAMPLE, "key").collect()
    widest = max((len(r["v"]) for r in drawn), default=0)
    # shorter rows don't teach the later pairs much: zeros stand in
    shared = spark.sparkContext.broadcast(centres_of(even(np.array([list(r["v"]) + [0] * (widest - len(r["v"])) for r in drawn], dtype=np.float64).reshape(len(drawn), widest))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes, residual = [b""] * len(dims), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = b.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                c, residual[at] = encode(x, shared.value)
                for i, row in zip(at, c):
                    codes[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(residual)], [*b.schema.names, "codes", "residual"])

    coded = own.select("key", "vec_id", "label", "dim", "v").mapInArrow(code, "key long, vec_id long, label long, dim int, v array<int>, codes binary, residual double")
    coded = scratch.save(coded, "coded")
    chosen = spark.read.schema(coded.schema).parquet(coded._scratch_path).where(anchor)
    size = coded.agg(F.count("*").alias("n"), F.sum("dim").alias("all"), F.sum(F.when(anchor, F.col("dim"))).alias("anchors")).collect()[0]
    # at least as many slices as keep the cores busy
    slices = max(1, -(-5 * (size["all"] or 0) // slice_bytes), min(2 * spark.sparkContext.defaultParallelism, size["n"] // SLICE_ROWS))
    groups = max(1, -(-5 * (size["anchors"] or 0) // group_bytes))

    def seek_positives(a: pa.Table, b: pa.Table, dim: int) -> Iterator[tuple]:
        return best_positives(Rows(a, dim), Rows(b, dim), shared.value, positives)

    near = _met(coded, chosen, slices, groups, seek_positives, ["key", "positive_id", "positive_score"])
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"))
    near = scratch.save(near.withColumn("number", rank.cast("long")).where(F.col("number") <= positives), "positives")
    listed = near.groupBy("key").agg(F.collect_list(F.struct("number", "positive_score")).alias("positives"))

    def seek_negatives(a: pa.Table, b: pa.Table, dim: int) -> Iterator[tuple]:
        windows = [[(p["number"], *window_of(p["positive_score"], low, high)) for p in ps] for ps in a["positives"].to_pylist()]
        return best_negatives(Rows(a, dim), windows, Rows(b, dim), shared.value, negatives)

    far = _met(coded, chosen.join(listed, "key"), slices, groups, seek_negatives, ["key", "number", "negative_id", "negative_score"])
    rank = F.row_number().over(Window.partitionBy("key", "number").orderBy(F.desc("negative_score"), "negative_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    ids = chosen.select("key", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["key", "number"]).join(ids, "key").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def times_256(x: Column) -> Column:
    """floor(256 x) as a double; what is null, not finite or far beyond an integer's range stays so."""
    y = x.cast("double") * 256
    return F.when(F.abs(y) < 2.0**31, F.floor(y).cast("double")).otherwise(y)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.transform("embedding", times_256).alias("v"))
    return mine(rows, F.col("vec_id") % 100 == 0)


SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
    FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
