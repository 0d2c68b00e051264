"""Quality classifier: ordinal cumulative-link regression over hashed words.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector and ascending thresholds t. Features are the words (at white
space, lower case) hashed to FEATURES places, as logarithms of counts scaled to length one. Grades are
integers from 0; here quality + (1 - toxic) of `labels`, so 2 is good and clean.

Fitted in numpy on the driver on at most TRAIN_ROWS labelled documents, those with the smallest hashes of
doc_id; a training row has at most FEATURES numbers. The expected grade and the probability of
the top grade are given for every document; `selected` is that probability at SELECT or more.

Null and empty texts have no features and get what the thresholds alone say. A document that is labelled more than
once counts with its lowest grade, one with several texts trains with the smallest; labels with nulls are left out. Without labels every output is null and
selected false. Every input row gives one row; null doc_ids are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import sample
from lexitide.runtime import bound_batches, table

FEATURES, TRAIN_ROWS, EPOCHS, BATCH, RATE, DECAY, SELECT = 1 << 15, 12_000, 25, 256, 0.05, 1e-5, 0.5
CACHE = 300_000


class Hasher:
    """Places and weights of a text's words; remembers up to CACHE words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        own, known = (text.lower().split() if text else []), self.known
        if len(known) > CACHE:
            known.clear()
        at = np.empty(len(own), np.int64)
        for i, w in enumerate(own):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % FEATURES
            at[i] = h
        places, counts = np.unique(at, return_counts=True)
        weights = 1 + np.log(counts)
        return places, weights / (np.sqrt((weights**2).sum()) or 1.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1 - _sigmoid(self.thresholds - score)

    def grade(self, places: np.ndarray, values: np.ndarray) -> tuple[float, float]:
        """Expected grade, P(top grade)."""
        t = self.tails(float(self.weights[places] @ values))
        return float(t.sum()), float(t[-1])


def loss_and_slopes(score: np.ndarray, thresholds: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: -log P(y), its slope by the score, and by each threshold."""
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper, lower = _sigmoid(edges[y + 1] - score), _sigmoid(edges[y] - score)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    by_threshold = np.zeros((len(y), len(thresholds)))
    rows = np.arange(len(y))
    top, low = y < len(thresholds), y > 0
    by_threshold[rows[top], y[top]] -= du[top]
    by_threshold[rows[low], y[low] - 1] += dl[low]
    return -np.log(p), du - dl, by_threshold


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 5) -> Ordinal | None:
    """Mini-batch Adagrad. Thresholds are a first one and logarithms of the steps, so they stay ascending."""
    if not rows:
        return None
    grades = max(max(r[2] for r in rows), 1) + 1
    share = np.array([(sum(r[2] <= k for r in rows) + 1) / (len(rows) + 2) for k in range(grades - 1)])
    start = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(start), 0.1))
    w, first = np.zeros(FEATURES), float(start[0])
    gw, gt, rng = np.full(FEATURES, 1e-8), np.full(grades - 1, 1e-8), np.random.default_rng(seed)
    size, y = np.array([len(r[0]) for r in rows]), np.array([r[2] for r in rows])
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            at = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            own = np.repeat(np.arange(len(batch)), size[batch])
            score = np.bincount(own, w[at] * values, len(batch))
            thresholds = np.concatenate([[first], first + np.cumsum(np.exp(steps))])
            _, ds, dt = loss_and_slopes(score, thresholds, y[batch])
            g = np.bincount(at, ds[own] * values, FEATURES) / len(batch) + DECAY * w
            gw += g * g
            w -= 4 * RATE * g / np.sqrt(gw)
            dt = dt.mean(0)
            g = np.concatenate([[dt.sum()], np.exp(steps) * dt[1:][::-1].cumsum()[::-1]])
            gt += g * g
            move = RATE * g / np.sqrt(gt)
            first -= float(move[0])
            steps = steps - move[1:]
    return Ordinal(w, np.concatenate([[first], first + np.cumsum(np.exp(steps))]))


def fit(docs: DataFrame, grades: DataFrame, rows_bound: int = TRAIN_ROWS) -> Ordinal | None:
    """grades: doc_id, grade."""
    bound_batches(docs.sparkSession)
    lowest = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = sample(lowest, rows_bound, "doc_id")  # bounded, so it can be broadcast

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            out = [hasher(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array([o[0].astype("<i4").tobytes() for o in out], pa.binary()), pa.array([o[1].astype("<f4").tobytes() for o in out], pa.binary())], ["doc_id", "grade", "places", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    rows = labelled.mapInArrow(featured, f"doc_id {kind}, grade int, places binary, values binary").toLocalIterator()
    rows = sorted(rows, key=lambda r: str(r["doc_id"]))
    return train([(np.frombuffer(r["places"], "<i4").astype(np.int64), np.frombuffer(r["values"], "<f4").astype(float), r["grade"]) for r in rows])


def graded(docs: DataFrame, model: Ordinal | None, select: float = SELECT) -> DataFrame:
    """doc_id, expected_grade, tail_probability and selected of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), shared.value
        for b in batches:
            out = [own.grade(*hasher(t)) if own else (None, None) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "expected_grade", "tail_probability"])

    out = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, expected_grade double, tail_probability double")
    return out.withColumn("selected", F.coalesce(F.col("tail_probability") >= select, F.lit(False)))


def grades_of(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return graded(docs, fit(docs, grades_of(table(spark, sf_dir, "labels"))))
