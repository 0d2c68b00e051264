"""Ranked lexical search: sort-based accumulation of impacts, one ranking of all documents for each item.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Weights are integers, scores 64-bit
integers, so a ranking doesn't depend on how documents are dealt to tasks.

1. Documents are tokenised once into a saved forward index: length, and the frequency of each term that an item holds. The number of
   documents, their total length and the document frequencies are sums over it.
2. A task takes its documents in batches. The postings of a batch meet the terms' lists of items: (item, document, impact) arrays are
   concatenated, at most IMPACTS at a time, with keys of the item in the high and the document in the low bits. Keys are radix sorted by 16-bit digits; documents
   come in order and the sort is stable, so only the item's digits are sorted. Sums of equal keys by reduceat are the scores.
3. Heaps hold the best k of each item in the task; a score below an item's k-th is dropped before it gets there. The heaps' rows are
   merged in Spark, by item and salt, then by item.

Items are taken in ranges of their hash, of about RANGE_BYTES of text and RANGE_ITEMS items, and each range is a pass over the documents; its lists
are broadcast, so a broadcast is bounded whatever the size of the benchmark (but for a single item that is itself larger). No impacts are
shuffled: a document's scores are complete in its task.

Null and empty texts, and those without a term, are no documents and find nothing. Each row of the documents counts as one, so repeated rows are
ranked each; null doc_ids come last among equal scores. Repeated rows of items count once; an item_id with several texts has a ranking for
each. Long texts are tokenised in pieces that end between terms. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexitide.runtime import Scratch, bound_batches, table

TOP = 20
IMPACTS = 2_000_000
RANGE_BYTES, RANGE_ITEMS = 4 << 20, 20_000
PIECE = 1 << 20
SALTS = 32

#: Bytes of terms stay, A-Z lower-cased; all others become spaces. UTF-8 bytes of non-ASCII characters are 0x80 and more.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, in lists of about PIECE bytes."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE) if at + PIECE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def radix_order(keys: np.ndarray, low: int, high: int) -> np.ndarray:
    """Stable order of keys by their bits from low up to high, least digit first; numpy sorts 16-bit digits by radix."""
    order = None
    for shift in range(low, high, 16):
        digit = ((keys if order is None else keys[order]) >> np.uint64(shift)).astype(np.uint16)
        step = np.argsort(digit, kind="stable")
        order = step if order is None else order[step]
    return np.arange(len(keys)) if order is None else order


class Lists:
    """A range of items: vocabulary, and for each term the items that hold it and how often."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        own = []
        for _, text in items:
            counts: Counter = Counter()
            for p in pieces(text):
                counts.update(p)
            own.append({self.vocabulary.setdefault(t, len(self.vocabulary)): c for t, c in counts.items()})
        term = np.array([t for x in own for t in x], dtype=np.int64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(term, kind="stable")
        self.item = item[order]
        self.repeats = np.array([c for x in own for c in x.values()], dtype=np.int64)[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary)))])

    def weigh(self, n: int, total: int, df: dict[int, int]) -> None:
        self.n, self.total = n, total
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.vocabulary))], dtype=np.int64)


def forward(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with terms; terms are those of the vocabulary only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.vocabulary
        for b in batches:
            ids, sizes, terms, tfs = [], [], [], []
            for i, text in zip(b.column("doc_id").cast(pa.int64()).to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                n, found = 0, Counter()
                for p in pieces(text or b""):
                    n += len(p)
                    found.update([known[t] for t in p if t in known])
                if n:
                    ids.append(i)
                    sizes.append(n)
                    terms.append(np.fromiter(found.keys(), np.int32, len(found)))
                    tfs.append(np.fromiter(found.values(), np.int32, len(found)))
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")


def accumulate(lists: Lists, n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) of all pairs with a common term; documents have n terms and size postings each, in term and tf."""
    doc = np.repeat(np.arange(len(n)), size)
    m = 75 + (25 * n * lists.n) // lists.total
    impact = lists.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    matched = lists.start[term + 1] - lists.start[term]
    upto = np.concatenate([[0], np.cumsum(matched)])
    ends = np.concatenate([[0], np.cumsum(size)])  # a document's postings stay together
    bits = max(1, int(len(lists.ids) - 1).bit_length())
    at = 0
    while at < len(n):
        last = max(at + 1, int(np.searchsorted(upto[ends], upto[ends[at]] + IMPACTS, "right")) - 1)
        own = slice(ends[at], ends[last])
        at = last
        count = matched[own]
        posting = np.repeat(np.arange(own.start, own.stop), count)
        entry = np.arange(len(posting)) - np.repeat(upto[own] - upto[own.start], count) + lists.start[term[posting]]
        key = (lists.item[entry].astype(np.uint64) << np.uint64(32)) | doc[posting].astype(np.uint64)
        order = radix_order(key, 32, 32 + bits)
        key = key[order]
        if len(key):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            score = np.add.reduceat((impact[posting] * lists.repeats[entry])[order], first)
            yield (key[first] >> np.uint64(32)).astype(np.int64), (key[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), score


def best_of(rows: DataFrame, shared, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of each item, of each task's documents."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = shared.value
        heaps: list[list] = [[] for _ in lists.ids]
        least = np.ones(len(lists.ids), dtype=np.int64)  # scores below an item's are of no use
        for b in batches:
            size = b.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            term, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            ids = b.column("doc_id").to_pylist()
            place = np.array([math.inf if i is None else i for i in ids], dtype=object)
            rank = np.empty(len(ids), dtype=np.int64)
            rank[sorted(range(len(ids)), key=place.__getitem__)] = np.arange(len(ids))
            for item, doc, score in accumulate(lists, b.column("n").to_numpy(), size, term, tf):
                may = score >= least[item]
                item, doc, score = item[may], doc[may], score[may]
                order = np.lexsort((rank[doc], -score, item))
                item, doc, score = item[order], doc[order], score[order]
                first = np.concatenate([[True], item[1:] != item[:-1]]) if len(item) else np.zeros(0, bool)
                ahead = np.arange(len(item)) - np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
                for i, d, s in zip(item[ahead < k].tolist(), doc[ahead < k].tolist(), score[ahead < k].tolist()):
                    heap, entry = heaps[i], (s, -place[d])
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        least[i] = heap[0][0]
        for i in range(0, len(heaps), 1000):
            out = [(j, lists.ids[j], None if p == -math.inf else -p, s) for j, h in enumerate(heaps[i : i + 1000], i) for s, p in h]
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(select, "item int, item_id long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int = TOP, range_bytes: int = RANGE_BYTES, range_items: int = RANGE_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of items (item_id, text) over docs (doc_id, text)."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "search")
    own = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    own = scratch.save(own.withColumn("at", F.shiftrightunsigned(F.xxhash64("item_id", "text"), 1) / F.lit(float(1 << 63))), "items")
    size = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()[0]
    ranges = max(1, -(-(size["bytes"] or 0) // range_bytes), -(-size["n"] // range_items))
    found = []
    for r in range(ranges):
        texts = own.where((F.col("at") >= r / ranges) & (F.col("at") < (r + 1) / ranges if r + 1 < ranges else F.lit(True)))
        lists = Lists([(x["item_id"], x["text"].encode()) for x in texts.toLocalIterator()])
        if not lists.vocabulary:
            continue
        shared = spark.sparkContext.broadcast(lists)
        rows = scratch.save(forward(docs, shared), "forward")
        shared.destroy()
        total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).collect()[0]
        if not total["n"]:
            break
        df = {x["term"]: x["count"] for x in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator()}
        lists.weigh(total["n"], total["terms"], df)
        lists.vocabulary = {}  # the numbers do from here on
        shared = spark.sparkContext.broadcast(lists)
        found.append(scratch.save(best_of(rows, shared, k).withColumn("range", F.lit(r)), "best"))
        shared.destroy()
        scratch.drop(rows)
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    best = reduce(DataFrame.unionByName, found).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for by in (["range", "item", "salt"], ["range", "item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""WITH i AS (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
  q AS (SELECT item_id, item, term, count(*) AS r FROM (SELECT item_id, item, unnest(terms) AS term FROM i) GROUP BY ALL),
  d AS (SELECT doc_id, row_number() OVER () AS doc, {_TERMS} AS terms FROM documents),
  s AS (SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
  p AS (SELECT doc_id, doc, CAST(len(terms) AS BIGINT) AS size, unnest(terms) AS term FROM d),
  t AS (SELECT doc_id, doc, size, term, count(*) AS tf FROM p SEMI JOIN q USING (term) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term, n),
  x AS (SELECT item_id, item, doc_id, doc, sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // total)))) AS score
    FROM t JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL),
  o AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 20"""
