"""Benchmark decontamination: a BM25 index of the test items, block-max WAND, then overlap of question and answer.

The items are the collection, the passages of every training document the queries: windows of words that
overlap so far that any occurrence of an item lies in one of them whole. Impacts are divided by the item's score against itself, so one
threshold holds for all items: a passage retrieves every item of which it reaches RETRIEVE of the own score. Items are indexed by
length, from one power of two to the next, so a long item widens no other's windows.
Items lie in blocks; each term has its largest impact for each block. A block is skipped if the sum of these for a
passage's terms doesn't reach the threshold; inside a block WAND moves to the pivot, the first item that the terms up to it could lift over the threshold. All this skips only what
can't reach the threshold.

Retrieved pairs are verified on the window's text: at least OVERLAP of the item's five-word shingles, of question and
answer together, QUESTION of the question's and OVERLAP of the words of its answer. The question is what stands before the last ? or, without one,
before the last sentence; an item of one sentence is split at three quarters.

Items are collected and broadcast in shards of about SHARD_WORDS words, by the words of the index itself, one pass over the documents for each;
what a pass finds or keeps is written before the next shard is read, so one index is in memory at a time and its
broadcast is released, whatever the size of the benchmark. Document frequencies and the mean length are those of all items,
counted in Spark where there are several shards, so scores don't depend on the shards. Null and empty texts, and items without words, match nothing.
Every input row gives its own rows; null doc_ids are kept; an empty table, of either kind, gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexitide.runtime import Scratch, bound_batches, table

K1, B = 1.2, 0.75
RETRIEVE, OVERLAP, QUESTION, SHINGLE = 0.65, 0.8, 0.6, 5
BLOCKS, STRIDE, SHARD_WORDS = 64, 64, 200_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    cut = text.rstrip().rstrip(".!?").rfind("?")
    if cut < 0:
        cut = max((m.start() for m in re.finditer(r"[.!?]\s", text.rstrip())), default=-1)
    question, answer = words(text[: cut + 1]), words(text[cut + 1 :])
    if not question or not answer:
        own = words(text)
        at = max(1, len(own) * 3 // 4) if len(own) > 1 else 0
        question, answer = own[:at], own[at:]
    return question, answer


def shingles(own: list[str]) -> set[tuple[str, ...]]:
    return {tuple(own[i : i + SHINGLE]) for i in range(max(1, len(own) - SHINGLE + 1))} if own else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: their number, mean length, and how many have each word (at least the words needed)."""

    n: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[tuple]) -> Statistics:
        tokens = [x for x in (words(t) for _, t in items) if x]
        return cls(len(tokens), float(np.mean([len(x) for x in tokens])) if tokens else 1.0, Counter(w for x in tokens for w in set(x)))


class Index:
    """Postings of items of similar length, by term: item numbers ascending and normalised impacts."""

    def __init__(self, items: list[tuple], known: Statistics | None = None):
        items = [(i, t) for i, t in items if words(t)]
        known = known or Statistics.of(items)
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        tokens = [words(t) for t in self.texts]
        n, mean, df = known.n, known.mean, known.df
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for x in tokens for w in x}))}
        own: list[dict[int, float]] = []
        for x in tokens:
            norm = K1 * (1 - B + B * len(x) / mean)
            s = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in Counter(x).items()}
            total = sum(s.values())
            own.append({self.vocabulary[w]: v / total for w, v in s.items()})
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for i, s in enumerate(own):
            for t, v in s.items():
                postings[t].append((i, v))
        self.items = [np.array([p[0] for p in ps], dtype=np.int64) for ps in postings]
        self.impacts = [np.array([p[1] for p in ps]) for ps in postings]
        self.block = max(1, -(-len(items) // BLOCKS))  # items of a block
        self.block_most = np.zeros((len(postings) or 1, max(1, -(-len(items) // self.block))), np.float32)
        for t, (x, v) in enumerate(zip(self.items, self.impacts)):
            np.maximum.at(self.block_most[t], x // self.block, np.nextafter(v.astype(np.float32), np.float32(2)))
        # a passage must reach past every item's length twice over
        self.stride = max([STRIDE, *(len(x) for x in tokens)])
        self.parts = [question_and_answer(t) for t in self.texts]
        self.shingles = [shingles(x) for x in tokens]

    def windows(self, n: int) -> list[tuple[int, int]]:
        """(start, end) of the passages of a text of n words."""
        size = 2 * self.stride + 16
        return [(i, min(n, i + size)) for i in range(0, max(1, n - self.stride), self.stride)]

    def retrieve(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """All (item, score) that reach the threshold for a passage of these distinct terms: block-max WAND."""
        bounds = self.block_most[terms].sum(0)
        if bounds.max() < RETRIEVE - 1e-5:
            return []
        out = []
        for b in np.nonzero(bounds >= RETRIEVE - 1e-5)[0].tolist():
            out += self._wand(terms[self.block_most[terms, b] > 0].tolist(), b)
        return out

    def _wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        low, high = block * self.block, (block + 1) * self.block
        cursors = []
        for t in terms:
            at = int(np.searchsorted(self.items[t], low))
            end = int(np.searchsorted(self.items[t], high))
            cursors.append([int(self.items[t][at]), at, end, t])
        out = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += float(self.block_most[c[3], block])
                if total >= RETRIEVE - 1e-5:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = sum(float(self.impacts[c[3]][c[1]]) for c in cursors if c[0] == item)
                if score >= RETRIEVE - 1e-9:
                    out.append((item, score))
                past = item + 1
            else:
                past = item
            for c in cursors:
                if c[0] < past:
                    c[1] += int(np.searchsorted(self.items[c[3]][c[1] : c[2]], past))
                    c[0] = int(self.items[c[3]][c[1]]) if c[1] < c[2] else high
            cursors = [c for c in cursors if c[1] < c[2]]
        return out

    def verify(self, item: int, passage: list[str]) -> tuple[float, float, float]:
        """Shares found in the passage: of all shingles of the item, the question's shingles, the answer's words."""
        held = shingles(passage)
        want = self.shingles[item]
        if len(want) == 1 and len(next(iter(want))) < SHINGLE:  # a very short item: as a run of words
            run = next(iter(want))
            found = any(tuple(passage[i : i + len(run)]) == run for i in range(len(passage) - len(run) + 1))
            return float(found), float(found), float(found)
        question, answer = self.parts[item]
        asked, bag = shingles(question), set(passage)
        q = len(asked & held) / len(asked) if len(question) >= SHINGLE else len(set(question) & bag) / max(1, len(set(question)))
        return len(want & held) / len(want), q, len(set(answer) & bag) / max(1, len(set(answer)))

    def matches(self, own: list[str]) -> list[tuple]:
        """(item_id, score, overlap, question, answer) of the verified items in a text of these words, each item's best passage."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in own], dtype=np.int64)
        best: dict[int, tuple] = {}
        if len(ids):
            for start, end in self.windows(len(ids)):
                terms = np.unique(ids[start:end])
                terms = terms[1:] if terms[0] < 0 else terms
                for item, score in self.retrieve(terms) if len(terms) else ():
                    overlap, q, a = self.verify(item, own[start:end])
                    if overlap >= OVERLAP and q >= QUESTION and a >= OVERLAP and (item not in best or (overlap, score) > (best[item][1], best[item][0])):
                        best[item] = (score, overlap, q, a)
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


class Indexes:
    """An index for each class of lengths: up to STRIDE words, twice that, four times, and so on."""

    def __init__(self, items: list[tuple], known: Statistics | None = None):
        known, classes = known or Statistics.of(items), {}
        for i, t in items:
            if n := len(words(t)):
                classes.setdefault(max(0, (n - 1) // STRIDE).bit_length(), []).append((i, t))
        self.parts = [Index(own, known) for _, own in sorted(classes.items())]

    def matches(self, text: str | None) -> list[tuple]:
        own = words(text)
        return [m for part in self.parts for m in part.matches(own)]


def shards(items: DataFrame, shard_words: int) -> tuple[int, Iterator[Indexes]]:
    """Their number, and indexes of about shard_words words (or one item) each, read one at a time."""
    spark = items.sparkSession

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [words(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(map(len, own), pa.int64()), pa.array([sorted(set(x)) for x in own], pa.list_(pa.string()))], ["shard", "length", "terms"])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(words(t)) for t in b.column("text").to_pylist()], pa.int64())], ["length"])

    total = items.select("text").mapInArrow(lengths, "length long").agg(F.sum("length")).collect()[0][0] or 0
    n = max(1, -(-total // shard_words))
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    return n, _indexes(items, n, terms)


def _indexes(items: DataFrame, n: int, terms) -> Iterator[Indexes]:
    spark = items.sparkSession
    if n > 1:
        scratch = Scratch(spark, "benchmark")
        counted = scratch.save(items.select("shard", "text").mapInArrow(terms, "shard int, length long, terms array<string>").where("length > 0"), "terms")
        number, mean = counted.agg(F.count("*"), F.avg("length")).collect()[0]
        each = counted.select("shard", F.explode("terms").alias("term"))
        df = scratch.save(each.groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    for k in range(n):
        part = [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == k).orderBy("item_id", "text").collect()]
        known = None
        if n > 1:  # the frequencies of the shard's own terms, no more than its words
            known = Statistics(number, mean, dict(df.join(each.where(F.col("shard") == k).select("term").distinct(), "term").select("term", "n").toLocalIterator()))
        yield Indexes(part, known)


def contaminated(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap and answer_overlap of every leaked item in docs."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind, item_type = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType
    names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
    scratch, found = Scratch(spark, "leaks"), []
    n, parts = shards(items.select("item_id", "text").where("text is not null"), shard_words)
    for part in parts:
        index = spark.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                at, rows = [], []
                for i, text in enumerate(b.column("text").to_pylist()):
                    for m in own.matches(text):
                        at.append(i)
                        rows.append(m)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], to_arrow_type(item_type)), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(1, 5))], names
                )

        leaks = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, item_id {item_type.simpleString()}, score double, overlap double, question_overlap double, answer_overlap double")
        if n > 1:
            leaks = scratch.save(leaks, "leaks")
            index.unpersist()
        found.append(leaks)
    return reduce(DataFrame.unionByName, found)


def uncontaminated(docs: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs, all columns, without the rows that hold an item; what passes a shard is written for the next one."""
    spark = docs.sparkSession
    bound_batches(spark)
    at = docs.columns.index("text")
    scratch, before = Scratch(spark, "unleaked"), None
    n, parts = shards(items.select("item_id", "text").where("text is not null"), shard_words)
    for k, part in enumerate(parts):
        index = spark.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                yield b.filter(pa.array([not own.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
        if k < n - 1:
            docs = scratch.save(docs, "kept")
            index.unpersist()
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
