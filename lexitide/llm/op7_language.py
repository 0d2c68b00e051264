"""Language identification: a bidirectional gated recurrent network over bytes labels every position.

Words (at ASCII white space, A-Z lower-cased, cut every SEGMENT bytes) are the sequences; the state starts
anew at each, so the network's output for a word depends on the word alone, and a task runs it once for each distinct
word it meets and counts it as often as it occurs. Every byte gets a label distribution from the
forward and the backward state; a document's probabilities are the normalised geometric mean over all its positions.

The network is trained in numpy by backpropagation through time on the driver, on at most TRAIN_WORDS
(language, word, count) rows, counted over at most TRAIN_DOCS labelled documents (whole texts; repeated rows count
once). Both bounds are shared out by language, rare ones whole and the others alike, each with the smallest hashes: the number
of unlabelled rows doesn't matter, and every language has at least one document, even beyond the bound.
Documents with crc32(doc_id) mod 5 = 0 never take part.

Null texts and texts without a letter are `und` with score 1; every other text is `und` with score 0 if nothing is labelled.
Every input row gives one row, null or repeated doc_ids included (a null doc_id isn't held out); other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.runtime import Scratch, bound_batches, table

HIDDEN, SEGMENT, TRAIN_DOCS, TRAIN_WORDS, STEPS, BATCH, RATE = 12, 24, 4000, 40_000, 1500, 256, 0.01
CACHE, SLICE = 500_000, 4096
LEAST = 0.5  # a document below it is in none of the languages; chance gives one over their number
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def segments(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return [w[i : i + SEGMENT] for w in words for i in range(0, len(w), SEGMENT)] if max(map(len, words), default=0) > SEGMENT else words


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Parameters by name; every direction has input weights by byte, recurrent weights, biases."""

    labels: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng, p = np.random.default_rng(seed), {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            p[f"u{d}"] = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            p[f"c{d}"] = np.zeros(3 * hidden, np.float32)
        p["o"] = rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(np.float32)
        p["q"] = np.zeros(len(labels), np.float32)
        return cls(labels, p)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, word, hidden] of sequences x [word, time]; keep gets what the way back needs."""
        wx, u, c = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        hidden = len(u)
        h, out = np.zeros((len(x), hidden), wx.dtype), np.empty((x.shape[1], len(x), hidden), wx.dtype)
        for t in range(x.shape[1]) if d == "f" else reversed(range(x.shape[1])):
            a, b = wx[x[:, t]] + c, h @ u
            gates = _sigmoid(a[:, : 2 * hidden] + b[:, : 2 * hidden])
            z, r = gates[:, :hidden], gates[:, hidden:]
            n = np.tanh(a[:, 2 * hidden :] + r * b[:, 2 * hidden :])
            if keep is not None:
                keep.append((t, h, z, r, n, b[:, 2 * hidden :]))
            h = n + z * (h - n)
            out[t] = h
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """[time, word, label] of sequences of equal length."""
        s = np.concatenate([self.states(x, "f"), self.states(x, "b")], 2) @ self.p["o"] + self.p["q"]
        s -= s.max(2, keepdims=True)
        return s - np.log(np.exp(s).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, every one labelled y, and its gradients."""
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], 2)
        s = h @ self.p["o"] + self.p["q"]
        s -= s.max(2, keepdims=True)
        e = np.exp(s)
        e /= e.sum(2, keepdims=True)
        own, count = np.arange(len(x)), x.size
        loss = -np.log(e[:, own, y] + 1e-12).mean()
        e[:, own, y] -= 1
        e /= count
        g = {"o": np.einsum("twh,twk->hk", h, e), "q": e.sum((0, 1))}
        back = e @ self.p["o"].T
        hidden = h.shape[2] // 2
        for d, part in (("f", back[:, :, :hidden]), ("b", back[:, :, hidden:])):
            u = self.p[f"u{d}"]
            gx, gu, carried = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), 0.0
            gc = np.zeros_like(self.p[f"c{d}"])
            for t, before, z, r, n, bn in reversed(kept[d]):
                dh = part[t] + carried
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dn], 1)
                db = np.concatenate([dz, dr, dn * r], 1)
                gu += before.T @ db
                np.add.at(gx, x[:, t], da)
                gc += da.sum(0)
                carried = dh * z + db @ u.T
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return float(loss), g


def train(rows: list[tuple[str, bytes, int]], steps: int = STEPS, seed: int = 7) -> Network | None:
    """A network from (language, word, count) rows, by Adam; words are drawn by the square root of their counts."""
    labels = sorted({r[0] for r in rows})
    rows = sorted(r for r in rows if r[1])
    if not rows:
        return None
    net, rng = Network.fresh(labels, seed=seed), np.random.default_rng(seed)
    by_length: dict[int, list] = {}
    for lang, word, n in rows:
        by_length.setdefault(len(word), []).append((word, labels.index(lang), n**0.5))
    sets = []
    for length, own in sorted(by_length.items()):
        w = np.array([o[2] for o in own])
        sets.append((np.array([list(o[0]) for o in own], dtype=np.uint8), np.array([o[1] for o in own]), np.cumsum(w) / w.sum(), w.sum() * length))
    pick = np.cumsum([s[3] for s in sets]) / sum(s[3] for s in sets)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y, w, _ = sets[min(int(np.searchsorted(pick, rng.random())), len(sets) - 1)]
        at = np.minimum(np.searchsorted(w, rng.random(BATCH)), len(x) - 1)
        _, g = net.gradients(x[at], y[at])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, a in net.p.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] ** 2 - v[k])
            a -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def shares(counts: dict[str, int], bound: int) -> dict[str, int]:
    """How many of its rows each language gives: all of a rare one, the same of the others, at least one."""
    out, left = {}, bound
    for i, (n, lang) in enumerate(sorted((n, lang) for lang, n in counts.items())):
        out[lang] = min(n, max(1, left // (len(counts) - i)))
        left -= out[lang]
    return out


def smallest(rows: DataFrame, bound: int) -> DataFrame:
    """(lang, cut): the share of bound of each language are its rows (lang, h), distinct, with h up to cut."""
    spark, most = rows.sparkSession, (1 << 63) - 1
    tally = {r["lang"]: (r["n"], r["low"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).collect()}
    share = shares({lang: n for lang, (n, _) in tally.items()}, bound)
    # hashes that are surely enough, a little over the bound in all, come to the driver
    tops = [(lang, max(low, int(min(1, (share[lang] + 6 * share[lang] ** 0.5 + 20) / n) * most))) for lang, (n, low) in tally.items() if share[lang] < n]
    near: dict[str, list[int]] = {}
    if tops:
        for r in rows.join(F.broadcast(spark.createDataFrame(tops, "lang string, top long")), "lang").where("h <= top").select("lang", "h").collect():
            near.setdefault(r["lang"], []).append(r["h"])
    cuts = [(lang, sorted(near[lang])[: share[lang]][-1] if lang in near else most) for lang in tally]
    return spark.createDataFrame(cuts, "lang string, cut long")


def training_words(docs: DataFrame, docs_bound: int = TRAIN_DOCS, words_bound: int = TRAIN_WORDS) -> list[tuple[str, bytes, int]]:
    scratch = Scratch(docs.sparkSession, "language")
    own_hash = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1).alias("h")
    labelled = docs.where(~held_out("doc_id") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang"), own_hash(F.col("doc_id").cast("string"), F.col("text")))
    cuts = smallest(scratch.save(labelled.select("lang", "h").distinct(), "hashes"), docs_bound)
    sample = labelled.join(F.broadcast(cuts), "lang").where("h <= cut").groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally: dict = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                for w in segments(text):
                    tally[lang, w] = tally.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.binary()), pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])

    words = sample.mapInArrow(cut, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.first(own_hash("word")).alias("h"))
    words = scratch.save(words, "words")
    words = words.join(F.broadcast(smallest(words.select("lang", "h"), words_bound)), "lang").where("h <= cut")
    return [(r["lang"], bytes(r["word"]), r["n"]) for r in words.collect()]


class Scorer:
    """Sums of log probabilities over the positions of documents, with a bounded memory of words."""

    def __init__(self, net: Network):
        self.net, self.known, self.sums = net, {}, np.zeros((0, len(net.labels)), np.float32)

    def learn(self, words) -> None:
        """Run the network on the words that aren't known; all of words are known afterwards."""
        new = {w for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known, self.sums, new = {}, self.sums[:0], set(words)
        words = sorted(new, key=len)
        out, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and j - i < SLICE and len(words[j]) == len(words[i]):
                j += 1
            x = np.frombuffer(b"".join(words[i:j]), np.uint8).reshape(j - i, -1)
            out.append(self.net.log_probabilities(x).sum(0))
            i = j
        for n, w in enumerate(words, len(self.sums)):
            self.known[w] = n
        self.sums = np.concatenate([self.sums, *out]) if out else self.sums

    def __call__(self, own: list[bytes]) -> tuple[str, float]:
        """Label and probability of a document of these segments."""
        total, count = np.zeros(len(self.net.labels)), 0
        for i in range(0, len(own), CACHE // 2):  # a very long text by parts
            part = own[i : i + CACHE // 2]
            try:
                at = [self.known[w] for w in part]
            except KeyError:  # the memory was cleared, or the words are new
                self.learn(part)
                at = [self.known[w] for w in part]
            total += self.sums[at].sum(0, dtype=np.float64)
            count += sum(map(len, part))
        mean = total / count
        e = np.exp(mean - mean.max())
        e /= e.sum()
        best = int(e.argmax())
        return self.net.labels[best], float(e[best])


def fit(docs: DataFrame, docs_bound: int = TRAIN_DOCS, words_bound: int = TRAIN_WORDS) -> Network | None:
    bound_batches(docs.sparkSession)
    return train(training_words(docs, docs_bound, words_bound))


def _labels(score: Scorer | None, texts: list[str | None]) -> list[tuple[str, float]]:
    cut = [segments(t) if t and _LETTER.search(t) else [] for t in texts]
    if score:  # the network likes large slices
        fresh: set[bytes] = set()
        for own in cut:
            if len(fresh) + len(own) <= CACHE // 2:
                fresh.update(own)
        score.learn(fresh)
    return [(UNKNOWN, float(score is not None or not own)) if not own or not score else score(own) for own in cut]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(net) if net else None
        for b in batches:
            out = _labels(score, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, net: Network | None, least: float = LEAST, languages: frozenset[str] | None = None) -> DataFrame:
    """docs, all columns, without the rows whose language is unknown, scores below least or isn't one of languages (None: all that were learned)."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(net) if net else None
        for b in batches:
            out = _labels(score, b.column(at).to_pylist())
            yield b.filter(pa.array([label != UNKNOWN and p >= least and (languages is None or label in languages) for label, p in out], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
