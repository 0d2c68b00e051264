"""Word vectors trained on Spark, and the norms that follow from them.

Skip-gram with negative sampling, in its expected form: a pair of words counts as often as it stands in a window, and the negatives of a
word are weighed by their probabilities instead of being drawn. So one co-occurrence count by pair replaces the corpus, however
large that is, and training is the same on every layout.

Words are hashed to shards. Pairs are counted in chunks of lines, as numbers, and travel as arrays: a row holds a chunk's pairs of two shards. In a
round each task holds the vectors of two shards and the counts of their pairs; no two tasks of a round share a word, so all shards are trained at once, and after as
many rounds as there are shards every pair was met
(stratified gradient descent). Within a task shards are cut into parts, which meet each other in the same way. A task holds two shards' vectors, their pairs and
a few rows of likelihoods, whatever the corpus and the frequency of a word. Many models (corpora, periods, runs) are trained side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.operators import embeddings, scoring
from lexitide.operators.norms import wide
from lexitide.runtime import Scratch, find_package

SHARD, PARTS, TILE = 2048, 8, 64  # words of a part of a shard, about; parts of a shard at most; rows of likelihoods in memory
SHARDS, CHAIN = 48, 8  # shards that a large vocabulary has at least, for the cores; rounds between two saved states
PLACES, CHUNKS = 1 << 21, 64  # places of a chunk of lines, about; chunks at least
KNOWN = 5  # known words that are sent to the tasks at most, as a multiple of scoring.HEAD
NEGATIVES, NOISE, FREQUENT = 5, 0.75, 1e-3
RATE, STEPS = 0.1, 3


def vocabulary(sentences: DataFrame, models: list[str], least: int) -> DataFrame:
    """(models, word, n) of words that stand at least so often in a model's sentences (words array)."""
    return sentences.select(*models, F.explode("words").alias("word")).groupBy(*models, "word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def pairs(sentences: DataFrame, models: list[str], window: int) -> DataFrame:
    """(models, a, b, n): a stands before b within the window; n counts a distance of d as (window + 1 - d) / window.

    That is how often windows of all widths up to the largest hold the pair. Counts are added up before the shuffle."""
    at = F.sequence(F.lit(1), F.least(F.lit(window), F.size("words") - 1 - F.col("__i")))
    rows = sentences.where(F.size("words") > 1).select(*models, "words", F.posexplode("words").alias("__i", "a")).where(F.col("__i") < F.size("words") - 1)
    met = F.explode(F.transform(at, lambda d: F.struct(F.get("words", F.col("__i") + d).alias("b"), (window + 1 - d).cast("long").alias("w")))).alias("__p")
    rows = rows.select(*models, "a", met).select(*models, "a", F.col("__p.b").alias("b"), F.col("__p.w").alias("w"))
    return rows.groupBy(*models, "a", "b").agg((F.sum("w") / window).alias("n"))


def _chunks(sentences: DataFrame, models: list[str]) -> DataFrame:
    """(models, words, chunk): lines of two words at least; a chunk is a run of rows of one task, of about PLACES words."""
    lines = sentences if "_scratch_path" in vars(sentences) else Scratch(sentences.sparkSession, "pairs").save(sentences.select(*models, "words"), "lines")
    held = lines.agg(F.count("*").alias("rows"), F.sum(F.greatest(F.size("words"), F.lit(1))).alias("places")).collect()[0]
    each = max(1, min(held["rows"] * PLACES // max(1, held["places"] or 1), -(-held["rows"] // CHUNKS)))
    rows = lines.select(*models, "words", F.monotonically_increasing_id().alias("__at"))  # the same each time: files and their splits stay
    own = F.floor(F.col("__at").bitwiseAND((1 << 33) - 1) / each)
    return rows.select(*models, "words", (F.shiftright("__at", 33) * (1 << 32) + own).alias("chunk")).where(F.size("words") > 1)


def _met(lines: pa.Array, own: pa.Array, window: int):
    """a, b, w of the pairs of places in lines of words, by each word's place in own, a <= b, sorted, each pair once; runs of lines of about PLACES words."""
    ends = np.cumsum(pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(PLACES, ends[-1] if len(ends) else 0, PLACES)), [len(ends)]]))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        some = lines.slice(lo, hi - lo)
        code = pc.fill_null(pc.index_in(some.flatten(), value_set=own), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        line = np.repeat(np.arange(hi - lo), pc.list_value_length(some).to_numpy(zero_copy_only=False))
        found = []
        for d in range(1, window + 1):
            x, y = code[:-d], code[d:]
            at = np.flatnonzero((line[:-d] == line[d:]) & (x >= 0) & (y >= 0))
            x, y = x[at], y[at]
            found.append((np.minimum(x, y) * len(own) + np.maximum(x, y)) * window + (d - 1))
        keys = np.sort(np.concatenate(found))
        pair = keys // window
        starts = np.flatnonzero(np.diff(pair, prepend=-1))
        if len(starts):
            w = np.add.reduceat(window - (keys - pair * window), starts)
            pair = pair[starts]
            a = pair // len(own)
            yield a, pair - a * len(own), w


def _bytes(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def _weights(low, high) -> np.ndarray:
    return np.frombuffer(low, np.uint8) + (np.frombuffer(high, "<u4").astype(np.int64) << 8)


def _told(lines: pa.Array, known: tuple, window: int) -> pa.Table:
    """(a, b, w, kept) of the lines' pairs by ids, a <= b. known: words, their ids and kept."""
    words, ids, kept = known
    out = [[np.empty(0, np.int64)] * 3 + [np.empty(0)]]
    out += [[np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), w, kept[a] * kept[b]] for a, b, w in _met(lines, words, window)]
    return pa.table([np.concatenate(c) for c in zip(*out)], names=["a", "b", "w", "kept"])


BLOCK = ["one", "two", "p", "q", "low", "high"]


def _blocks(rows: list[tuple]) -> pa.Table:
    one, two, *rest = zip(*rows) if rows else [()] * 6
    return pa.table([pa.array(one, pa.int32()), pa.array(two, pa.int32()), *(pa.array(c, pa.binary()) for c in rest)], names=BLOCK)


def _packed(lines: pa.Array, known: tuple, window: int, shards: int, small: str) -> pa.Table:
    """BLOCK of the lines' pairs, and the sums of their words. known is sorted by shard and place."""
    words, ids, kept = known
    shard, place, out = ids % shards, (ids // shards).astype(small), []
    for a, b, w in _met(lines, words, window):
        block = shard[a] * shards + shard[b]
        order = np.argsort(block.astype(np.uint16 if shards <= 256 else np.int64), kind="stable")
        p, q, low, high, block = place[a][order], place[b][order], (w & 255).astype(np.uint8)[order], (w >> 8).astype("<u4")[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
        out += [(int(block[i] // shards), int(block[i] % shards), *_bytes(p[i:j], q[i:j], low[i:j], high[i:j])) for i, j in zip(cuts[:-1], cuts[1:])]
        f = np.bincount(a, w * kept[b], len(ids)) + np.bincount(b, w * kept[a], len(ids))
        here = np.flatnonzero(f)
        cuts = np.flatnonzero(np.diff(shard[here], prepend=-1, append=-1))
        out += [(int(shard[here[i]]), -1, *_bytes(place[here[i:j]]), b"", *_bytes(f[here[i:j]]), b"") for i, j in zip(cuts[:-1], cuts[1:])]
    return _blocks(out)


def _merged(one: int, two: int, parts: pa.Table, small: str) -> pa.Table:
    """BLOCK of one row: the rows of parts added up."""
    p, q, low, high = (b"".join(parts[c].to_pylist()) for c in BLOCK[2:])
    p, q = np.frombuffer(p, small).astype(np.int64), np.frombuffer(q, small).astype(np.int64)
    if two < 0:
        f = np.bincount(p, np.frombuffer(low))
        p = np.flatnonzero(f)
        return _blocks([(one, two, *_bytes(p.astype(small)), b"", *_bytes(f[p]), b"")])
    w, pair = _weights(low, high), (p << 32) | q
    order = np.sort((((p << 16) | q) << 31) | np.arange(len(p))) & ((1 << 31) - 1) if small == "<u2" else np.argsort(pair, kind="stable")
    pair = pair[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    w, pair = np.add.reduceat(w[order], starts), pair[starts]
    return _blocks([(one, two, *_bytes((pair >> 32).astype(small), (pair & ((1 << 32) - 1)).astype(small), (w & 255).astype(np.uint8), (w >> 8).astype("<u4")))])


def numbered_pairs(sentences: DataFrame, models: list[str], window: int, words: DataFrame, shards: int = 0) -> DataFrame:
    """(models, a, b, n, kept): pairs() in either order, by the ids of words (models, word, id, kept), a <= b; kept is the product of theirs.

    Words that aren't known keep their places. Up to KNOWN times scoring.HEAD known words are sent to the tasks, and lines stay where they are; beyond that lines are shuffled
    once, by chunks, and meet the known words of their chunk. Weights are added up as whole numbers, so their order doesn't matter.

    With shards an id is place * shards + shard, and the result (models, one, two, p, q, low, high) has a row for two shards, one <= two: bytes of the pairs'
    places (sorted) and of their weights, in windows of one place each (low the last byte). The row with two = -1 has the places of the words of one, and as low the doubles that are
    the sums of weight and the other word's kept over each word's pairs."""
    spark = sentences.sparkSession
    find_package(spark)
    top = words.agg(F.max("id").alias("id"), F.count("*").alias("n")).collect()[0]
    known = words.select(*models, "word", "id", "kept")
    small = "<u2" if shards and (top["id"] or 0) // shards < 1 << 16 else "<u4"
    types = "".join(f"`{c}` {t}, " for c, t in sentences.select(*models).dtypes)
    schema = types + ("one int, two int, p binary, q binary, low binary, high binary" if shards else "a long, b long, w long, kept double")

    def held(own: pa.Table) -> tuple:
        ids = own["id"].to_numpy()
        order = np.lexsort((ids // max(1, shards), ids % max(1, shards)))
        return own["word"].combine_chunks().take(pa.array(order)), ids[order], own["kept"].to_numpy()[order]

    def counted(key, lines: pa.Array, own: tuple) -> pa.Table:
        out = _packed(lines, own, window, shards, small) if shards else _told(lines, own, window)
        return pa.table([*(pa.repeat(k, len(out)) for k in key), *out.columns], names=[*models, *out.column_names])

    if top["n"] <= KNOWN * scoring.HEAD:
        sent = spark.sparkContext.broadcast(known.toArrow())

        def of_task(batches):
            own = sent.value
            keys = pa.Table.from_batches(own.select(models).to_batches()).group_by(models).aggregate([]).to_pylist() if models else [{}]
            kinds = {c: own.schema.field(c).type for c in models}
            mine = {}
            for k in keys:
                same = pa.array(np.ones(len(own), bool))
                for c, v in k.items():
                    same = pc.and_(same, pc.equal(own[c], pa.scalar(v, kinds[c])))
                mine[tuple(k.values())] = held(own.filter(same))
            waiting = {k: [] for k in mine}
            for batch in batches:
                own_keys = list(zip(*(batch[c].to_pylist() for c in models))) if models else [()] * len(batch)
                rows = {}
                for i, k in enumerate(own_keys):
                    rows.setdefault(k, []).append(i)
                for k, at in rows.items():
                    if k in mine:
                        waiting[k].append(batch["words"] if len(at) == len(batch) else batch["words"].take(pa.array(at)))
                        if sum(len(x.flatten()) for x in waiting[k]) >= PLACES:
                            yield from flushed(k, waiting, mine, kinds)
            for k in mine:
                yield from flushed(k, waiting, mine, kinds)

        def flushed(k, waiting, mine, kinds):
            lines, waiting[k] = waiting[k], []
            if lines:
                yield from counted([pa.scalar(v, t) for v, t in zip(k, kinds.values())], pa.concat_arrays(lines), mine[k]).combine_chunks().to_batches()

        met = sentences.where(F.size("words") > 1).select(*models, "words").mapInArrow(of_task, schema)
    else:
        lines = _chunks(sentences, models)
        keys = [*models, "chunk"]
        own = lines.select(*(F.col(c).alias(c) for c in keys), F.explode("words").alias("word")).distinct().join(known, [*models, "word"])

        def of_chunk(key, lines: pa.Table, own: pa.Table) -> pa.Table:
            return counted(key[: len(models)], lines["words"].combine_chunks().slice(0, len(lines) if len(own) else 0), held(own))

        met = lines.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(of_chunk, schema)
    if not shards:
        return met.groupBy(*models, "a", "b").agg((F.sum("w") / window).alias("n"), F.first("kept").alias("kept"))

    def merged(key, parts):
        out = _merged(*(k.as_py() for k in key[len(models) :]), parts, small)
        return pa.table([*(pa.repeat(k, len(out)) for k in key[: len(models)]), *out.columns], names=[*models, *BLOCK])

    return met.groupBy(*models, "one", "two").applyInArrow(merged, schema)


def visit(count: np.ndarray, negative: np.ndarray, inner: np.ndarray, outer: np.ndarray, seen_inner: np.ndarray, seen_outer: np.ndarray, rate: float, steps: int) -> None:
    """Gradient steps on a block, in place, of both sides at once. count[a, b] are the pairs, negative[a, b] the expected negatives; each row's step is divided by
    the root of its summed squares so far."""
    for _ in range(steps):
        likely = 1 / (1 + np.exp(-np.clip(inner @ outer.T, -30, 30)))
        pull = count - (count + negative) * likely
        for one, seen, step in ((inner, seen_inner, pull @ outer), (outer, seen_outer, pull.T @ inner)):
            seen += (step**2).mean(1)
            one += rate * step / np.sqrt(seen + 1e-12)[:, None]


def visit_few(pairs: tuple, f: np.ndarray, noise: np.ndarray, inner: np.ndarray, outer: np.ndarray, seen_inner: np.ndarray, seen_outer: np.ndarray, rate: float, steps: int) -> None:
    """visit() of pairs that are few among the cells: rows and columns (sorted by row, each pair once) with their counts; negatives are NEGATIVES * f * noise, above 0 for words with pairs.

    Likelihoods are single precision, for TILE rows at a time, and serve both sides. A pair goes into its cell as a share of the cell's negatives, so that one product has both."""
    a, b, n = pairs
    often, noise = (NEGATIVES / 2 * f).astype(np.float32), noise.astype(np.float32)
    share = (n / (NEGATIVES / 2 * f[a] * noise[b])).astype(np.float32)
    cuts = np.searchsorted(a, np.arange(0, len(inner) + TILE, TILE))
    cells = np.empty((min(TILE, len(inner)), len(outer)), np.float32)
    for _ in range(steps):
        one, two = inner.astype(np.float32), outer.astype(np.float32)
        half, noisy, weighed = np.ascontiguousarray(two.T) / 2, noise[:, None] * two, often[:, None] * one
        pull, back = np.empty_like(one), np.zeros_like(two)
        for t, lo, hi in zip(range(0, len(one), TILE), cuts, cuts[1:]):
            tile = slice(t, min(t + TILE, len(one)))
            x = cells[: tile.stop - t]
            np.tanh(np.matmul(one[tile], half, out=x), out=x)
            x += 1  # twice the likelihood
            at = a[lo:hi] - t, b[lo:hi]
            twice = x[at]
            x[at] = twice - share[lo:hi] * (1 - twice / 2)
            np.matmul(x, noisy, out=pull[tile])
            back += x.T @ weighed[tile]
        for vectors, seen, step in ((inner, seen_inner, -often[:, None] * pull), (outer, seen_outer, -noise[:, None] * back)):
            seen += (step**2).mean(1)
            vectors += rate * step / np.sqrt(seen + 1e-12)[:, None]


def _meet(a: np.ndarray, b: np.ndarray, n: np.ndarray, ends: tuple, f: np.ndarray, noise: np.ndarray, sides: list[tuple]) -> None:
    """Visits all parts of two shards, in turns. a, b, n: their pairs, sorted by a; ends: where the parts end; sides: vectors and their seen sums, for each run."""
    parts, rows = len(ends[0]) - 1, np.searchsorted(a, ends[0])
    for turn in range(parts):
        for i in range(parts):
            j = (i + turn) % parts
            (i0, i1), (j0, j1), own = ends[0][i : i + 2], ends[1][j : j + 2], slice(rows[i], rows[i + 1])
            here = np.flatnonzero((b[own] >= j0) & (b[own] < j1)) + own.start
            if len(here):
                few = (a[here] - i0, b[here] - j0, n[here])
                for inner, outer, seen_inner, seen_outer in sides:
                    visit_few(few, f[i0:i1], noise[j0:j1], inner[i0:i1], outer[j0:j1], seen_inner[i0:i1], seen_outer[j0:j1], RATE, STEPS)


def _start(words: DataFrame, models: list[str], size: int, seed: int) -> DataFrame:
    """words with vector, the inner one by hash and then the outer, which is smaller, and with what each has seen."""
    draw = lambda side, width: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((F.pmod(F.xxhash64("word", F.lit(seed), *models, F.lit(side), i), F.lit(1 << 20)) / float(1 << 20) - 0.5) * width).cast("float"))
    return words.withColumn("vector", F.concat(draw(0, 1.0 / size), draw(1, 0.1 / size))).withColumn("seen", F.lit(0.0)).withColumn("seen_outer", F.lit(0.0))


def train(sentences: DataFrame, models: list[str], size: int = 100, window: int = 10, least: int = 10, epochs: int = 5, seed: int = 0, shard: int = SHARD, runs: int = 0, words: DataFrame | None = None) -> DataFrame:
    """(models, word, vector) of sentences (models, words array): a model for each value of the columns models.

    With runs so many of each, from other starts, told apart by a further column run; their pairs are counted once. words: their vocabulary(), if it is saved already."""
    spark = sentences.sparkSession
    find_package(spark)
    scratch = Scratch(spark, "vectors")
    named = [*models, "run"] if runs else models
    words = scratch.save(vocabulary(sentences, models, least), "words") if words is None else words
    total = words.groupBy(*models).agg(F.sum("n").alias("__all"), F.sum(F.col("n") ** NOISE).alias("__noise"), F.count("*").alias("__words"))
    largest = total.agg(F.max("__words").alias("w"), F.count("*").alias("m")).collect()[0]
    if not largest["m"]:
        return words.withColumn("run", F.lit(0)).select(*named, "word", F.array().cast("array<double>").alias("vector"))
    # enough shards for the memory, and for many cores, whatever this session has; a shard is visited in parts of about `shard` words
    shards = max(1, -(-largest["w"] // (shard * PARTS)), min(SHARDS, -(-largest["w"] // shard), -(-largest["w"] // 64)))
    parts = -(-largest["w"] // (shard * shards))
    share = F.col("n") / F.col("__all")
    kept = F.least(F.lit(1.0), F.sqrt(FREQUENT / share) + FREQUENT / share)  # of frequent words some places are passed over
    deal = F.pmod(F.xxhash64("word"), F.lit(shards * parts)).cast("int")
    # kept has twenty binary digits, so that sums with it are exact in any order
    words = words.join(total, models).select(*models, "word", "n", deal.alias("deal"), (F.round(kept * (1 << 20)) / float(1 << 20)).alias("kept"), (F.col("n") ** NOISE / F.col("__noise")).alias("noise"))
    words = words.select("*", (F.col("deal") % shards).alias("shard"), F.floor(F.col("deal") / shards).cast("int").alias("part"))
    # a shard's words in the order of their parts: at most a few times shard * PARTS rows
    place = F.row_number().over(Window.partitionBy(*models, "shard").orderBy("part", "word")) - 1
    words = words.withColumn("place", place).withColumn("id", F.col("place").cast("long") * shards + F.col("shard"))
    words = scratch.save(words, "weights")
    # a round meets shards whose numbers add up to it, or to it and their count
    met = numbered_pairs(sentences, models, window, words, shards).withColumn("round", F.when(F.col("two") < 0, -1).otherwise((F.col("one") + F.col("two")) % shards))
    path = f"{scratch.base}/met"
    met.write.partitionBy("round").parquet(path)
    met = spark.read.schema(met.schema).parquet(path)

    def weights(batches):
        for batch in batches:
            for k in range(len(batch)):
                f = np.frombuffer(batch["low"][k].as_py())
                p = np.frombuffer(batch["p"][k].as_py(), f"<u{len(batch['p'][k].as_py()) // max(1, len(f))}" if len(f) else "<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch[c][k], len(p)) for c in models), pa.repeat(batch["one"][k], len(p)), pa.array(p), pa.array(f)], names=[*models, "shard", "place", "f"])

    named_types = "".join(f"`{c}` {t}, " for c, t in words.select(*models).dtypes)
    weight = met.where("round = -1").mapInArrow(weights, f"{named_types}shard int, place int, f double")
    own = words.join(weight, [*models, "shard", "place"], "left").withColumn("f", F.coalesce(F.col("f") * F.col("kept") / window, F.lit(0.0)))
    own = own.withColumn("noise", F.when(F.col("f") > 0, F.col("noise")).otherwise(0.0))  # words without pairs take no part
    if runs:
        own = own.withColumn("run", F.explode(F.array(*(F.lit(r) for r in range(runs)))))
    state = _start(own, named, size, seed).select(*named, "shard", "part", "place", "noise", "f", "kept", "vector", "seen", "seen_outer")
    state = scratch.save(state, "state")
    columns, schema = state.columns, state.schema

    def block(key, own: pa.Table, params: pa.Table) -> pa.Table:
        params = params.select(columns)
        if not len(own) or not len(params):
            return params
        params = params.take(pc.sort_indices(params, sort_keys=[(c, "ascending") for c in (*named[len(models) :], "shard", "place")])).combine_chunks()
        one, two = own["one"][0].as_py(), own["two"][0].as_py()
        each = len(params) // max(1, runs)
        shard, part, f, noise, kept = (params[c].to_numpy()[:each] for c in ("shard", "part", "f", "noise", "kept"))
        vectors = params["vector"].combine_chunks().flatten().to_numpy().reshape(len(params), -1)
        inner, outer = vectors[:, :size].copy(), vectors[:, size:].copy()
        seen, seen_outer = params["seen"].to_numpy().copy(), params["seen_outer"].to_numpy().copy()
        cut = int(np.searchsorted(shard, two)) if one < two else 0
        first, second = slice(0, cut if one < two else each), slice(cut, each)
        ends = [np.searchsorted(part[x], np.arange(parts + 1)) for x in (first, second)]
        low = own["low"][0].as_py()
        p, q = (np.frombuffer(x, f"<u{len(x) // len(low)}").astype(np.int64) for x in (own["p"][0].as_py(), own["q"][0].as_py()))
        n = _weights(low, own["high"][0].as_py()) / window * kept[first][p] * kept[second][q]

        def sides(x: slice, y: slice) -> list[tuple]:
            runs_ = ((slice(r + x.start, r + x.stop), slice(r + y.start, r + y.stop)) for r in range(0, len(params), each))
            return [(inner[x], outer[y], seen[x], seen_outer[y]) for x, y in runs_]

        if one < two:
            _meet(p, q, n, ends, f[first], noise[second], sides(first, second))
            order = np.argsort(q.astype(np.uint16) if ends[1][-1] <= 1 << 16 else q, kind="stable")
            _meet(q[order], p[order], n[order], ends[::-1], f[second], noise[first], sides(second, first))
        else:  # each pair is met from both its words, one with itself twice
            other = p < q
            p, q, n = np.concatenate([p, q[other]]), np.concatenate([q, p[other]]), np.concatenate([np.where(other, n, 2 * n), n[other]])
            order = np.lexsort((q, p))
            _meet(p[order], q[order], n[order], ends, f, noise, sides(first, second))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(params) + 1) * 2 * size, pa.int32()), pa.array(np.hstack([inner, outer]).ravel()))
        for c, new in (("vector", flat), ("seen", pa.array(seen)), ("seen_outer", pa.array(seen_outer))):
            params = params.set_column(params.schema.get_field_index(c), c, new)
        return params

    keys = [*models, "block"]
    lanes = 4 * largest["m"] * (shards // 2 + 1)  # tasks for the blocks of a round; most have none
    saved = state
    for _ in range(epochs):
        for r in range(shards):
            held = state.withColumn("block", F.least("shard", F.pmod(r - F.col("shard"), F.lit(shards)))).repartition(lanes, *keys)
            own = met.where(F.col("round") == r).select(*models, F.col("one").alias("block"), *BLOCK).repartition(lanes, *keys)
            state = own.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(block, schema)
            if (r + 1) % CHAIN == 0 or r + 1 == shards:
                state = scratch.save(state, "state")
                scratch.drop(saved)
                saved = state
    out = state.where("f > 0").join(words.select(*models, "shard", "place", "word"), [*models, "shard", "place"])
    return out.select(*named, "word", F.slice("vector", 1, size).cast("array<double>").alias("vector"))


def vector_norms(sentences: DataFrame, poles: DataFrame, runs: int = 1, **how) -> tuple[DataFrame, list[str]]:
    """From sentences (corpus, period, words) to norms: word and a column contrast.period for each, and these columns' names.

    A model for each corpus, period and run; z-scores of the cosine with each contrast's axis; medians over runs, then over corpora.
    poles: contrast, word, band (pos, neg). Runs start from different vectors."""
    scratch = Scratch(sentences.sparkSession, "norms")
    by = ["corpus", "period", "run"]
    vectors = scratch.save(train(sentences, by[:2], runs=runs, **how), "vectors")
    scores = scratch.save(embeddings.axis_scores(vectors, embeddings.axes(vectors, poles, by), by), "scores")
    out = embeddings.over_runs(scores).withColumn("name", F.concat_ws(".", "contrast", "period"))
    out = scratch.save(out, "medians")
    names = sorted(r["name"] for r in out.select("name").distinct().collect())  # contrasts times periods
    return wide(out, ["word"], "name", "z", names), names


def nearest(vectors: DataFrame, of: DataFrame, models: list[str], k: int) -> DataFrame:
    """(models, word, other, cosine): the k nearest words of each word of `of` (models, word), a stated set, by cosine."""
    unit = F.transform("vector", lambda x: x / F.sqrt(embeddings.dot(F.col("vector"), F.col("vector"))))
    own = Scratch(vectors.sparkSession, "nearest").save(vectors.select(*models, "word", unit.alias("unit")), "unit")
    asked = own.join(of.select(*models, "word").distinct(), [*models, "word"], "left_semi")
    other = own.select(*models, F.col("word").alias("other"), F.col("unit").alias("__u"))
    met = asked.join(other, models).where("word <> other").select(*models, "word", "other", embeddings.dot(F.col("unit"), F.col("__u")).alias("cosine"))
    from lexitide.operators.shape import top_k

    return top_k(met, [*models, "word"], k, F.desc("cosine"), "other")
