"""MinHash near-duplicates with odd sketches.

A document's set are its distinct word shingles; two documents are linked if 100 x intersection >= 80 x union.

1. One pass makes a 128-bit fingerprint of each set, HASHES MinHash values, BANDS band keys of ROWS values each,
   and an odd sketch: each MinHash value with its position flips one of SKETCH bits. Documents with equal fingerprints are one
   class, with a number of its own, whose text is read from the document with the smallest doc_id.
2. Band keys that two or more classes share are buckets. Round one pairs each member with the bucket's
   smallest, so a bucket of m members makes m - 1 pairs. Pairs whose sketches put the similarity clearly below the
   threshold are dropped (the population count of the XOR estimates it), the rest is verified on the full sets.
3. The links are joined to components. A pair that is in one component can't change the result, so what is left
   are pairs of a bucket's members in different components. Small buckets (up to SMALL members) pair them in a join. In
   larger ones the members outside the bucket's largest component look at all members, by sketches: blocks of about CHUNK lookers
   meet blocks of about CHUNK members (fewer where their sets are large: BLOCK_SHINGLES), so members are copied once for each block of lookers. In round two the likeliest partner
   of each looker in every other component comes out and is verified; in round three, where members are still apart, a block verifies all
   likely partners itself, through an inverted index of its shingles, and yields one link at most between a member
   and a component. So the rows that come out don't grow with the square of a bucket.
4. Classes with over a thousandth of the documents, under a thousand, are broadcast to their documents; the others are joined.

The chance that a pair at the threshold shares no band is (1 - 0.8^8)^44, 0.03 %; further links of its
group hide even that. The sketch's margin is over four standard deviations.

Null and empty texts, and texts without words, have empty sets and link with nothing. A doc_id that is
repeated with the same text gives one row; with different texts a row for each set, linked as the sets are;
rows with a null doc_id are left out, as they have no component_id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import join_counted
from lexitide.llm.components import components, smallest_names
from lexitide.runtime import Scratch, bound_batches, table

ROWS, BANDS = 8, 44
HASHES = ROWS * BANDS
SKETCH = 1024
THRESHOLD, MARGIN = 0.8, 0.11
SMALL, CHUNK = 6, 1024
#: Shingles that one side of a block holds, about, or one member: 32 MB.
BLOCK_SHINGLES = 1 << 22
CACHE = 300_000

_rng = np.random.default_rng(20_240_601)
_A = (_rng.integers(1 << 31, size=HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(1 << 32, size=HASHES, dtype=np.uint32)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space: what bytes do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class Shingler:
    """Sorted 64-bit numbers of the distinct shingles of a text; remembers words' hashes, up to CACHE of them."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        own, known = words(text), self.known
        if not own:
            return np.zeros(0, np.uint64)
        if len(known) > CACHE:
            known.clear()
        hashed = np.empty(len(own), np.uint64)
        for i, w in enumerate(own):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashed[i] = h
        n = max(1, len(own) - self.width + 1)
        out = np.zeros(n, np.uint64)
        for k in range(min(self.width, len(own))):
            out = mix(out * _M1 + hashed[k : k + n] + np.uint64(k + 1))
        return np.unique(out)


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima over 32-bit images of the shingles; long sets in slices."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(small), 2048):
        np.minimum(low, (small[i : i + 2048, None] * _A + _B).min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    out = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in low.reshape(BANDS, ROWS).T:
        out = mix(out * _M1 + column)
    return out.astype(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """Bit i is the parity of the MinHash values that fall on i."""
    at = mix((low.astype(np.uint64) << np.uint64(16)) + np.arange(HASHES, dtype=np.uint64)) % np.uint64(SKETCH)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def sketch_similarity(flipped):
    """Similarity estimated from the population count of the XOR of two odd sketches (number or column)."""
    log = F.log if not isinstance(flipped, (int, float)) else np.log
    return 1 + SKETCH / (4 * HASHES) * log(1 - 2 * flipped / SKETCH)


#: The count above which the estimate is under the threshold by more than the margin.
MOST_FLIPPED = int(SKETCH / 2 * (1 - np.exp(-4 * HASHES / SKETCH * (1 - THRESHOLD + MARGIN))))

SIGNED = "doc_id long, text_key long, n_shingles long, print binary, keys array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            n, prints, keys, sketches = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle(text)
                low = minhashes(s)
                n.append(len(s))
                prints.append(fingerprint(s))
                keys.append(band_keys(low) if len(s) else np.zeros(0, np.int64))
                sketches.append(np.frombuffer(odd_sketch(low), dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "print", "keys", "sketch"],
            )

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(work, SIGNED)


def shingle_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the classes (id, doc_id, print), from the texts of their doc_ids."""

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for b in batches:
            sets = [shingle(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(fingerprint, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "print", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(classes.select("doc_id").hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(shingled, "doc_id long, print binary, shingles binary")
    return sets.join(classes.hint("merge"), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"]).select("id", "shingles")


def verified(scratch: Scratch, pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among pairs: sketches first, then the full sets of what is left."""
    other = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(other, "b")
    flipped = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    likely = both.where(flipped <= MOST_FLIPPED).select("a", "b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = 0
                if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[at] == y).sum())
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    one = likely.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), "a")
    return scratch.save(two.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long"), "links")


def _likely(group: pd.DataFrame, rows: np.ndarray, right: np.ndarray, component: np.ndarray):
    """By slices of rows: row numbers, and those of right in another component that the sketches make likely, with the counts."""
    bits = np.stack(group["sketch"].to_numpy()).view(np.uint64)
    for i in range(0, len(rows), 256):
        x = rows[i : i + 256]
        flipped = np.zeros((len(x), len(right)), np.int32)
        for word in range(bits.shape[1]):
            flipped += np.bitwise_count(bits[x, word][:, None] ^ bits[right, word][None, :])
        s, t = np.nonzero((flipped <= MOST_FLIPPED) & (component[x][:, None] != component[right][None, :]))
        yield x[s], right[t], flipped[s, t]


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block that look, rows that they look at, and the components."""
    looks = group["looks"].to_numpy()
    return np.nonzero(looks)[0], np.nonzero(~looks)[0], group["component"].to_numpy()


def _paired(a: list[np.ndarray], b: list[np.ndarray]) -> pd.DataFrame:
    x, y = (np.concatenate([np.zeros(0, np.int64), *v]) for v in (a, b))
    return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()


def best_partners(group: pd.DataFrame) -> pd.DataFrame:
    """Of each looker, its likeliest partner in every other component."""
    rows, others, component = _sides(group)
    ids, a, b = group["id"].to_numpy(), [], []
    for s, t, flipped in _likely(group, rows, others, component):
        order = np.lexsort((flipped, component[t], s))
        s, t = s[order], t[order]
        first = np.ones(len(s), dtype=bool)
        first[1:] = (s[1:] != s[:-1]) | (component[t[1:]] != component[t[:-1]])
        a.append(ids[s[first]])
        b.append(ids[t[first]])
    return _paired(a, b)


def links_between(group: pd.DataFrame) -> pd.DataFrame:
    """Between a looker and another component one link, if there is any: all likely partners are verified on full sets."""
    rows, others, component = _sides(group)
    ids, a, b = group["id"].to_numpy(), [], []
    index = None
    for s, t, _ in _likely(group, rows, others, component):
        if not len(s):
            continue
        if index is None:  # shingle -> members
            sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
            size = np.array([len(x) for x in sets])
            values, owner = np.concatenate([sets[i] for i in others]), np.repeat(others, size[others])
            order = np.argsort(values, kind="stable")
            index = values[order], owner[order]
        for x in np.unique(s):
            lo, hi = (np.searchsorted(index[0], sets[x], side) for side in ("left", "right"))
            length = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            common = np.bincount(index[1][at], minlength=len(sets))
            y = t[s == x]
            y = y[100 * common[y] >= 80 * (size[x] + size[y] - common[y])]
            y = y[np.unique(component[y], return_index=True)[1]]
            a.append(np.full(len(y), ids[x]))
            b.append(ids[y])
    return _paired(a, b)


def in_blocks(held: DataFrame, work) -> DataFrame:
    """work over blocks of large buckets (key, id, n, component, most, apart, n_shingles, ...): (a, b).

    The apart members outside the component most look; blocks of them meet blocks of all n members, each in a group of its own.
    How many blocks a bucket has follows from its members and from the size of their sets."""
    looks = F.col("component") != F.col("most")
    sizes = held.groupBy("key").agg(F.sum("n_shingles").alias("heavy"), F.sum(F.when(looks, F.col("n_shingles"))).alias("heavy_apart"))
    chunks = lambda n, heavy: F.greatest(F.ceil(F.col(n) / CHUNK), F.ceil(F.col(heavy) / BLOCK_SHINGLES)).cast("int")
    held = held.join(sizes, "key").withColumn("high_chunks", chunks("n", "heavy")).withColumn("low_chunks", chunks("apart", "heavy_apart"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lookers = held.where(looks).withColumn("low", own("low_chunks")).withColumn("high", each("high_chunks")).withColumn("looks", F.lit(True))
    everyone = held.withColumn("high", own("high_chunks")).withColumn("low", each("low_chunks")).withColumn("looks", F.lit(False))
    dealt = lookers.unionByName(everyone).drop("n", "most", "apart", "n_shingles", "heavy", "heavy_apart", "high_chunks", "low_chunks")
    return dealt.groupBy("key", "low", "high").applyInPandas(work, "a long, b long")


def with_own(held: DataFrame, own: DataFrame) -> DataFrame:
    """held (id, ...), at most BANDS rows for an id, with the columns of own (id, ...), one row for each id: an id is joined once."""
    rows = held.groupBy("id").agg(F.collect_list(F.struct(*(c for c in held.columns if c != "id"))).alias("__rows"))
    return rows.join(own, "id").select("id", *(c for c in own.columns if c != "id"), F.inline("__rows"))


def near_duplicates(docs: DataFrame, width: int = 5, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document of docs (doc_id, text).

    by_text adds text_key, xxhash64 of the text, and gives a row for each pair of doc_id and text_key."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "neardup")
    signed = scratch.save(signatures(docs, width), "signed")

    full = signed.where("n_shingles > 0")
    classes = full.select("print", "doc_id").distinct().groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = scratch.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    heads = full.join(classes.select("print", "doc_id", "id"), ["print", "doc_id"]).dropDuplicates(["print", "doc_id"]).select("id", "keys", "sketch", "n_shingles")
    heads = scratch.save(heads, "heads")
    keyed = heads.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    buckets = scratch.save(keyed.join(shared, "key").select("key", "id", "n", "first"), "buckets")
    bucketed = scratch.save(buckets.select("id").distinct(), "bucketed")
    sketches = scratch.save(heads.select("id", "sketch", "n_shingles").join(bucketed, "id", "left_semi"), "sketches")
    sets = scratch.save(shingle_sets(docs, classes.select("id", "doc_id", "print").join(bucketed, "id", "left_semi"), width), "sets")
    scratch.drop(heads)

    tested = scratch.save(buckets.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "tested")
    links = verified(scratch, tested, sketches, sets)
    for last in (False, True):
        grouped = components(scratch, links)
        held = buckets.select("key", "id", "n").join(grouped, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("component"))
        size = F.struct("size", "component")
        mixed = held.groupBy("key", "component").agg(F.count("*").alias("size")).groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(size).alias("top"))
        mixed = mixed.where("parts > 1").select("key", F.col("top.component").alias("most"), (F.col("all") - F.col("top.size")).alias("apart"))
        held = scratch.save(held.join(mixed, "key"), "mixed")
        large = held.where(F.col("n") > SMALL)
        if last:
            new = in_blocks(with_own(large, sketches.join(sets, "id")), links_between)
        else:
            x, y = held.where(F.col("n") <= SMALL).alias("x"), held.where(F.col("n") <= SMALL).alias("y")
            apart = x.join(y, "key").where("x.component <> y.component and x.id < y.id")
            pairs = in_blocks(with_own(large, sketches), best_partners).unionByName(apart.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
            new = verified(scratch, scratch.save(pairs.distinct().join(tested, ["a", "b"], "left_anti"), "pairs"), sketches, sets)
        links = scratch.save(links.unionByName(new), "links")
    grouped = components(scratch, links)
    scratch.drop(sets)

    info = classes.join(smallest_names(grouped, classes, "doc_id"), "id", "left")
    info = scratch.save(info.select("print", "copies", F.coalesce("component_id", "doc_id").alias("component_id")), "info")
    names = ["doc_id", "n_shingles", *(["text_key"] if by_text else [])]
    members = scratch.save(signed.select(*names, F.when(F.col("n_shingles") > 0, F.col("print")).alias("print")).distinct(), "members")
    component = F.coalesce("component_id", "doc_id")
    out = join_counted(members, info, "print", "copies", members.count())
    return out.select(*names, component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
