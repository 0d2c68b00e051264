"""Embedding near-duplicates: randomised-rotation binary codes decide which pairs need exact recomputation.

1. Vectors are scaled to length one in double precision; equal ones become one class, found by a 128-bit fingerprint. Those
   that are null, zero, or hold null or non-finite components are set aside and link with nothing.
2. The index, for each vector length: a centre for each CELL_ROWS rows, at most MOST_CELLS in all, drawn by hash from at most
   CENTRE_SAMPLE vectors and moved by a few rounds of k-means; a length that the sample lacks has one cell. Every class is at
   home in its nearest cell and visits each earlier cell that is the home of any vector within the threshold's angle (reach()
   has the bound, which is exact), so every pair at the threshold meets, once, in the earlier of its two homes. Tight groups
   visit few cells; vectors without groups visit nearly all of them, and the work then grows with the square of the table.
3. Each class has a code: the signs of its coordinates after padding to CODE dimensions and a random rotation, and
   a correction factor, the inner product of the vector and its quantised form. In a cell, the
   inner product of the unquantised visitor with the code, over the factor, is an unbiased estimate; its error has
   a known bound. Only pairs whose upper bound reaches the threshold are computed again, exactly.
4. A cell falls into blocks of about BLOCK home rows and chunks of about SEEN rows that are there; each block meets each
   chunk in a group of its own, so a cell with a third of all rows is many bounded groups. A group yields its rows' link
   counts, and the smallest row that each can reach by the group's links: not the pairs.

Only the codes' bound (SIGMAS) can lose a pair at the threshold; no pair below the threshold is linked. The README has
the recall measured against brute force.
Vectors of different lengths don't link. Repeated vec_ids with equal vectors count as one vector; with different ones each
vector has its row, linked as it is. Rows with a null vec_id are left out. An empty table gives an empty result; labels and
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.llm.bounds import join_counted, sample
from lexitide.llm.components import components, smallest_names
from lexitide.runtime import Scratch, bound_batches, table

THRESHOLD, CODE, SIGMAS = 0.9, 128, 4.5
CENTRE_SAMPLE, MOST_CELLS, CELL_ROWS, BLOCK, SEEN = 20_000, 4096, 16_384, 16_384, 16_384
#: Components that a block or chunk holds at most (or one row): 64 MB in double precision.
COMPONENTS = 1 << 23


@lru_cache(maxsize=4)
def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def code_size(dim: int) -> int:
    return max(CODE, -(-dim // 64) * 64)


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, packed signs, correction factors of unit vectors."""
    size = len(turn)
    turned = np.zeros((len(unit), size))
    turned[:, : unit.shape[1]] = unit
    turned = turned @ turn.T
    signs = turned > 0
    factor = np.abs(turned).sum(1) / np.sqrt(size)
    return turned, np.packbits(signs, axis=1), factor


def estimate(turned: np.ndarray, codes: np.ndarray, factor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products [visitor, coded], and the bound of the error for each coded vector."""
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * np.float32(2 / np.sqrt(size)) - np.float32(1 / np.sqrt(size))
    est = (turned.astype(np.float32) @ signs.T) / factor.astype(np.float32)
    bound = SIGMAS * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(1, size - 1))
    return est, bound


def centres(sample: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
    """Spherical k-means from the first rows of the sample."""
    c = sample[:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([(x @ c.T).argmax(1) for x in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1)
        c[length > 1e-9] = sums[length > 1e-9] / length[length > 1e-9, None]
    return c


def reach(unit: np.ndarray, centre: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cells of unit vectors, and [vector, cell]: may a vector at the threshold or above be at home there?

    y at home in c is no farther from c than from x's home h. The plane between them is x (h - c) / |h - c| away from x,
    and a vector within the threshold's angle comes no closer to it than that angle's sine allows."""
    near = unit @ centre.T
    home = near.argmax(1)
    if threshold <= 0:
        return home, np.ones(near.shape, bool)
    between = np.sqrt(np.maximum(0, 2 - 2 * (centre[home] @ centre.T)))
    return home, near[np.arange(len(unit)), home][:, None] - near <= np.sqrt(max(0, 1 - threshold**2)) * between + 1e-6


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one; neither large nor tiny components overflow. Rows of zeros and
    non-finite numbers give non-finite rows."""
    raw = raw.astype(np.float64)
    with np.errstate(all="ignore"):
        x = raw / np.abs(raw).max(1, initial=0, keepdims=True)
        return x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0


def stacked(vecs, dim: int) -> np.ndarray:
    """The rows of binary vectors of one length, in the precision they have."""
    data = b"".join(bytes(v) for v in vecs)
    return np.frombuffer(data, "<f4" if len(data) == 4 * dim * len(vecs) else "<f8").reshape(len(vecs), dim)


def by_length(dims: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for dim in np.unique(dims):
        yield int(dim), np.nonzero(dims == dim)[0]


def fingerprinted(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec, print): print, of the direction, is null for what links with nothing; vec are the components."""
    narrow = "array<float>" in vectors.schema["embedding"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4" if narrow else "<f8")  # null components become nan
            start = np.cumsum(size) - size
            vecs, prints = [None] * len(size), [None] * len(size)
            for dim, at in by_length(size):
                raw = values[start[at][:, None] + np.arange(dim)]
                unit = scaled(raw)
                for i, x, u in zip(at, raw, unit):
                    if dim and np.isfinite(u).all():
                        vecs[i], prints[i] = x.tobytes(), xxhash.xxh3_128_digest(u.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(size, pa.int32()), pa.array(vecs, pa.binary()), pa.array(prints, pa.binary())], ["vec_id", "dim", "vec", "print"])

    return vectors.where("vec_id is not null").select("vec_id", "embedding").mapInArrow(work, "vec_id long, dim int, vec binary, print binary")


def _cell(home: pd.DataFrame, seen: pd.DataFrame, dim: int, threshold: float) -> pd.DataFrame:
    """Links between a block of a cell's home rows and a chunk of the rows that are there: (key, other, n).

    n are the links of key, counted with copies; other is the smallest key that the links of this group let it reach."""
    hx, sx = (scaled(stacked(list(side["vec"]), dim)) for side in (home, seen))
    codes = np.stack([np.frombuffer(c, np.uint8) for c in home["code"]])
    factor = home["factor"].to_numpy()
    hid, sid = home["key"].to_numpy(), seen["key"].to_numpy()
    hcell, scell = home["home"].to_numpy(), seen["home"].to_numpy()
    size = code_size(dim)
    turn = rotation(size)
    nodes, of = np.unique(np.concatenate([sid, hid]), return_inverse=True)
    snode, hnode = of[: len(sid)], of[len(sid) :]
    scopies, hcopies = seen["copies"].to_numpy(), home["copies"].to_numpy()
    n, low = np.zeros(len(nodes)), np.arange(len(nodes))
    for i in range(0, len(seen), 512):  # pairs are held for one slice only: in a dense group nearly all are links
        part = slice(i, i + 512)
        turned = np.zeros((len(sx[part]), size))
        turned[:, :dim] = sx[part]
        est, bound = estimate(turned @ turn.T, codes, factor, size)
        may = est + bound >= threshold
        # at home together, the smaller key looks; visitors only come from later cells
        may &= (scell[part][:, None] != hcell[None, :]) | (sid[part][:, None] < hid[None, :])
        if may.mean() > 0.02:
            s, h = np.nonzero(may & (sx[part] @ hx.T >= threshold))
        else:
            s, h = np.nonzero(may)
            ok = np.einsum("nd,nd->n", sx[s + i], hx[h]) >= threshold
            s, h = s[ok], h[ok]
        s += i
        n += np.bincount(snode[s], hcopies[h], len(nodes)) + np.bincount(hnode[h], scopies[s], len(nodes))
        low = joined(low, snode[s], hnode[h])
    keep = n > 0
    return pd.DataFrame({"key": nodes[keep], "other": nodes[low[keep]], "n": n[keep].astype(np.int64)})


def joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """low has the smallest node of each node's component; the same with links between a and b added."""
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        low = low.copy()
        np.minimum.at(low, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (low[low] != low).any():
            low = low[low]


def linked(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "embeddings")
    rows = scratch.save(fingerprinted(vectors), "rows")
    members = scratch.save(rows.select("vec_id", "print").distinct(), "members")
    counted = members.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    heads = rows.where("print is not null").groupBy("print").agg(F.first("dim").alias("dim"), F.min("vec").alias("vec"))
    classes = scratch.save(heads.join(counted, "print").withColumn("key", F.monotonically_increasing_id()), "classes")

    met = scratch.save(_meet(scratch, classes, threshold, block), "met")
    tally = met.groupBy("key").agg(F.sum("n").alias("n"))
    grouped = components(scratch, met.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")))
    lowest = smallest_names(grouped, classes.select(F.col("key").alias("id"), F.col("id").alias("vec_id")), "vec_id").withColumnRenamed("id", "key")
    info = classes.select("print", "key", "id", "copies").join(tally, "key", "left").join(lowest, "key", "left")
    info = scratch.save(info.select("print", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component_id", "id").alias("component_id")), "info")
    out = join_counted(members, info, "print", "copies", members.count())
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.col("n"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def _index(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centres by vector length, at most MOST_CELLS and one for each length in the sample."""
    n, found = classes.count(), {}
    for r in sample(classes.select("print", "dim", "vec"), CENTRE_SAMPLE, "print").toLocalIterator():
        found.setdefault(r["dim"], []).append(r["vec"])
    drawn, out = sum(map(len, found.values())), {}
    for dim, vecs in found.items():
        share = len(vecs) / drawn
        cells = max(1, min(len(vecs), int(share * MOST_CELLS), -(-int(share * n) // CELL_ROWS)))
        out[dim] = centres(scaled(stacked(sorted(vecs, key=xxhash.xxh3_64_intdigest), dim)), cells)
    return out


def _meet(scratch: Scratch, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(key, other, n) of all groups; see _cell."""
    spark = scratch.spark
    shared = spark.sparkContext.broadcast(_index(classes))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, dims = b.column("vec").to_pylist(), b.column("dim").to_numpy()
            codes, visits = [b""] * len(vecs), [None] * len(vecs)
            factor, home = np.zeros(len(vecs)), np.zeros(len(vecs), np.int32)
            for dim, at in by_length(dims):
                x, c = scaled(stacked([vecs[i] for i in at], dim)), shared.value.get(dim)
                _, code, factor[at] = encode(x, rotation(code_size(dim)))
                own, may = reach(x, c, threshold) if c is not None else (np.zeros(len(x), np.int64), np.ones((len(x), 1), bool))
                home[at] = own
                for i, row, m, k in zip(at, code, may, own):
                    codes[i], visits[i] = row.tobytes(), np.nonzero(m[: k + 1])[0].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("dim"), b.column("vec"), b.column("copies"), pa.array(codes, pa.binary()), pa.array(factor), pa.array(home), pa.array(visits, pa.list_(pa.int32()))],
                ["key", "dim", "vec", "copies", "code", "factor", "home", "visits"],
            )

    coded = classes.select("key", "dim", "vec", "copies").mapInArrow(index, "key long, dim int, vec binary, copies long, code binary, factor double, home int, visits array<int>")
    coded = scratch.save(coded, "coded")
    # by cell, the numbers of blocks of home rows and of chunks of rows that are there; one row for each cell
    rows_of = lambda most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(COMPONENTS) / F.greatest("dim", F.lit(1)))))
    at_home = coded.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("rows")).select("dim", "cell", F.ceil(F.col("rows") / rows_of(block)).cast("int").alias("blocks"))
    there = coded.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("rows")).select("dim", "cell", F.ceil(F.col("rows") / rows_of(SEEN)).cast("int").alias("chunks"))
    sizes = scratch.save(at_home.join(there, ["dim", "cell"]), "cells")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    # every block meets every chunk of its cell, so a task holds a bounded number of either
    home = coded.withColumn("cell", F.col("home")).join(sizes, ["dim", "cell"]).withColumn("block", own("blocks")).withColumn("chunk", each("chunks"))
    again = spark.read.schema(coded.schema).parquet(coded._scratch_path)
    seen = again.withColumn("cell", F.explode("visits")).join(sizes, ["dim", "cell"]).withColumn("chunk", own("chunks")).withColumn("block", each("blocks"))

    def join(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        return _cell(left, right, int(key[0]), threshold)

    keys, need = ("dim", "cell", "block", "chunk"), ("key", "vec", "copies", "home")
    both = home.select(*keys, *need, "code", "factor").groupBy(*keys).cogroup(seen.select(*keys, *need).groupBy(*keys))
    return both.applyInPandas(join, "key long, other long, n long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))
