"""What blocks of columns explain of a value or a vector: every R2 from one matrix of summed products.

Tasks sum the outer products of their rows, and Spark adds the sums by cell; so one pass gives all partitions, however many blocks and columns
are asked for. The driver holds one matrix with as many rows as there are columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.runtime import find_package


def centred_products(df: DataFrame, columns: list[str], vector: str | None = None, zero: bool = False) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, matrix) of the columns and then the vector's components: sums of products less the means.

    Rows with a null are left out, or with zero counted as 0 in the columns. Vectors have one length. Means come first, as sums of raw products
    would cancel; they are a scan of the same columns."""
    find_package(df.sparkSession)
    as_number = lambda c: F.col(c).cast("double")
    own = df.select(F.array(*(F.coalesce(as_number(c), F.lit(0.0)) if zero else as_number(c) for c in columns)).alias("__x"), *([F.transform(vector, lambda v: v.cast("double")).alias("__v")] if vector else []))
    rows = own.select((F.concat("__x", "__v") if vector else F.col("__x")).alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda v: v.isNull() | F.isnan(v)))

    def summed(batches: Iterator[pa.RecordBatch], mean: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if not len(x):
                continue
            part = x.sum(0)[None, :] if mean is None else (x - mean).T @ (x - mean)
            n, total = n + len(x), part if total is None else total + part
        if n:
            i, j = np.indices(total.shape)
            keep = (i <= j).ravel() if mean is not None else slice(None)
            i, j, s = i.ravel()[keep], j.ravel()[keep], total.ravel()[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(s, float(n)))], ["i", "j", "s"])

    def cells(work) -> dict[tuple[int, int], float]:
        got = rows.mapInArrow(work, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
        return {(r["i"], r["j"]): r["s"] for r in got.collect()}

    sums = cells(summed)
    n = int(sums.pop((-1, -1), 0))
    size = len(sums) or len(columns)
    mean = np.array([sums.get((0, j), 0.0) for j in range(size)]) / max(1, n)
    products = cells(lambda batches: summed(batches, mean)) if n else {}
    products.pop((-1, -1), None)
    out = np.zeros((size, size))
    for (i, j), s in products.items():
        out[i, j] = out[j, i] = s
    return n, mean, out


def explained(products: np.ndarray, x: list[int], y: list[int]) -> float:
    """R2 of a linear model of all of y together on x; columns that depend on each other do no harm."""
    total = float(products[y, y].sum())
    if not x or total <= 0:
        return 0.0
    scale = np.sqrt(np.maximum(np.diag(products)[x], 1e-300))  # of columns of unlike size
    xx, xy = products[np.ix_(x, x)] / scale[:, None] / scale[None, :], products[np.ix_(x, y)] / scale[:, None]
    return float((xy * np.linalg.lstsq(xx, xy, rcond=None)[0]).sum() / total)


PARTITION = "block string, feature string, alone double, added double"


def partition(df: DataFrame, blocks: dict[str, list[str]], y: str | None = None, vector: str | None = None, zero: bool = False) -> DataFrame:
    """(block, feature, alone, added): R2 of all columns, of each block and of each column, alone and added to all others.

    The value y or the vector's components are what is explained. Rows: block (all) for all columns; a null feature for the block whole."""
    columns = [c for b in blocks.values() for c in b]
    _, _, m = centred_products(df, [*columns, *([y] if y else [])], vector, zero)
    at, target = {c: i for i, c in enumerate(columns)}, list(range(len(columns), len(m)))
    every = list(range(len(columns)))
    full = explained(m, every, target)
    rows = [("(all)", None, full, full)]
    for name, own in blocks.items():
        for feature, some in ((None, own), *((c, [c]) for c in own)):
            mine = [at[c] for c in some]
            rows.append((name, feature, explained(m, mine, target), full - explained(m, [i for i in every if i not in mine], target)))
    return df.sparkSession.createDataFrame(rows, PARTITION)


def marginal(df: DataFrame, groups: dict[str, list[str]], vector: str, components: int, top: int = 30) -> DataFrame:
    """(group, feature, r2, prevalence): the share of each column alone in the vectors' largest principal components, the top ones.

    Nulls of columns count as 0; constant columns are left out. Components come from the same matrix as the products with the columns."""
    columns = [c for g in groups.values() for c in g]
    _, mean, m = centred_products(df, columns, vector, zero=True)
    k = len(columns)
    values, axes = np.linalg.eigh(m[k:, k:]) if len(m) > k else (np.zeros(0), np.zeros((0, 0)))
    axes, values = axes[:, ::-1][:, :components], values[::-1][:components]
    rows, i = [], 0
    for group, own in groups.items():
        for c in own:
            if m[i, i] > 0 and values.sum() > 0:
                rows.append((group, c, float(((m[i, k:] @ axes) ** 2).sum() / m[i, i] / values.sum()), float(mean[i])))
            i += 1
    rows = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:top]
    return df.sparkSession.createDataFrame(rows, "group string, feature string, r2 double, prevalence double")
