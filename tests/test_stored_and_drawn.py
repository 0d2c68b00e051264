"""Tables changed in place, samples with replacement, book passages."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.operators import draws as D
from lexitide.sources import buckets as B


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_in_place(spark, tmp_path):
    t = B.Buckets(spark, f"file://{tmp_path}/t")
    first = spark.createDataFrame([(i, f"k{i}", float(i)) for i in range(100)] + [(None, None, 1.0), (3, "k3", 2.0)], "a int, b string, v double")
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.create(first, ["a", "b"], 16) == 1 and t.read().count() == 101
    with pytest.raises(FileExistsError):
        t.create(first, ["a", "b"])
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert t.upsert(spark.createDataFrame([(5, "k5", -1.0), (200, "new", 7.0), (None, None, 9.0), (200, "new", 6.0)], "a int, b string, v double")) == 2
    want = {(i, f"k{i}"): float(i) for i in range(100)} | {(5, "k5"): -1.0, (200, "new"): 6.0, (None, None): 9.0, (3, "k3"): 2.0}
    assert rows_of(t.read()) == sorted(((*k, v) for k, v in want.items()), key=str)
    # at most three buckets were written, no old file was touched, and the old version still reads
    new = [p for p in tmp_path.rglob("*.parquet") if p not in before]
    assert len({p.parent.name for p in new}) <= 3 and all(p.stat().st_mtime_ns == before[p] for p in tmp_path.rglob("*.parquet") if p in before)
    assert rows_of(t.read(1).where("a = 5")) == [(5, "k5", 5.0)]
    assert t.delete(spark.createDataFrame([(5, "k5"), (None, None)], "a int, b string")) == 3 and t.read().where("a = 5 or a is null").count() == 0
    assert t.add(spark.createDataFrame([(6, "k6", 1.5), (300, "z", 1.0)], "a int, b string, v double"), ["v"]) == 4
    assert rows_of(t.read().where("a in (6, 300)")) == [(300, "z", 1.0), (6, "k6", 7.5)]
    assert t.upsert(first.where("false")) == 4
    with pytest.raises(ValueError):
        t.upsert(first.withColumn("more", F.lit(1)))
    whole = rows_of(t.read())
    assert t.vacuum() > 0 and t.versions() == [4] and rows_of(t.read()) == whole


def test_a_broken_change_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = B.Buckets(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(i, float(i)) for i in range(50)], "id int, v double")
    t.create(df, ["id"], 8)
    bad = df.withColumn("v", F.when(F.col("id") == 30, F.raise_error(F.lit("lost"))).otherwise(F.col("v") + 1))
    with pytest.raises(Exception, match="lost"):
        t.upsert(bad)
    assert t.versions() == [1] and rows_of(t.read()) == rows_of(df)
    # killed after the data, before the version
    with monkeypatch.context() as m:
        m.setattr(B.Buckets, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            t.upsert(df.withColumn("v", F.lit(0.0)))
    assert t.versions() == [1] and rows_of(t.read()) == rows_of(df)
    # another writer was faster
    read = B.Buckets._read
    with monkeypatch.context() as m:
        m.setattr(B.Buckets, "_read", lambda self, v: (0, *read(self, v)[1:]) if v is None else read(self, v))
        m.setattr(B.Buckets, "read", lambda self, *a: df)
        with pytest.raises(B.Conflict):
            t.upsert(df.limit(1))
    assert t.upsert(df.withColumn("v", F.lit(0.0))) == 2 and t.read().agg(F.sum("v")).collect()[0][0] == 0


def test_draws_with_replacement(spark):
    rows = [("a", i, i % 4) for i in range(40)] + [("b", 100, 1), (None, 7, 2)]
    df = spark.createDataFrame(rows, "g string, id int, w int")
    got = D.draws(df.repartition(3), ["g"], "id", 8000, seed=5)
    own = rows_of(got)
    assert own == rows_of(D.draws(df.orderBy(F.desc("id")).repartition(7), ["g"], "id", 8000, seed=5))
    assert Counter(r[0] for r in own) == {"a": 8000, "b": 8000, None: 8000} and len({(r[0], r[3]) for r in own}) == 24_000
    n = np.array([Counter(r[1] for r in own if r[0] == "a")[i] for i in range(40)])
    assert ((n - 200) ** 2 / 200).sum() < 73  # chi-square of 39 degrees at 0.001
    heavy = rows_of(D.draws(df, ["g"], "id", 6000, weight="w", seed=1))
    n = np.array([Counter(r[1] for r in heavy if r[0] == "a")[i] for i in range(40)])
    want = np.array([i % 4 for i in range(40)]) * 100
    assert (n[want == 0] == 0).all() and ((n - want)[want > 0] ** 2 / want[want > 0]).sum() < 59  # 29 degrees
    assert rows_of(D.draws(df, ["g"], "id", 5, seed=2)) != rows_of(D.draws(df, ["g"], "id", 5, seed=3))
    assert D.draws(df.where("false"), ["g"], "id", 5).count() == 0


def test_large_weights_reach_over_slices(spark):
    df = spark.createDataFrame([(0, 5_000_000), (1, 2_500_000), (2, 0)], "id int, w long")
    n = Counter(r.id for r in D.draws(df, [], "id", 3000, weight="w").collect())
    assert set(n) == {0, 1} and abs(n[0] - 2000) < 130


def test_few_draws_are_broadcast(spark):
    """Neither a large table nor its running counts are shuffled to meet some draws, whatever Spark takes their size for."""
    df = spark.createDataFrame([(i % 3, i, 1600, i % 7, i % 5, 1) for i in range(300)], "id int, seq int, year int, num_abs int, num_conc int, num_neither int")
    for out in (D.draws(df, ["id"], "seq", 5), D.book_passages(df, ["id", "seq"], 5)):
        own = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in own and "SortMergeJoin" not in own and "hashpartitioning" not in own


def test_book_passages(spark):
    draw = np.random.default_rng(8)
    rows = [(f"t{i % 9}", i, None if i % 50 == 0 else int(draw.integers(1450, 1900)), int(a), int(b), int(c)) for i, (a, b, c) in enumerate(draw.integers(0, 30, (600, 3)))]
    df = spark.createDataFrame(rows, "id string, seq int, year int, num_abs int, num_conc int, num_neither int")
    got = D.book_passages(df, ["id", "seq"], 10, 1).collect()
    x = np.array([a - b for *_, a, b, _ in rows])
    z = dict(zip([r[1] for r in rows], (x - x.mean()) / x.std()))
    cells = Counter()
    for r in got:
        assert r.abs_conc_z == pytest.approx(z[r.seq]) and r.zbin == ("Abs" if z[r.seq] >= 1 else "Conc" if z[r.seq] <= -1 else "Neither")
        assert r.ybin == (1400 if r.year < 1500 else r.year // 100 * 100)
        cells[r.ybin, r.zbin] += 1
    assert len({r.seq for r in got}) == len(got) and all(1 <= n <= 10 for n in cells.values()) and len(cells) == 15
