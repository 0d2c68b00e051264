"""Links, counts and components against brute force."""

import numpy as np
import pytest

from lexitide.llm import op9_embeddings as op9


def brute(vectors, threshold=0.9):
    ids, x = list(vectors), []
    for v in vectors.values():
        v = None if v is None or any(c is None for c in v) else np.array(v, dtype=np.float64)
        ok = v is not None and len(v) and np.isfinite(v).all() and np.abs(v).max() > 0
        x.append(v / np.sqrt(v @ v) if ok else None)
    link = [[j for j in range(len(ids)) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in range(len(ids))]
    low = dict(enumerate(ids))
    while True:
        new = {i: min([low[i], *(low[j] for j in link[i])]) for i in low}
        if new == low:
            break
        low = new
    return {ids[i]: (len(link[i]), low[i]) for i in low}


def groups(rng, n=500, dim=32):
    base, out = rng.normal(size=(40, dim)), {}
    for i in range(n):
        k = 0 if i % 3 == 0 else int(rng.integers(40))  # a third is near one vector
        out[i] = (base[k] + rng.normal(size=dim) * (0.05, 0.2, 0.3)[i % 3]).astype(np.float32).tolist()
    out[n] = out[7]
    out[n + 1] = [2.0 * c for c in out[7]]
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_like_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(op9, "SEEN", 64 if block == 16 else op9.SEEN)
    vectors = groups(np.random.default_rng(3))
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(5)
    want = brute(vectors)
    got = {r.vec_id: r for r in op9.linked(df, block=block).collect()}
    assert set(got) == set(want)
    total, found = sum(n for n, _ in want.values()), sum(r.n_links for r in got.values())
    assert found >= 0.99 * total and all(r.n_links <= want[i][0] for i, r in got.items())  # recall; nothing below the threshold
    assert np.mean([r.component_id == want[i][1] for i, r in got.items()]) > 0.99
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_long_vectors_in_small_blocks(spark, monkeypatch):
    """Blocks hold a number of components, not of rows: long vectors lie in more of them, and no link is lost."""
    monkeypatch.setattr(op9, "COMPONENTS", 60 * 2048)
    vectors = groups(np.random.default_rng(8), 300, 2048)
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    want, got = brute(vectors), {r.vec_id: r for r in op9.linked(df).collect()}
    total = sum(n for n, _ in want.values())
    assert total > 1000 and sum(r.n_links for r in got.values()) >= 0.99 * total and all(r.n_links <= want[i][0] for i, r in got.items())
    assert np.mean([r.component_id == want[i][1] for i, r in got.items()]) > 0.99


def test_every_pair_meets_without_groups(spark, monkeypatch):
    """Vectors around no centres, pairs just above the threshold: none is lost, whatever the number of cells."""
    monkeypatch.setattr(op9, "CELL_ROWS", 100, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.9005, 0.92, (len(x), 1))
    both = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>").repartition(4)
    near = both @ both.T >= 0.9
    got = {r.vec_id: r.n_links for r in op9.linked(df).collect()}
    assert [got[i] for i in range(len(both))] == (near.sum(1) - 1).tolist()


def test_reach_holds_homes_of_all_within_the_angle():
    rng = np.random.default_rng(6)
    for dim in (2, 3, 64):
        c, x, side = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.normal(size=(3, 300, dim)))
        c = c[:40]
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        home, may = op9.reach(x, c, 0.9)
        assert (home == (x @ c.T).argmax(1)).all()
        for toward in (side, *(c[k] - (x @ c[k])[:, None] * x for k in range(40))):  # at random, and straight at a centre
            y = 0.9 * x + np.sqrt(1 - 0.81) * toward / np.linalg.norm(toward, axis=1, keepdims=True)
            assert may[np.arange(300), (y @ c.T).argmax(1)].all()


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, -0.0]), (7, [1.0, -0.0]), (8, [1e-30, 0.0]), (9, [0.0, 1.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'clash' id", "'clash' unit", "'clash' cell", "1 label")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op9.linked(df).collect()}
    assert got == {i: (0, i, True) for i in (0, 1, 2, 3, 4, 5, 9)} | {6: (2, 6, True), 7: (2, 6, False), 8: (2, 6, False)}
    assert op9.linked(df.limit(0)).collect() == []
    apart = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in op9.linked(apart).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2)]  # each vector of a repeated vec_id has its own links


def test_many_lengths(spark, monkeypatch):
    """No length is left out, whether or not the sample for the centres has it."""
    monkeypatch.setattr(op9, "CENTRE_SAMPLE", 10)
    rng = np.random.default_rng(8)
    rows = []
    for dim in range(2, 102):
        v = rng.normal(size=dim)
        rows += [(2 * dim, v.tolist()), (2 * dim + 1, (v + 0.01 * rng.normal(size=dim)).tolist())]
    got = {r.vec_id: r.n_links for r in op9.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute_links(rows) and set(got.values()) == {1}


def brute_links(rows):
    return {i: n for i, (n, _) in brute(dict(rows)).items()}


def test_one_dense_group(spark, monkeypatch):
    """Nearly all pairs link, over several blocks and chunks."""
    for name in ("SEEN", "CELL_ROWS"):
        monkeypatch.setattr(op9, name, 128)
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([np.ones((700, 16)) + 0.2 * rng.normal(size=(700, 16)), rng.normal(size=(60, 16))]))]
    want = brute(dict(rows))
    got = {r.vec_id: (r.n_links, r.component_id) for r in op9.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=128).collect()}
    assert got == want


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    dim, size = 64, op9.code_size(64)
    x = rng.normal(size=(400, dim))
    y = x[:200] + rng.normal(size=(200, dim)) * 0.5
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    turn = op9.rotation(size)
    _, codes, factor = op9.encode(x, turn)
    turned, _, _ = op9.encode(y, turn)
    est, bound = op9.estimate(turned, codes, factor, size)
    error = est - y @ x.T
    assert abs(error.mean()) < 0.005 and (np.abs(error) <= bound).mean() > 0.9999
