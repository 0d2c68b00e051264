"""Word vectors on planted topics, the chain to norms, quotations against a plain version."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexitide.operators import embeddings, quotes, vectors

TOPICS = 4


@pytest.fixture(scope="module")
def lines(spark):
    """Lines of two periods; a word's number modulo TOPICS is its topic."""
    draw = np.random.default_rng(0)
    freq = 1 / (np.arange(240) + 5) ** 0.9
    rows = []
    for period in ("C18", "C19"):
        for _ in range(900):
            p = np.where(np.arange(240) % TOPICS == draw.integers(TOPICS), freq, freq * 0.02)
            rows.append(("x", period, [f"w{i}" for i in draw.choice(240, 12, p=p / p.sum())]))
    return spark.createDataFrame(rows, "corpus string, period string, words array<string>").repartition(4), rows


def test_pairs_like_plain(spark, lines):
    df, rows = lines
    want = Counter()
    for _, period, w in rows[:50]:
        for i in range(len(w)):
            for d in range(1, 4):
                if i + d < len(w):
                    want[period, w[i], w[i + d]] += (4 - d) / 3
    some = spark.createDataFrame(rows[:50] + [("x", "C18", []), ("x", "C18", ["w1"]), ("x", "C18", None)], df.schema)
    got = {(r.period, r.a, r.b): r.n for r in vectors.pairs(some, ["period"], 3).collect()}
    assert got == pytest.approx(dict(want))


def test_neighbours_of_planted_topics(spark, lines):
    own = vectors.train(lines[0], ["corpus", "period"], size=16, window=5, least=5, epochs=2, shard=70)
    counts = Counter((p, x) for _, p, w in lines[1] for x in w)
    assert {(r.period, r.word) for r in own.select("period", "word").collect()} == {k for k, n in counts.items() if n >= 5}
    near = vectors.nearest(own, own.where("word in ('w0', 'w1', 'w2', 'w3', 'w41', 'w77')"), ["corpus", "period"], 5).collect()
    assert len(near) == 60 and np.mean([int(r.word[1:]) % TOPICS == int(r.other[1:]) % TOPICS for r in near]) > 0.95
    again = vectors.train(lines[0].repartition(7), ["corpus", "period"], size=16, window=5, least=5, epochs=2, shard=70)
    far = own.alias("a").join(again.alias("b"), ["corpus", "period", "word"]).select(F.max(F.abs(F.col("a.vector")[0] - F.col("b.vector")[0])).alias("d"))
    assert far.collect()[0].d < 1e-6  # the same on every layout, but for the order of sums
    assert vectors.train(lines[0].where("false"), ["period"]).count() == 0


def test_a_visit_lowers_the_loss():
    draw = np.random.default_rng(1)
    count, negative = draw.poisson(1.0, (30, 20)).astype(float), np.full((30, 20), 0.7)
    inner, outer = (draw.random((30, 8)) - 0.5) / 8, (draw.random((20, 8)) - 0.5) / 80
    loss = lambda: (count * np.log1p(np.exp(-inner @ outer.T)) + negative * np.log1p(np.exp(inner @ outer.T))).sum()
    seen, before = (np.zeros(30), np.zeros(20)), loss()
    for _ in range(10):
        vectors.visit(count, negative, inner, outer, *seen, vectors.RATE, vectors.STEPS)
    assert loss() < 0.9 * before


def test_few_pairs_like_all_cells():
    """A block with few pairs takes the steps of the dense visit."""
    draw = np.random.default_rng(4)
    count, f, noise = draw.poisson(0.1, (300, 40)).astype(float), draw.random(300) * 3, draw.random(40)
    plain = [(draw.random((300, 8)) - 0.5) / 8, (draw.random((40, 8)) - 0.5) / 80, np.zeros(300), np.zeros(40)]
    few = [x.copy() for x in plain]
    vectors.visit(count, vectors.NEGATIVES * f[:, None] * noise[None, :], *plain, vectors.RATE, 3)
    at = np.nonzero(count)
    vectors.visit_few((*at, count[at]), f, noise, *few, vectors.RATE, 3)
    for a, b in zip(plain, few):
        assert b == pytest.approx(a, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("head", [200_000, 50, 0])
def test_numbered_pairs_like_pairs(spark, lines, monkeypatch, head):
    """Pairs of known words only, in either order, with and without words beyond the broadcast ones; places of unknown words count."""
    monkeypatch.setattr(vectors.scoring, "HEAD", head)
    some = spark.createDataFrame(lines[1][:200] + [("x", "C18", []), ("x", "C18", ["w1"]), ("x", "C18", None), ("x", "C19", ["w0", None, "rare", "w1"])], lines[0].schema)
    words = vectors.vocabulary(some, ["period"], 5).where("word is not null")
    numbers = {(r.period, r.word): (i, 0.5 if r.word == "w0" else 1.0, r.n) for i, r in enumerate(words.collect())}
    known = spark.createDataFrame([(*k, *v) for k, v in numbers.items()], "period string, word string, id long, kept double, n long")
    want = Counter()
    for r in vectors.pairs(some, ["period"], 3).collect():
        a, b = numbers.get((r.period, r.a)), numbers.get((r.period, r.b))
        if a and b:
            want[r.period, min(a[0], b[0]), max(a[0], b[0])] += r.n
    got = vectors.numbered_pairs(some, ["period"], 3, known).collect()
    assert {(r.period, r.a, r.b): r.n for r in got} == pytest.approx(dict(want)) and len(got) == len(want)
    kept = {v[0]: v[1] for v in numbers.values()}
    assert all(r.kept == kept[r.a] * kept[r.b] for r in got)


def test_runs_share_their_pairs(spark, lines, monkeypatch):
    """Runs start differently and are trained as alone, but their pairs are counted once; rounds don't grow with the parts of a shard."""
    counted, saved = [], []
    pairs, save = vectors.numbered_pairs, vectors.Scratch.save
    monkeypatch.setattr(vectors, "numbered_pairs", lambda *a: counted.append(1) or pairs(*a))
    monkeypatch.setattr(vectors.Scratch, "save", lambda self, df, name="t": saved.append(name) or save(self, df, name))
    how = dict(size=8, window=3, least=5, epochs=1, shard=12)
    one = lines[0].where("period = 'C18'")
    both = vectors.train(one, ["corpus"], runs=2, **how)
    assert len(counted) == 1 and saved.count("state") - 1 <= max(4, spark.sparkContext.defaultParallelism)  # 240 words are twenty shards of 12
    got = {(r.run, r.word): r.vector for r in both.collect()}
    assert {k for k, _ in got} == {0, 1} and got[0, "w0"] != got[1, "w0"]
    alone = vectors.train(one.withColumn("run", F.lit(1)), ["corpus", "run"], **how).collect()
    assert max(abs(x - y) for r in alone for x, y in zip(r.vector, got[1, r.word])) < 1e-5


def test_from_texts_to_norms(spark, lines):
    poles = spark.createDataFrame([("c", f"w{i}", "pos" if i % TOPICS == 0 else "neg") for i in range(24) if i % TOPICS < 2], "contrast string, word string, band string")
    out, names = vectors.vector_norms(lines[0], poles, runs=2, size=12, window=5, least=5, epochs=2)
    assert names == ["c.C18", "c.C19"] and out.columns == ["word", *names]
    z = {r.word: r["c.C18"] for r in out.collect() if r["c.C18"] is not None}
    pos, neg = ([v for w, v in z.items() if int(w[1:]) % TOPICS == k and int(w[1:]) >= 24] for k in (0, 1))  # words that aren't anchors
    assert np.mean(pos) > 1 and np.mean(neg) < -1 and np.mean([a > 0 for a in pos]) > 0.95
    assert embeddings.axes(spark.createDataFrame([("w0", [1.0, 0.0]), ("w1", [0.0, 2.0])], "word string, vector array<double>"), poles, [], least=2).count() == 0


def test_quotations_like_plain(spark):
    draw = np.random.default_rng(2)
    quotations = [(f"t{a % 3}", i, f"s{i % 4}", int(b), int(b + c)) for i, (a, b, c) in enumerate(zip(draw.integers(0, 3, 60), draw.integers(0, 1500, 60), draw.integers(-1, 700, 60)))]
    quotations += [("t0", 90, None, 0, 1500), ("t0", 91, "s9", 10, 10), ("t0", 92, "s9", 10, 10), ("gone", 1, "s1", 0, 9)]
    tokens = [(f"t{t}", p, f"w{p % 7}", "NN" if p % 5 else "DT", 1700 if t else 1850) for t in range(3) for p in range(1600)]
    q = spark.createDataFrame(quotations, "text string, quote int, speaker string, first int, last int")
    t = spark.createDataFrame(tokens, "text string, position int, word string, tag string, year int")
    held = {}
    for text, p, *_ in tokens:
        own = [(b - a, -a, n, s) for x, n, s, a, b in quotations if x == text and s and a <= p <= b]
        if own:
            held[text, p] = min(own)[2:]
    got = {(r.text, r.position): (r.quote, r.speaker) for r in quotes.attributed(t, q, "text").collect()}
    assert got == held
    every = quotes.attributed(t, q, "text", innermost=False)
    assert every.count() == sum(min(b, 1599) - a + 1 for x, _, s, a, b in quotations if s and a <= b and x != "gone")
    norms = spark.createDataFrame([(f"w{i}", float(i), None if i == 3 else i * 10.0) for i in range(6)], "word string, median double, late double")
    scored = quotes.quote_scores(t, q, norms, "text", quotes.period_value(F.col("year"), [(1800, 1900, "late")], "median"))
    value = lambda text, p: (p % 7 if p % 7 == 3 or text != "t0" else p % 7 * 10.0)
    want = {}
    for (text, p), (n, s) in held.items():
        if p % 5 and p % 7 < 6:
            want.setdefault((text, n, s), []).append(value(text, p))
    assert {(r.text, r.quote, r.speaker): (r.n, r["mean"]) for r in scored.collect()} == {k: (len(v), pytest.approx(np.mean(v))) for k, v in want.items()}


def test_descriptors(spark):
    d = spark.createDataFrame([("t", 1, "mod", "Old"), ("t", 1, "agent", "ran"), ("t", 1, "mod", "none"), ("t", 2, "mod", "old"), ("t", 3, "mod", "old")], "text string, character int, role string, word string")
    c = spark.createDataFrame([("t", 1, "Ann"), ("t", 2, None), ("u", 3, "Bo")], "text string, character int, name string")
    norms = spark.createDataFrame([("old", 2.0), ("ran", -1.0)], "word string, z double")
    got = {(r["name"], r.role): (r.n, r.n_rated, r["mean"]) for r in quotes.descriptor_scores(d, c, norms, "text", F.col("z")).collect()}
    assert got == {("Ann", "mod"): (2, 1, 2.0), ("Ann", "agent"): (1, 1, -1.0), ("Ann", "(all)"): (3, 2, 0.5)}
