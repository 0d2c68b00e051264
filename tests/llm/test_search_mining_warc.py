"""Operators 11 to 13 against SQL, brute force, round trips and odd input."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from lexitide.llm import op11_search, op12_negatives, op13_warc, registry
from llm.conftest import CLASHING


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_hard_negatives", "op13_warc_members"])
def test_same_rows_as_sql(spark, sf, name):
    assert oracle.difference(registry.QUERIES[name](spark, sf), oracle.database(sf), registry.ORACLE_SQL[name]) is None


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in (*CLASHING, "item", "at", "range", "digest", "top", "copies", "path", "dim", "number") if c not in df.columns})


# 11


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(items, docs, k):
    """Plain version: (item_id, rank, doc_id, score)."""
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    own = [x for x in own if x[2]]
    n, total = len(own), sum(x[2] for x in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for i, text in items:
        scores = []
        for d, c, size in own:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, math.inf if d is None else d, d))
        out += [(i, r, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def test_search_odd_rows(spark, awkward, empty):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    items = [(0, "One TEXT, of a few words: one"), (1, None), (2, ""), (3, "漢字 é ▁mark"), (None, "another thing"), (5, "Ä ä unknown"), (5, "repeated 12 34"), (5, "repeated 12 34"), (6, "word " * 5000)]
    frame = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(map(tuple, op11_search.search(frame, awkward).collect()), key=str)
    assert got == ranked(list(dict.fromkeys(items)), docs, 20)
    assert op11_search.search(frame, empty).count() == 0
    assert op11_search.search(frame.where("false"), awkward).count() == 0
    assert [c for c, _ in op11_search.search(frame, empty).dtypes] == ["item_id", "rank", "doc_id", "score"]


def test_search_in_ranges_and_small_arrays(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(60)], k=draw.randint(0, 40)))) for i in range(400)]
    items = [(i, " ".join(draw.choices(words, k=8))) for i in range(30)]
    monkeypatch.setattr(op11_search, "PIECE", 16)
    want = ranked(items, docs, 7)
    got = op11_search.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 7, range_items=7)
    assert sorted(map(tuple, got.collect()), key=str) == want
    lists = op11_search.Lists([(i, t.encode()) for i, t in items])
    lists.weigh(400, 8000, {t: 9 for t in range(60)})
    n, size = np.full(50, 20), np.full(50, 3)
    term, tf = np.tile(np.arange(3), 50), np.ones(150, dtype=np.int64)
    whole = {(a, b): s for x in op11_search.accumulate(lists, n, size, term, tf) for a, b, s in zip(*map(np.ndarray.tolist, x))}
    monkeypatch.setattr(op11_search, "IMPACTS", 5)  # less than one document's
    parts = [(a, b, s) for x in op11_search.accumulate(lists, n, size, term, tf) for a, b, s in zip(*map(np.ndarray.tolist, x))]
    assert {(a, b): s for a, b, s in parts} == whole and len(parts) == len(whole) > 0


def test_pieces_end_between_terms(monkeypatch):
    monkeypatch.setattr(op11_search, "PIECE", 3)
    text = "Aé one,TWO-12 漢字" + "x" * 50 + " \x00end"
    assert [t.decode() for p in op11_search.pieces(text.encode()) for t in p] == terms(text)


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64)
    assert (keys[op11_search.radix_order(keys, 0, 40)] == np.sort(keys)).all()


# 12


def mined(rows, is_anchor, k=5, limit=10, low=30, high=90):
    """Plain version over (id, label, vector of ints)."""
    rows, out = list(dict.fromkeys(rows)), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in rows:
        if is_anchor(i):
            scored = [(-dot(v, w), j, other) for j, other, w in rows if j != i and len(w) == len(v)]
            for s, p, _ in sorted((x for x in scored if x[2] == label), key=lambda x: x[:2])[:k]:
                inside = sorted(x[:2] for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
                out += [(i, p, r, j, -s, -t) for r, (t, j) in enumerate(inside[:limit], 1)]
    return sorted(out)


def test_mining_against_plain(spark, monkeypatch):
    draw = np.random.default_rng(5)
    monkeypatch.setattr(op12_negatives, "ROWS", 50)
    monkeypatch.setattr(op12_negatives, "ANCHORS", 3)
    monkeypatch.setattr(op12_negatives, "SAMPLE", 60)
    rows = [(i, int(draw.integers(3)), tuple(map(int, draw.integers(-40, 90, 7)))) for i in range(300)]
    rows += [(300 + i, i % 2, rows[0][2]) for i in range(40)]  # ties
    rows += [rows[5], (400, 1, (3, 4)), (401, 1, (5, 6)), (402, 0, (2, 3)), (410, 0, ()), (411, 0, ()), (412, 1, ())]
    frame = clashing(spark.createDataFrame([(i, x, list(map(float, v))) for i, x, v in rows], "vec_id long, label int, v array<double>"))
    got = op12_negatives.mine(frame, F.col("vec_id") % 10 == 0, slice_bytes=1000, group_bytes=500)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == mined(rows, lambda i: i % 10 == 0)


def test_mining_odd_rows(spark):
    big, inf = 3.0e38, float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 1, None), (5, 1, [1.0, None]), (6, 1, [float("nan"), 1.0]), (7, 1, [inf, 1.0]), (8, 1, [big, 1.0]), (None, 2, [0.5, 0.5]), (100, 7, [1.0, 1.0]), (200, 1, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").select("vec_id", "label", F.transform("embedding", op12_negatives.times_256).alias("v"))
    kept = [(i, x, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, x, v in rows if i in (0, 1, 2, 100, 200)]
    got = op12_negatives.mine(frame, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == mined(kept, lambda i: i % 100 == 0) != []
    assert op12_negatives.mine(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_filter():
    draw = np.random.default_rng(2)
    x = np.floor(256 * (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(draw.normal(size=(3000, 33)))).astype(np.int64)
    centres = op12_negatives.centres_of(op12_negatives.even(x[:1000].astype(float)))
    codes, residual = op12_negatives.encode(x, centres)
    rows = op12_negatives.Rows.__new__(op12_negatives.Rows)
    rows.id, rows.x, rows.codes, rows.residual, rows.norm = np.arange(3000), x, codes, residual, np.linalg.norm(x, axis=1)
    lower, upper = op12_negatives.bounds(rows, slice(0, 20), rows, slice(0, 3000), centres)
    exact = x @ x[:20].T
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (upper - lower).mean() < 0.35 * 2 * 65536  # the bounds tell something


# 13


def page_rows():
    return [
        (1, "http://a.org/x y\r\nHost: evil", "<p>same</p>"),
        (2, None, "<p>same</p>"),
        (2, "http://a.org/2", "<p>same</p>"),
        (9, "http://a.org/9", "<p>same</p>"),
        (9, "http://a.org/9", "<p>same</p>"),
        (3, "http://b.org/", None),
        (4, "http://b.org/4", ""),
        (None, "http://c.org", "<p>same</p>"),
        (None, "http://c.org", "only here"),
        (5, "http://d.org", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "é漢\x00" * 100_000),
        (6, "http://d.org/6", "unique"),
    ]


def expected(rows, least=0):
    body = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, b in body:
        top = max((q for q, c in body if c == b and q is not None), default=None)
        again = len(b) >= least and p != top
        out.append((p, "revisit" if again else "response", len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5, 12])
def test_pages_round_trip(spark, least):
    pages = clashing(spark.createDataFrame(page_rows(), "page_id long, url string, html string")).repartition(3)
    got = op13_warc.read(op13_warc.archived(pages, least)).drop("uri")
    assert sorted(map(tuple, got.collect()), key=str) == expected(page_rows(), least)


def test_payloads_and_urls_come_back(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    rows = op13_warc.read(op13_warc.archived(pages), payload=True).where("record_type = 'response'").collect()
    bodies = {bytes(r["payload"]) for r in rows}
    assert bodies == {(h or "").encode() for _, _, h in page_rows()}
    assert all("\r" not in (r["uri"] or "") for r in rows)
    assert op13_warc.read(op13_warc.archived(pages.where("false"))).count() == 0


def test_a_monolith_becomes_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13_warc, "PIECE", 64)
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", f"<p>{i}</p>" * i) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    raw = op13_warc.monolithic(op13_warc.roles(pages), f"{tmp_path}/raw").collect()
    data = open(raw[0]["path"], "rb").read()
    whole = gzip.decompress(data)
    assert sum(r["records"] for r in raw) == 40
    # a file of several members, the first with two records, is normalised just the same
    cut = [m.start() for m in re.finditer(b"WARC/1.1\r\n", whole)][2]
    (tmp_path / "mixed.warc.gz").write_bytes(gzip.compress(whole[:cut]) + gzip.compress(whole[cut:]))
    listed = spark.createDataFrame([(str(tmp_path / "mixed.warc.gz"),)], "path string")
    index = op13_warc.normalised(listed, f"file://{tmp_path}/members").orderBy("offset").collect()
    path = index[0]["path"].removeprefix("file://")
    out = open(path, "rb").read()
    assert len(index) == 41 and gzip.decompress(out) == whole
    parts = [gzip.decompress(out[r["offset"] : r["offset"] + r["length"]]) for r in index]
    assert b"".join(parts) == whole and all(p.startswith(b"WARC/1.1") for p in parts)
    side = [line.split("\t") for line in open(path + ".idx").read().splitlines()]
    assert [(int(x[0]), int(x[1]), x[2]) for x in side] == [(r["offset"], r["length"], r["type"]) for r in index]


def test_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, None, f"<p>{i}</p>" * 500) for i in range(10)], "page_id long, url string, html string").coalesce(1)
    raw = op13_warc.monolithic(op13_warc.roles(pages), f"{tmp_path}/raw").collect()
    data = open(raw[0]["path"], "rb").read()
    (tmp_path / "short.warc.gz").write_bytes(gzip.compress(gzip.decompress(data)[:-9000]))
    listed = spark.createDataFrame([(str(tmp_path / "short.warc.gz"),)], "path string")
    with pytest.raises(Exception, match="the archive ends"):
        op13_warc.normalised(listed, f"{tmp_path}/a").collect()
    kept = op13_warc.normalised(listed, f"{tmp_path}/b", strict=False)
    n = kept.count()
    assert 1 < n < 11


def test_awkward_documents_as_pages(spark, awkward):
    pages = awkward.select(F.col("doc_id").alias("page_id"), F.lit("http://x.org").alias("url"), F.col("text").alias("html"))
    got = op13_warc.read(op13_warc.archived(pages)).drop("uri")
    assert sorted(map(tuple, got.collect()), key=str) == expected([(r["page_id"], None, r["html"]) for r in pages.collect()])
