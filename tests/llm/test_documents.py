"""Operators over documents: awkward tables, and brute force on small ones."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from lexitide.llm import op1_tokens, op3_packing, op4_pii, op6_neardup, op7_language, op8_decontaminate, op10_quality
from tests.llm.conftest import LONG, awkward_rows

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op1_tokens.MODEL))


def test_pretokens_add_up(model):
    rng = random.Random(1)
    for _ in range(5000):
        s = "".join(rng.choice(["a", "the", " ", "  ", "\n", "\r", "\t", "▁", "é", "漢", "<s>", "▁▁", "}", ";", "\xa0", "x" * 5]) for _ in range(rng.randint(0, 14)))
        assert sum(op1_tokens.piece_counts(model, op1_tokens.pretokens(s))) == len(model.encode(s))


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_token_counts(awkward, model, head):
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_tokens) for r in op1_tokens.token_counts(awkward, head=head).collect())
    want = sorted(((-1 if r[0] is None else r[0]), len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in awkward_rows())
    assert got == want


def test_frequent_pretokens_are_bounded(spark):
    rows = [(f"p{i}", max(1, 4000 // (i + 1)), 2) for i in range(2000)] + [("long" * 400, 3000, 9)]
    pieces = spark.createDataFrame(rows, "pretoken string, n long, pieces long")
    for head, size in ((100, 1 << 20), (1 << 18, 3000)):
        got = op1_tokens.frequent(pieces, head, size).collect()
        assert 0 < len(got) <= head and sum(len(r.pretoken) for r in got) <= size and "p0" in {r.pretoken for r in got}
    assert "long" * 400 in {r.pretoken for r in op1_tokens.frequent(pieces).collect()}  # a common long one is no hot key


def test_token_counts_empty(empty):
    assert op1_tokens.token_counts(empty).collect() == []


# 3


def test_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(100):
        lengths = np.sort(rng.choice(40, rng.integers(1, 9), replace=False)) + 1
        counts, k = rng.integers(1, 20, len(lengths)), int(rng.integers(1, 5))
        cost = lambda b: sum(int(n) * (min(x for x in b if x >= m) - m) for m, n in zip(lengths, counts))
        best = min(cost([*s, lengths[-1]]) for r in range(min(k, len(lengths))) for s in itertools.combinations(lengths[:-1], r))
        assert cost(op3_packing.optimal_bounds(lengths, counts, k)) == best


def test_packing(awkward):
    rows = op3_packing.pack(awkward, max_len=1000, buckets=3, budget=3000, chunk=50).collect()
    size = {i: len((t or "").encode()) for i, t, *_ in awkward_rows()}
    total = sum(len((r[1] or "").encode()) for r in awkward_rows())
    assert sum(r.n_tokens for r in rows) == total and {r.doc_id for r in rows} == set(size)
    for r in rows:
        assert r.start == r.seq * 1000 and (r.bucket is None) == (r.n_tokens == 0) == (r.batch is None)
        assert r.bucket is None or r.n_tokens <= r.bucket_len
    places = [(r.bucket, r.batch, r.slot) for r in rows if r.bucket is not None]
    assert len(set(places)) == len(places)
    for bucket, length in {(r.bucket, r.bucket_len) for r in rows if r.bucket is not None}:
        own = sorted((r.batch, r.slot) for r in rows if r.bucket == bucket)
        capacity = max(1, 3000 // length)
        assert own == [(i // capacity, i % capacity) for i in range(len(own))]  # full batches, but for the last


def test_packing_empty(empty):
    assert op3_packing.pack(empty).collect() == []


# 4


def _base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_like_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        s = "".join(rng.choice(["a", "1", "25", "256", ".", "@", "-", " ", "+", "(", ")", "é", "x@y.com", "4539578763621486", "0", "%", "a.b", "1.2.3.4", "\n"]) for _ in range(rng.randint(0, 25)))
        assert op4_pii.base_spans(s) == _base(s), s


def test_long_runs_cost_little():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 150_000, "(at) " * 50_000):
        op4_pii.candidates(text)
    began = time.monotonic()
    for text in ("a" * 1_000_000 + " " + "b" * 300 + "@x.com", "b" * 1_000_000 + "@x.com", "a.@" * 300_000, "x (at) " * 140_000):
        op4_pii.candidates(text)
    assert time.monotonic() - began < 30


def test_hot_contexts_are_one_row(spark):
    """A context that most documents share is one row of the bounded sample, and counts as often as it occurs."""
    docs = spark.createDataFrame([(i, "call (212) 555-0100 today") for i in range(400)] + [(1000 + i, f"fax {i} at (212) 555-01{i:02d} now") for i in range(60)], "doc_id long, text string")
    model = op4_pii.fit(docs, sample=20)
    assert all("phone" in r.spans for r in op4_pii.annotate(docs, model).where("doc_id < 1000").collect())


def test_pii(spark, awkward, empty):
    texts = ["mail bob@example.com now", "+1 (884) 555-3918 63.51.224.77 and", "nothing here", "call (212) 555-0100 today", "card 4539578763621486"] * 8
    docs = awkward.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    model = op4_pii.fit(docs)
    rows = op4_pii.annotate(docs, model).collect()
    text = {100 + i: t for i, t in enumerate(texts)} | {r[0]: r[1] for r in awkward_rows()}
    assert len(rows) == len(texts) + len(awkward_rows())
    for r in rows:
        base = _base(text[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(f"{op4_pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]
        found = r.spans.split(",") if r.spans else []
        assert {f"{op4_pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(found)
    by = {r.doc_id: r.spans for r in rows}
    assert by[101] == "phone:0:17,ip:18:30"  # the phone number is the method's
    assert by[102] == by[7] == ""
    clean = {r.doc_id: r.text for r in op4_pii.redacted(docs, model).collect()}
    assert clean[100] == "mail <EMAIL> now" and clean[102] == "nothing here" and clean[0] is None and clean[5] == LONG
    assert op4_pii.annotate(empty, op4_pii.fit(empty)).collect() == []


def labelled_contexts(rng):
    """(text, the span to add or None): numbers and addresses that no base pattern takes, half of them personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = rng.choice
    yes = [
        lambda: (pick(["call ", "phone ", "my tel ", "fax: "]), f"({pick('2345')}{n(2)}) {n(3)}-{n(4)}", pick([" today", ", please", ""])),
        lambda: (pick(["telephone ", "mobile: ", "cell "]), f"{pick('2345')}{n(2)}-{n(3)}-{n(4)}", pick([" or later", "."])),
        lambda: (pick(["phone ", "tel. ", "call us: "]), f"020 7{n(3)} {n(4)}", pick([" after noon", ""])),
        lambda: (pick(["telefon ", "fax "]), f"(0{pick('23456')}1) {n(4)} {n(4)}", " werktags"),
        lambda: (pick(["téléphone ", "tel "]), f"0{pick('12345')} " + " ".join(n(2) for _ in range(4)), " le matin"),
        lambda: (pick(["write to ", "contact ", "e-mail "]), f"{pick(['ann', 'bob.lee', 'c_day'])}{n(2)} [at] {pick(['mill', 'old-town'])} [dot] {pick(['org', 'com', 'de'])}", " soon"),
        lambda: (pick(["server ", "login from "]), ":".join(f"{rng.randrange(4096, 65536):x}" for _ in range(8)), " again"),
    ]
    no = [
        lambda: (pick(["isbn ", "ISBN: "]), f"978 {n(3)} {n(4)} {n(3)}", pick([" in cloth", ""])),
        lambda: (pick(["order ", "order no. ", "ref ", "ticket "]), f"{n(3)} {n(3)} {n(4)}", pick([" was sent", ""])),
        lambda: (pick(["invoice ", "serial ", "model no "]), f"020 7{n(3)} {n(4)}", " of May"),
        lambda: (pick(["part ", "item ", "tracking "]), f"{pick('2345')}{n(2)}-{n(3)}-{n(4)}", " in blue"),
        lambda: (pick(["version ", "build ", "release "]), f"{rng.randrange(300, 999)}.{n(1)}.{n(2)}.{n(1)}", " is out"),
        lambda: (pick(["figure ", "page "]), f"0{pick('12345')} " + " ".join(n(2) for _ in range(4)), " shows it"),
        lambda: ("date ", f"{n(3)}-{n(3)}-{n(4)}", " of the log"),
    ]
    for i in range(300):
        before, own, after = pick((yes, no)[i % 2])()
        text = f"{pick(['So he said: ', 'It was late. ', ''])}{before}{own}{after}"
        yield text, (text.index(own), text.index(own) + len(own)) if i % 2 == 0 else None


def test_added_spans_on_labelled_contexts(small):
    """A model that saw the corpus alone: of the spans that it adds nine tenths are right, and of those to add it finds as many."""
    model = op4_pii.fit(small)
    right = wrong = missed = 0
    for text, want in labelled_contexts(random.Random(8)):
        base, found = op4_pii.spans(text, model)
        added = {(s, e) for s, k, e in found if (s, k, e) not in base}
        right, wrong, missed = right + (want in added), wrong + len(added - {want}), missed + (want is not None and want not in added)
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9, (right, wrong, missed)
    for text in ("isbn 978 316 1484 100", "ref 123 456 7890", "card 4539-5787-6362-1487 visa"):
        assert op4_pii.spans(text, model) == ([], [])
    assert op4_pii.spans("phone 020 7946 0958", model)[1] == [(6, 3, 19)]


def test_expectation_maximisation_finds_reliabilities():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    right = np.array([0.9, 0.8, 0.85, 0.6, 0.7])
    votes = np.where(rng.random((4000, 5)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, theta, prior = op4_pii.expectation_maximisation(patterns, counts.astype(float))
    # as good as with the true reliabilities
    odds = np.log(0.4 / 0.6) + np.where(votes == 1, np.log(right / (1 - right)), np.where(votes == 0, np.log((1 - right) / right), 0)).sum(1)
    assert ((p[inverse.ravel()] > 0.5) == truth).mean() > ((odds > 0) == truth).mean() - 0.005 and abs(prior - 0.4) < 0.03
    assert np.allclose(theta[1, :, 2] / theta[1, :, 1:].sum(1), right, atol=0.05)


# 6


def brute_components(texts, width):
    sets = []
    for t in texts.values():
        w = PLAIN.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    ids, parent = list(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        c = len(sets[i] & sets[j])
        if c and 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            parent[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {x: min(g) for g in groups.values() for x in g}, {i: len(s) for i, s in zip(ids, sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_like_brute_force(spark, width):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 30)) for _ in range(60)]
    texts = {}
    for i in range(120):  # copies of copies, a group in which many pairs are just apart
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"n{rng.randint(0, 5)}"
        texts[i] = " ".join(own)
    for i in range(120, 160):
        texts[i] = " ".join(rng.choice(base) for _ in range(rng.randint(1, 40)))
    texts |= {160: None, 161: "", 162: "single", 163: "SINGLE", 164: " \n", 165: "two words", 166: "Two\twords"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    component, size = brute_components(texts, width)
    got = op6_neardup.near_duplicates(docs, width).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got} == component and {r.doc_id: r.n_shingles for r in got} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_mixed_buckets(spark, monkeypatch):
    """Buckets of many chunks of lookers and members lose nothing."""
    monkeypatch.setattr(op6_neardup, "CHUNK", 16)
    rng = random.Random(6)
    texts = {}
    for k in range(3):  # groups that share much, so that they meet in buckets without being one component
        base = [f"w{i}" for i in range(56)] + [f"g{k}x{i}" for i in range(4 * k)]
        for i in range(90):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 400)}"
            texts[100 * k + i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    component, size = brute_components(texts, 2)
    got = op6_neardup.near_duplicates(docs, 2).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (component[i], size[i]) for i in texts}


def test_long_texts_in_a_large_bucket(spark, monkeypatch):
    """Blocks are cut by the size of the sets, too: a block holds few long texts, and nothing is lost."""
    monkeypatch.setattr(op6_neardup, "BLOCK_SHINGLES", 5000)
    seen, work = [], op6_neardup.in_blocks
    monkeypatch.setattr(op6_neardup, "in_blocks", lambda held, f: (seen.append(held.select("key", "id", "n_shingles").toPandas()), work(held, f))[1])
    rng = random.Random(4)
    texts = {}
    for k in range(3):  # near the threshold between groups, so that buckets hold several components
        base = [f"w{i}" for i in range(1500)] + [f"g{k}x{i}" for i in range(130 * k)]
        for i in range(8):
            own = list(base)
            for _ in range(40):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 9000)}"
            texts[10 * k + i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    component, size = brute_components(texts, 2)
    got = op6_neardup.near_duplicates(docs, 2).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (component[i], size[i]) for i in texts}
    assert any(len(s) and s.groupby("key").n_shingles.sum().max() > 2 * 5000 for s in seen)


def test_repeated_ids_with_different_texts(spark):
    """Every text of a doc_id is linked as it is."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, one), (1, two), (2, one + " more"), (3, two), (4, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_neardup.near_duplicates(docs, 2).collect())
    assert got == [(1, 29, 1), (1, 29, 1), (2, 30, 1), (3, 29, 1), (4, 0, 4)] or got == [(1, 29, 1), (2, 30, 1), (3, 29, 1), (4, 0, 4)]


def test_near_duplicates_awkward(awkward, empty):
    rows = {r.doc_id: r for r in op6_neardup.near_duplicates(awkward).collect()}
    assert set(rows) == set(range(9)) and rows[4].component_id == 3 and not rows[4].kept and rows[0].component_id == 0 and rows[1].n_shingles == 0
    assert op6_neardup.near_duplicates(empty).collect() == []


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.95):
        both = rng.integers(1 << 63, size=2000, dtype=np.uint64)
        n = round(2000 * (1 - share) / (1 + share))
        a = np.concatenate([both[: 2000 - n], rng.integers(1 << 63, size=n, dtype=np.uint64)])
        b = np.concatenate([both[: 2000 - n], rng.integers(1 << 63, size=n, dtype=np.uint64)])
        true = (2000 - n) / (2000 + n)
        x, y = (np.frombuffer(op6_neardup.odd_sketch(op6_neardup.minhashes(v)), np.uint64) for v in (a, b))
        flipped = int(np.bitwise_count(x ^ y).sum())
        assert abs(op6_neardup.sketch_similarity(flipped) - true) < 0.08
        assert true < 0.8 or flipped <= op6_neardup.MOST_FLIPPED


# 7


def test_gradients():
    net = op7_language.Network.fresh(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = net.gradients(x, y)
    for k in net.p:
        for _ in range(4):
            i = tuple(int(rng.integers(0, s)) for s in net.p[k].shape)
            i = (int(x.flat[rng.integers(x.size)]), i[1]) if k[0] == "x" else i
            loss = []
            for e in (1e-5, -2e-5):
                net.p[k][i] += e
                loss.append(net.gradients(x, y)[0])
            net.p[k][i] += 1e-5
            assert abs((loss[0] - loss[1]) / 2e-5 - g[k][i]) < 1e-6


def test_language(spark, small, awkward, empty):
    net = op7_language.fit(small)
    rows = op7_language.identify(small, net).collect()
    lang = {r.doc_id: r.lang for r in small.select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = op7_language.identify(awkward, net).collect()
    assert len(got) == len(awkward_rows()) and {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 7}
    assert op7_language.identified(awkward, net).columns == awkward.columns
    kept = {r.lang for r in op7_language.identified(small, net, languages=frozenset({"fr"})).select("lang").collect()}
    assert kept == {"fr"} or len(kept - {"fr"}) <= 1
    assert op7_language.fit(empty) is None and op7_language.identify(empty, net).collect() == []
    assert {r.lang_pred for r in op7_language.identify(awkward, None).collect()} == {"und"}


def test_training_rows_are_shared_by_language(spark):
    """Unlabelled rows don't thin the sample, and a rare language stays in it."""
    rows = [(i, f"common{i} word", "a") for i in range(2000)] + [(i, f"other{i} word", "b") for i in range(2000, 3000)] + [(i, f"rare{i} word", "c") for i in range(3000, 3008)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    unlabelled = spark.range(10_000, 30_000).selectExpr("id doc_id", "'no label here' text", "cast(null as string) lang")
    want = sorted(op7_language.training_words(labelled, 60))
    assert sorted(op7_language.training_words(labelled.unionByName(unlabelled), 60)) == want
    n = {k: sum(r[0] == k and r[1] != b"word" for r in want) for k in "abc"}
    rare = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(3000, 3008))
    assert 0 < n["c"] == rare and n["a"] + n["b"] + n["c"] == 60 and abs(n["a"] - n["b"]) <= 1
    few = op7_language.training_words(labelled, 60, 30)
    assert {r[0] for r in few} == set("abc") and len(few) == 30


def test_a_word_counts_as_often_as_it_occurs(small):
    net = op7_language.Network.fresh(["a", "b"])
    score = op7_language.Scorer(net)
    own = op7_language.segments("the cat the dog " + "y" * 50)
    logp = np.concatenate([net.log_probabilities(np.frombuffer(w, np.uint8)[None])[:, 0] for w in own])
    p = np.exp(logp.astype(float).mean(0))
    label, got = score(own)
    assert got == pytest.approx(p.max() / p.sum(), rel=1e-5) and label == "ab"[p.argmax()]


# 8


def test_retrieval_skips_nothing(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = op8_decontaminate.Index(items)
    assert index.ids == [i for i, _ in items]
    rng = random.Random(4)
    pool = [w for _, t in items for w in op8_decontaminate.words(t)]
    for _ in range(400):
        own = op8_decontaminate.words(rng.choice(items)[1])
        passage = rng.sample(pool, 30) + rng.sample(own, rng.randint(0, len(own)))
        terms = np.unique([index.vocabulary[w] for w in passage])
        full = np.zeros(len(index.ids))
        for t in terms:
            full[index.items[t]] += index.impacts[t]
        assert [i for i, _ in index.retrieve(terms)] == np.nonzero(full >= op8_decontaminate.RETRIEVE - 1e-9)[0].tolist()


def test_leaks(spark, sf, awkward, empty):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    first = [r.text for r in items.orderBy("item_id").limit(3).collect()]
    words = first[0].split()
    docs = spark.createDataFrame(
        [(1, LONG + first[0] + LONG), (2, "before " * 61 + first[1].upper().replace(" ", "\n") + " after"), (3, " ".join(words[:10])), (4, " ".join(reversed(words))), (5, first[2] + " " + first[0]), (6, None), (6, ""), (None, first[0])],
        "doc_id long, text string",
    )
    ids = [r.item_id for r in items.orderBy("item_id").limit(3).collect()]
    scores = []
    for shard in (200_000, 300):
        found = op8_decontaminate.contaminated(docs, items, shard).collect()
        assert sorted(((r.doc_id or -1), r.item_id) for r in found) == sorted([(1, ids[0]), (2, ids[1]), (5, ids[0]), (5, ids[2]), (-1, ids[0])])
        scores.append(sorted(((r.doc_id or -1), r.item_id, round(r.score, 9)) for r in found))
    assert scores[0] == scores[1]  # statistics are those of all items, whatever the shards
    for kind in ("smallint", "string", "decimal(20,0)"):
        assert op8_decontaminate.contaminated(docs, items.select(F.col("item_id").cast(kind), "text")).count() == 5
    assert op8_decontaminate.contaminated(awkward, items).collect() == []
    assert sorted(r.doc_id for r in op8_decontaminate.uncontaminated(docs, items).collect()) == [3, 4, 6, 6]
    assert op8_decontaminate.uncontaminated(awkward, items).columns == awkward.columns
    assert op8_decontaminate.contaminated(empty, items).collect() == [] == op8_decontaminate.contaminated(docs, items.limit(0)).collect()


def test_items_of_all_lengths(spark):
    """A long item and a short one are each found, in windows of their own; a question that is another's isn't."""
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate((3, 12, 63, 64, 65, 500, 5000))]
    docs = [(k, "start " * 70 + t + " end" * 90) for k, t in items] + [(100, "nothing of it " * 300)]
    got = op8_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k, _ in items]
    question, answer = "one two three four five six?", " ".join(f"a{i}" for i in range(40)) + "."
    index = op8_decontaminate.Indexes([(1, f"{question} {answer}")])
    assert index.matches(f"{question} {answer}") and not index.matches(f"six five four three two one? {answer}")


def test_items_without_white_space(spark):
    """Shards are cut by the index's own words, so that items joined by commas fill several; each is found, and only once."""
    items = [(k, ",".join(f"i{k}w{i}" for i in range(200))) for k in range(6)]
    docs = [(k, f"before,{t.upper()},after") for k, t in items] + [(9, "nothing,of,it"), (10, None)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    n, parts = op8_decontaminate.shards(items, 300)
    assert n == 4 and sum(len(i.ids) for p in parts for i in p.parts) == 6
    found = op8_decontaminate.contaminated(docs, items, 300).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(k, k) for k in range(6)]
    assert sorted(r.doc_id for r in op8_decontaminate.uncontaminated(docs, items, 300).collect()) == [9, 10]


def test_question_and_answer():
    assert op8_decontaminate.question_and_answer("Who? Me, of course.") == (["who"], ["me", "of", "course"])
    assert op8_decontaminate.question_and_answer("First part. Second part.") == (["first", "part"], ["second", "part"])
    assert op8_decontaminate.question_and_answer("a b c d") == (["a", "b", "c"], ["d"])


# 10


def test_ordinal_slopes():
    rng = np.random.default_rng(0)
    score, y, t = rng.normal(size=6), np.array([0, 1, 2, 3, 1, 2]), np.array([-1.0, 0.2, 1.5])
    _, ds, dt = op10_quality.loss_and_slopes(score, t, y)
    e = 1e-6
    assert np.allclose((op10_quality.loss_and_slopes(score + e, t, y)[0] - op10_quality.loss_and_slopes(score - e, t, y)[0]) / 2 / e, ds, atol=1e-6)
    for k in range(3):
        step = np.eye(3)[k] * e
        assert np.allclose((op10_quality.loss_and_slopes(score, t + step, y)[0] - op10_quality.loss_and_slopes(score, t - step, y)[0]) / 2 / e, dt[:, k], atol=1e-6)


def test_quality(spark, awkward, empty):
    rng = random.Random(7)
    good, bad = "clear useful careful report".split(), "worthless junk awful noise".split()
    rows = [(i, " ".join(rng.choice(good if rng.random() < (0.1, 0.5, 0.9)[i % 3] else bad) for _ in range(60)), i % 3) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    grades = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 400] + [(None, 1), (5, None)], "doc_id long, grade int")
    model = op10_quality.fit(docs, grades)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in op10_quality.graded(docs, model).collect()}
    assert np.mean([round(out[i].expected_grade) == g for i, _, g in rows if i >= 400]) > 0.9
    assert np.mean([out[i].selected == (g == 2) for i, _, g in rows if i >= 400]) > 0.9
    assert op10_quality.graded(awkward, model).count() == len(awkward_rows())
    assert op10_quality.fit(docs, grades.limit(0)) is None and {r.selected for r in op10_quality.graded(docs, None).collect()} == {False}
    assert op10_quality.graded(empty, model).collect() == []
