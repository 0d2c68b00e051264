"""URL filter and main text."""

import html
import re
import time

import numpy as np
import pandas as pd
import pytest

from lexitide.llm import op2_urls, op5_html
from lexitide.runtime import Scratch


def test_urls(spark):
    rows = [
        (1, "http://a.org/x?y", None),
        (2, "HTTPS://Sub.Example.ORG/es/1#z", ""),
        (3, "http://example.org/en/12", "<a href='http://other.net/'>x</a>"),
        (4, "http://b.com/fr/1", None),
        (5, "http://b.com/de/1?q", None),
        (6, None, None),
        (7, "no scheme", None),
        (8, "x://HOST", None),
        (8, "x://HOST", None),
        (None, "http://notorg/", None),
        (9, "http://xcom/fr/", None),
        (10, "http://c.com/?a://b/c", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' host", "'clash' rule", "'clash' trust")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op2_urls.judge(pages).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow")
    assert got[2] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][:3] == ("host", "", None) and got[None][:3] == ("notorg", "/", None) and got[9][2] is None and got[10][:2] == ("c.com", "/")
    assert op2_urls.judge(pages).count() == len(rows)
    assert op2_urls.judge(pages.limit(0)).collect() == []


def test_distrust_flows_against_links(spark):
    link = lambda *hosts: "".join(f'<p><a class=x href="http://{h}/">t</a>' for h in hosts)
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://friend.net/", link("bad.com", "bad.com")), (3, "http://good.org/", link("fine.net")), (4, "http://fine.net/", "")] + [(10 + i, f"http://h{i}.net/", "") for i in range(6)]
    got = {r.host: r for r in op2_urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["friend.net"].verdict == "block" and got["fine.net"].verdict == "allow" and got["fine.net"].trust > 0 and got["h0.net"].verdict == "allow"


def test_rank_like_power_iteration(spark):
    rng = np.random.default_rng(2)
    n, a = 12, np.zeros((12, 12))
    for i, j in rng.integers(0, n - 2, (30, 2)):  # the last two link nowhere
        a[i, j] += i != j
    a[0, 10] = a[1, 11] = 2
    links = spark.createDataFrame([(f"h{i}", f"h{j}", int(a[i, j])) for i in range(n) for j in range(n) if a[i, j]], "src string, dst string, n long")
    seed = np.zeros(n)
    seed[[0, 3]] = (0.25, 0.75)
    got = {r.host: r.rank for r in op2_urls.propagate(Scratch(spark, "t"), links, spark.createDataFrame([("h0", 1.0), ("h3", 3.0)], "host string, weight double"), rounds=10).collect()}
    out = a.sum(1)
    x = seed.copy()
    for _ in range(10):
        moved = sum((x[i] * a[i] / out[i] for i in range(n) if out[i]), np.zeros(n))
        x = 0.85 * (moved + x[out == 0].sum() * seed) + 0.15 * seed
    assert [got.get(f"h{i}", 0.0) for i in range(n)] == pytest.approx(x.tolist(), abs=1e-12)


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return op5_html.fit(pages)


def test_article_text(pages, trees):
    """Held against the article element, cut by plain patterns, for pages that all have one."""
    source = {r.page_id: r for r in pages.collect()}
    for r in op5_html.extract(pages, trees).collect():
        inner = source[r.page_id].html
        inner = inner[inner.index("<article>") + 9 : inner.rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == source[r.page_id].url


def test_unseen_kinds_of_boilerplate(trees):
    page = """<html><body><div class="topbar menu"><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></div><div id="main-content"><h1>Title &amp; more</h1>
    <p>First para of the story, with <a href=z>a link</a> and words that go on.<p>Second para is also long, and has punctuation; it continues.
    <div class="advert">Buy now!</div><blockquote><p>Quoted   words here, long enough to be content.</p></blockquote><section id="comments"><p>Reader one: I think this is a good article, thanks.</p></section></div>
    <aside class=sidebar><p>Related: things</p></aside><div class="cookie-notice">We use cookies to do things.</div><form><label>Search</label><input></form><footer>(c) 2020</footer><script>var t="</p>";</script></body></html>"""
    assert op5_html.main_text(page, trees).split("\n") == [
        "Title & more",
        "First para of the story, with a link and words that go on.",
        "Second para is also long, and has punctuation; it continues.",
        "Quoted words here, long enough to be content.",
    ]


LONG = "First para of the story, with words that go on and on, and some punctuation."
MORE = "Second para is also long, and has punctuation; it continues for a while."


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<article><header><h1>Headline</h1></header><p>{LONG}</p><p>{MORE}</p></article>", ["Headline", LONG, MORE]),
        (f'<div id="content"><div class="story-header"><h1>Headline</h1></div><p>{LONG}</p></div>', ["Headline", LONG]),
        (f'<main><header><a href=/>Home</a> <a href=/n>News</a></header><article><h1>Headline</h1><p>{LONG}</p></article></main>', ["Headline", LONG]),
        (f"<header><h1>The site</h1><a href=/>Home</a></header><article><p>{LONG}</p></article>", [LONG]),
        (f'<article><p>{LONG} <span class="advert">Buy now</span></p><p>{MORE}</p></article>', [LONG, MORE]),
        (f'<article><p>{LONG} <span class="ad-slot">Buy <span>now</span> or</span> and more</p><p>{MORE}</p></article>', [LONG + " and more", MORE]),
        (f'<article><p>{LONG} <span class="advert">Buy now</p><p>{MORE}</p></article>', [LONG, MORE]),
        (f'<article><p>{LONG}</p><a class="sponsored"><div>Buy it, now.</div></a><p>{MORE}</p></article>', [LONG, MORE]),
        (f'<article data-id="footer"><p data-class="comments" title="my id=footer">{LONG}</p></article>', [LONG]),
        (f"<article><p>{LONG}</p><noscript><p>{MORE}</p></article>", [LONG, MORE]),
        (f"<title>No end<article><p>{LONG}</p></article>", [LONG]),
        (f"<article><p>{LONG}</p><iframe src=x><p>{MORE}</p></article>", [LONG, MORE]),
        (f"<article><p>{LONG}</p><noscript>off</noscript><template>t</template><p>{MORE}</p></article>", [LONG, MORE]),
        (f"<article><p>{LONG}</p><script>var x = 1;<p>{MORE}</p></article>", [LONG]),
        (f'<article class=post id = main><p class=text role=note>{LONG}</p><footer>By us</footer></article>', [LONG]),
    ],
)
def test_forms_of_pages(trees, html, want):
    got = op5_html.main_text(f"<html><body>{html}</body></html>", trees).split("\n")
    assert [t for t in got if not t.startswith("No end")] == want


def test_merged_rows_boost_alike():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (400, 5)).astype(float)
    y = (x[:, 0] + x[:, 1] > 3).astype(float)
    y[rng.random(400) < 0.1] = 0
    once = op5_html.boost(x, y, np.ones(400))
    twice = op5_html.boost(np.concatenate([x, x]), np.concatenate([y, y]), np.full(800, 0.5))
    assert np.allclose(once.log_odds(x), twice.log_odds(x)) and np.mean((once.log_odds(x) > 0) == (y > 0)) > 0.85


def test_decoding_is_the_best_consistent_choice():
    import itertools
    import types

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 8
        page = types.SimpleNamespace(parent=[-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        score = rng.normal(size=n)
        score[0] = 0

        def value(kept):
            return sum(score[i] if kept[i] else -score[i] for i in range(n))

        legal = [k for k in itertools.product((False, True), repeat=n) if k[0] and all(not k[i] or k[page.parent[i]] for i in range(1, n))]
        assert value(op5_html.decode(page, score)) == pytest.approx(max(map(value, legal)))


def test_awkward_pages(spark, trees):
    deep = "<div>" * 3000 + "text" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (3, "u", "no markup at all"), (3, "u", "no markup at all"), (None, "u", "<p>unclosed <b>bold"), (4, "u", "<<<>>> <a b='"), (5, "u", deep), (6, "u", "<p>" + "long " * 100_000 + "</p>"), (7, "u", "</p></div></html>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' text", "1 n_chars")
    got = op5_html.extract(df, trees).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 7)} == {""}
    assert op5_html.fit(df.limit(0)) is None and op5_html.extract(df.limit(0), trees).collect() == []
    kept = {r.page_id: r.text for r in op5_html.extract(df, None).collect()}  # without trees all text stays
    assert kept[3] == "no markup at all" and kept[None] == "unclosed bold" and kept[2] == ""


def test_pages_without_cues(spark, pages):
    """Without telling tags and tokens anywhere, density labels: nearly all of the article stays, most of the rest goes."""
    source = pages.limit(300).collect()
    plain = [(r.page_id, r.url, re.sub(r"(</?)(?:article|nav|footer|header|aside|main|section|form)\b", r"\1div", re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", r.html))) for r in source]
    bare = spark.createDataFrame(plain, "page_id long, url string, html string")
    trees = op5_html.fit(bare)
    assert trees is not None and not any((op5_html.cue_labels(op5_html.features(p, p.blocks())) >= 0).any() for p in map(op5_html.Page, (r[2] for r in plain[:20])))
    cued = op5_html.fit(pages)
    want = {r.page_id: op5_html.main_text(r.html, cued) for r in source}
    got = {r.page_id: r.text for r in op5_html.extract(bare, trees).collect()}
    common = {i: len(set(got[i].split("\n")) & set(want[i].split("\n"))) for i in want}
    assert all(got.values())
    assert np.mean([common[i] / len(set(want[i].split("\n"))) for i in want]) > 0.9
    assert np.mean([common[i] / len(set(got[i].split("\n"))) for i in want]) > 0.7


def test_long_pages_cost_little():
    pages = ['<a "' * 250_000, '<a "' * 250_001 + ">", '<a b="' * 150_001 + ">", "<!" * 500_000, "<div>" * 50_000 + "</ul>" * 50_000, "<div>" * 50_000 + "</div>" * 50_000, "<center>" * 50_000 + "<li>" * 50_000, "<noscript>" * 100_000, "<span class=ad>" * 100_000, "<p " + "a='" * 300_000 + ">", "<a " * 300_000]
    began = time.monotonic()
    for html in pages:
        page = op5_html.Page(html)
        op5_html.features(page, page.blocks())
    assert time.monotonic() - began < 60


def test_links_of_long_pages(spark):
    html = '<a "' * 250_000 + '<a title=x href="http://other.org/x">t</a>'
    began = time.monotonic()
    assert [(r.src, r.dst, r.n) for r in op2_urls.host_links(spark.createDataFrame([("http://h/", html)], "url string, html string")).collect()] == [("h", "other.org", 1)]
    assert time.monotonic() - began < 60


def test_rank_of_many_hosts(spark):
    """100,000 hosts, one of which a third of all links come from, against power iteration; trust and distrust alike."""
    rng = np.random.default_rng(3)
    n = 100_000
    src, dst = np.where(rng.random(400_000) < 0.33, 0, rng.integers(0, n - 1000, 400_000)), (n * rng.random(400_000) ** 2).astype(int)
    src, dst = src[src != dst], dst[src != dst]
    both = np.unique(np.stack([src, dst], 1), axis=0, return_counts=True)
    links = spark.createDataFrame(pd.DataFrame({"src": [f"h{i}" for i in both[0][:, 0]], "dst": [f"h{i}" for i in both[0][:, 1]], "n": both[1]}))
    for a, b in ((0, 1), (1, 0)):
        edges = links if a == 0 else links.select(links.dst.alias("src"), links.src.alias("dst"), "n")
        seeds = np.zeros(n)
        seeds[::1000] = 1.0
        got = op2_urls.propagate(Scratch(spark, "t"), edges, spark.createDataFrame([(f"h{i}", 1.0) for i in range(0, n, 1000)], "host string, weight double"), rounds=2)
        got = {r.host: r.rank for r in got.collect()}
        out, x, start = np.bincount(both[0][:, a], both[1], n), seeds / seeds.sum(), seeds / seeds.sum()
        for _ in range(2):
            share = np.where(out[both[0][:, a]] > 0, x[both[0][:, a]] * both[1] / np.maximum(out[both[0][:, a]], 1), 0)
            moved = 0.85 * np.bincount(both[0][:, b], share, n)
            x = moved + (1 - moved.sum()) * start
        assert np.allclose([got.get(f"h{i}", 0.0) for i in range(n)], x, atol=1e-12)


def test_verdicts_like_brute_force(spark):
    """Rules, hosts, trust and distrust of generated pages, written plainly."""
    rng = np.random.default_rng(11)
    hosts = ["a.org", "example.org", "x.com", "y.com", "HUB.net", *(f"n{i}.net" for i in range(25))]
    rows = []
    for i in range(400):
        host = "HUB.net" if i % 3 == 0 else hosts[int(rng.integers(len(hosts)))]
        path = ["", "/", "/fr/1", "/de/2", "/es/", "/en/1", "/x?y", "#z"][int(rng.integers(8))]
        links = "".join(f'<A class="k" HREF = \'//{hosts[int(rng.integers(len(hosts)))]}/q\'>t</A>' for _ in range(int(rng.integers(4))))
        rows.append((i, None if i % 50 == 7 else f"http://{host}{path}", links))
    cut = lambda url: (lambda m: (m[1].lower(), m[2]) if m else ("", ""))(re.match(r".*?://([^/?#]*)([^?#]*)", url or ""))
    where, by_rule, n = {}, {}, {}
    for i, url, _ in rows:
        host, path = where[i] = cut(url)
        fits = [(len(r), v, r) for v, r in op2_urls.RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
        by_rule[i] = max(fits)[1:] if fits else (None, None)
        n[host] = n.get(host, 0) + 1
    names = sorted(set(n) - {""})
    every = sorted(set(names) | {h.lower() for h in hosts})
    a = np.zeros((len(every), len(every)))
    for i, _, html in rows:
        for to in re.findall(r"//([^/]+)/q", html):
            if where[i][0] and where[i][0] != to.lower():
                a[every.index(where[i][0]), every.index(to.lower())] += 1

    def rank(links, verdict):
        start = np.array([sum(by_rule[i][0] == verdict for i in where if where[i][0] == h) / n[h] if h in names else 0.0 for h in every])
        start /= start.sum()
        x, out = start, links.sum(1)
        for _ in range(op2_urls.ROUNDS):
            moved = op2_urls.DAMPING * ((x / np.maximum(out, 1)) @ links)
            x = moved + (1 - moved.sum()) * start
        return len(names) * x

    trust, distrust = rank(a, "allow"), rank(a.T, "block")
    got = {r.page_id: r for r in op2_urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (host, path) in where.items():
        r, k = got[i], every.index(host) if host else None
        assert (r.host, r.path, r.rule) == (host, path, by_rule[i][1])
        assert (r.trust, r.distrust) == pytest.approx((trust[k], distrust[k]) if host else (0, 0))
        assert r.verdict == (by_rule[i][0] or ("block" if host and distrust[k] - trust[k] > op2_urls.THRESHOLD else "allow"))
