from __future__ import annotations

import html
import math
import random
import re
import time
from collections import Counter
from itertools import product

from tessera.llm import html_cut as h
from tessera.llm.html_cut import _max_flow, blocks, cut_labels, extracted


def test_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 9)
        u = [rng.randint(-6, 6) for _ in range(n)]
        links = [(a, b, rng.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def cost(side):
            return sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(u, side)) + sum(c for a, b, c in links if side[a] != side[b])

        every = list(product([False, True], repeat=n))
        least = min(map(cost, every))
        smallest = [all(s[k] for s in every if cost(s) == least) for k in range(n)]
        assert cut_labels(u, links) == smallest == _max_flow(u, links)


def test_blocks():
    page = "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=x>One</a><li>Two</ul></nav><!-- <p>no --><div class='side ad'>Buy</div><article><p>A <b>b</b> &amp; c<br>d<p>e<script>var t='</p>'</script> f</article>tail <unclosed"
    assert [(b.text, b.tag, b.role) for b in blocks(page)] == [("One", "li", -1), ("Two", "li", -1), ("Buy", "div", -1), ("A b & c d", "p", 1), ("e f", "p", 1), ("tail <unclosed", "body", 0)]
    assert blocks("") == [] and [b.text for b in blocks("plain < text")] == ["plain < text"]
    assert len(blocks("<div>x" * 5000 + "</span></div>" * 9000)) == 5000


def test_no_text_is_lost_or_leaks():
    said = lambda page: [b.text for b in blocks(page)]
    assert said('<p>before</p><svg class="i"/><p>after') == ["before", "after"]
    assert said("<title-bar>hi</title-bar><p>after</p>") == ["hi", "after"]
    assert said('<a title="a > b" href=x>text</a> more') == ["text more"]
    assert said("<svg><title>n</title></svg>k<TITLE>t</title >") == ["k"]
    assert said("<p>a</p><title>b<p>c<noscript>d") == ["a", "b", "cd"]
    assert said("a<script src='x'>if (a > b) {}</scripts></script>b<style>p") == ["ab"]
    assert said('x <a title="q>y</a> z') == ["x y z"] and said("a < b <3 c </") == ["a < b <3 c </"]


def test_broken_markup_takes_linear_time():
    began = time.process_time()
    for page in ("<a" * 500_000, "<a<" * 300_000 + ">", '<a x=">" ' * 100_000, "<svg>" * 200_000, "<a x='" * 150_001 + ">", "<p><div>" + "<b><div/>" * 100_000, "<!" * 300_000, f"<div {'class=' * 150_000}>x"):
        blocks(page)
    assert time.process_time() - began < 20


def brute(pages, picked):
    """(text, blocks, content blocks) of each page: counts, costs and cuts one by one, the cuts by augmenting paths."""
    found = {i: blocks(p or "") for i, p in pages}
    count = {(k, c, y): 1 for k in range(h.FEATURES) for c in range(h.CLASSES) for y in (1, -1)}
    seen = {1: 0, -1: 0}
    for i in picked:
        for b, x in zip(found[i], h.features(found[i]).tolist()):
            if b.role:
                seen[b.role] += 1
                for k, c in enumerate(x):
                    count[k, c, b.role] += 1
    odds = lambda x: sum(math.log(count[k, c, 1] / (seen[1] + h.CLASSES)) - math.log(count[k, c, -1] / (seen[-1] + h.CLASSES)) for k, c in enumerate(x)) * h.SHARPNESS if all(seen.values()) else 0.5
    out = {}
    for i, _ in pages:
        page, room = found[i], Counter()
        for k, (b, x) in enumerate(zip(page, h.features(page).tolist())):
            u = round(h.SCALE * (odds(x) + h.ROLE * b.role))
            room[("s", k) if u > 0 else (k, "t")] += abs(u)
        for a, b, c in h.edges(page):
            room[a, b] += c
            room[b, a] += c
        next_to = {}
        for a, b in list(room):
            next_to.setdefault(a, set()).add(b)
            next_to.setdefault(b, set()).add(a)
        while True:
            came, todo = {"s": None}, ["s"]
            for v in todo:
                for w in next_to.get(v, ()):
                    if w not in came and room[v, w] > 0:
                        came[w] = v
                        todo.append(w)
            if "t" not in came:
                break
            path, v = [], "t"
            while came[v] is not None:
                path.append((came[v], v))
                v = came[v]
            push = min(room[e] for e in path)
            for a, b in path:
                room[a, b] -= push
                room[b, a] += push
        kept = [b.text for k, b in enumerate(page) if k in came]
        out[i] = ("\n".join(kept), len(page), len(kept))
    return out


def test_whole_query_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    for df, sample in ((pages, h.SAMPLE), (pages.selectExpr("page_id", "replace(html, 'article', 'div') AS html"), h.SAMPLE), (pages, 60)):
        rows = [(r.page_id, r.html) for r in df.collect()]
        part = int(min(1.0, sample / len(rows)) * (1 << 20)) + 1
        picked = [r[0] for r in df.filter(f"pmod(xxhash64(page_id, html), 1048576L) < {part}").select("page_id").collect()]
        assert (len(picked) < len(rows)) == (sample == 60)
        assert {r.page_id: (r.text, r.n_blocks, r.n_content) for r in extracted(df, sample).collect()} == brute(rows, picked)


def plain(x):
    return Counter(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())


def test_against_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: plain(re.search(r"<article>(.*?)</article>", r.html, re.S)[1]) for r in pages.collect()}
    for df in (pages, pages.selectExpr("page_id", "CASE WHEN page_id % 3 = 0 THEN regexp_replace(regexp_replace(html, '<(/?)(article|nav|footer)', '<$1div'), 'class=\"ad\"', '') ELSE html END AS html")):
        hit = said = true = 0
        for r in extracted(df).collect():
            if df is pages or r.page_id % 3 == 0:
                got, want = Counter(r.text.split()), truth[r.page_id]
                hit, said, true = hit + sum((got & want).values()), said + sum(got.values()), true + sum(want.values())
        assert hit / said > 0.95 and hit / true > 0.95, (hit / said, hit / true)


def test_odd_rows(spark):
    long = "<p>" + "word, " * 400_000 + "</p>"
    many = "".join(f"<li><a href=#>{i}</a></li><p>some longer text here, with words.</p>" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "<p></p><!-- x"), (None, "<p>one two three.</p>"), (4, long), (4, long), (5, many), (6, "no markup at all")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, html string, text string, n_blocks int")
    got = sorted(((r.page_id or 0, r.n_blocks, len(r.text.split())) for r in extracted(df).collect()))
    assert got == [(0, 1, 3), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 400_000), (4, 1, 400_000), (5, 40_000, 140_000), (6, 1, 4)]
    assert extracted(df.limit(0)).count() == 0
