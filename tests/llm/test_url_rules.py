from __future__ import annotations

import random
import time
from itertools import combinations

from tessera.llm.url_rules import GROUP_ROWS, judged, mined, tokens

PAGES, LABELS = "page_id long, url string, html string", "doc_id long, quality int, toxic int"


def brute(toks, bad, least, confidence):
    """Rules by counting every combination of the tokens of bad pages."""
    of = {}
    for i, t in toks.items():
        for x in t:
            of[x] = of.get(x, 0) | 1 << i
    ill, sure = sum(1 << i for i in bad), {}
    for c in {c for i in bad for k in range(1, len(toks[i]) + 1) for c in combinations(sorted(toks[i]), k)}:
        s = of[c[0]]
        for x in c[1:]:
            s &= of[x]
        n, all_ = (s & ill).bit_count(), s.bit_count()
        if n >= least and n / all_ >= confidence:
            sure[c] = (n / all_, n)
    return sure


def test_tokens(spark):
    df = spark.createDataFrame([("http://u@Spam-Farm.example.com:80/en/728.html?a=1&b#x",), (None,), ("",), ("://",)], "url string")
    got = [r[0] for r in df.select(tokens(df.url)).collect()]
    assert got[0] == sorted(["host:spam-farm.example.com", "h:spam-farm", "h:spam", "h:farm", "h:example", "h:com", "p:en", "p:#", "p:html", "q:a", "q:a=1", "q:b", "#"])
    assert got[1] == got[2] == []


def test_against_brute_force(spark):
    rng, pages, labels = random.Random(3), [], []
    for i in range(260):
        host = rng.choice(["good.org", "spam-farm.net", "blog.org", "casino.net"])
        url = f"https://{host}/{rng.choice(['en', 'fr', 'x'])}/{rng.choice(['', '7', 'win'])}{rng.choice(['', '?ref=1', '?page=2', '#top'])}"
        pages.append((i, url, None))
        if i < 160:
            worse = ("spam" in host) + ("win" in url) + ("ref" in url)
            labels.append((i, int(rng.random() > 0.1 + 0.35 * worse), rng.choice([0, 0, None])))
    pages += [(i + 1000, None if i else "", "h") for i in range(3)]
    p, lab = spark.createDataFrame([(*r, 1, "q") for r in pages], PAGES + ", tokens int, rule string"), spark.createDataFrame(labels, LABELS)
    got = {r.page_id: r for r in judged(p, lab, 0.02, 4, 0.8).collect()}
    toks = {r.page_id: set(r.t) for r in p.select("page_id", tokens(p.url).alias("t")).collect()}
    known = {i: toks[i] for i, _, _ in labels}
    bad = {i for i, q, _ in labels if q == 0}
    sure = brute(known, bad, max(4, 0.02 * len(bad)), 0.8)
    assert sure
    dropped, closures = 0, _closures(sure, known)
    for i, t in toks.items():
        held = [v for c, v in sure.items() if closures[c] <= t]
        assert got[i].keep == (not held), i
        if held:
            dropped += 1
            assert abs(got[i].confidence - max(v[0] for v in held)) < 1e-6
    assert 10 < dropped < 250
    assert all(got[i].keep and got[i].n_rules == 0 for i in (1000, 1001, 1002))


def _closures(rules, known):
    """Of each rule, its tokens less those of every labelled page, with those that occur in the same labelled pages as one of them."""
    of = {}
    for i, t in known.items():
        for x in t:
            of.setdefault(x, set()).add(i)
    alike = {x: {y for y in of if of[y] == of[x]} for x in of}
    return {c: set().union(*(alike[x] for x in c if len(of[x]) < len(known))) for c in rules}


def test_odd_rows(spark):
    long = "http://spam.net/" + "/".join(f"w{i}" for i in range(3000))
    rows = [(1, long)] * 6 + [(2, "http://ok.org/a"), (3, "http://ok.org/b"), (None, "http://ok.org/c"), (4, long + "/more")]
    p = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame([(1, 0, 0), (1, 1, None), (2, 1, 0), (3, None, None), (None, 0, 1), (99, 0, 1)], LABELS)
    got = [(r.page_id, r.n_rules, r.keep) for r in judged(p, lab).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, False)] * 6 + [(2, 0, True), (3, 0, True), (None, 0, True), (4, 1, False)], key=str)
    assert judged(p.limit(0), lab).count() == 0
    assert all(r.keep for r in judged(p, lab.limit(0)).collect())


def test_each_of_tokens_that_labelled_pages_share(spark):
    """Rules by brute force, whose tokens need not all be there: one of those that go together is enough."""
    urls = [f"http://spam.net/win/{i}" for i in range(5)] + [f"http://good.org/a/{c}" for c in "bcdefgh"]
    more = ["http://spam.net/lose", "http://other.com/win", "http://good.org/win", "http://fine.com/a/b", "http://other.com/9"]
    p = spark.createDataFrame(list(enumerate(urls + more)), "page_id long, url string")
    got = {r.page_id: r for r in judged(p, spark.createDataFrame([(i, int(i >= 5), 0) for i in range(12)], LABELS)).collect()}
    toks = {r.page_id: set(r.t) for r in p.select("page_id", tokens(p.url).alias("t")).collect()}
    sure = brute({i: toks[i] for i in range(12)}, set(range(5)), 5, 0.6)
    for i, t in toks.items():
        assert got[i].keep == (not any(set(c) <= t for c in sure)), urls + more
    assert [got[i].keep for i in range(12, 17)] == [False, False, False, True, False] and got[0].n_rules == got[12].n_rules == 1
    assert got[13].rule == "p:win"
    every = spark.createDataFrame([(i, f"http://x.net/{'abcdefgh'[i]}") for i in range(8)] + [(9, "http://x.net/z")], "page_id long, url string")
    assert not any(r.keep for r in judged(every, spark.createDataFrame([(i, int(i == 0), 0) for i in range(8)], LABELS)).collect())


def test_long_urls_nearly_alike_take_little_time(spark):
    rng = random.Random(1)
    url = lambda: "http://spam.net/" + "/".join(f"w{k}" if rng.random() < 0.9 else f"x{rng.randrange(999)}" for k in range(40))
    p = spark.createDataFrame([(i, url()) for i in range(240)] + [(900, "http://fine.org/a"), (901, "http://fine.org/w3")], "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.keep for r in judged(p, spark.createDataFrame([(i, 0, 0) for i in range(200)] + [(900, 1, 0)], LABELS)).collect()}
    assert time.time() - began < 90
    assert got == {i: i == 900 for i in got}


def test_dissimilar_long_urls_against_brute_force(spark):
    """Rules of one or two tokens are all found, whatever the length of a URL; longer ones are true rules."""
    rng, urls = random.Random(6), []
    pool = [f"w{k}" for k in range(30)]
    for i in range(160):
        words = rng.sample(pool, 14)
        urls.append((f"http://x.net/{'/'.join(words)}", int(not ({"w1", "w2"} <= set(words) or {"w3", "w4", "w5"} <= set(words) or rng.random() < 0.2))))
    p = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in judged(p, spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(urls)], LABELS), 0.0, 8, 0.9).collect()}
    toks = {r.page_id: set(r.t) for r in p.select("page_id", tokens(p.url).alias("t")).collect()}
    bad = {i for i, (_, q) in enumerate(urls) if not q}
    hold = lambda c: {i for i in toks if set(c) <= toks[i]}
    every = sorted(set.union(*toks.values()))
    sure = {}
    for c in (c for k in (1, 2) for c in combinations(every, k)):
        s = hold(c)
        if len(s & bad) >= 8 and len(s & bad) >= 0.9 * len(s):
            sure[c] = len(s & bad) / len(s)
    assert sure
    for i, t in toks.items():
        best = max((v for c, v in sure.items() if set(c) <= t), default=None)
        assert best is None or not got[i].keep and got[i].confidence >= round(best, 9)
        if not got[i].keep:
            s = hold(got[i].rule.split(" + "))
            assert i in s and len(s & bad) >= 8 and abs(len(s & bad) / len(s) - got[i].confidence) < 1e-6 and got[i].confidence >= 0.9


def test_long_rules_of_wide_urls_against_brute_force(spark):
    """All rules of any length, in URLs of more items than eight that good pages have too; the same where tables are split."""
    rng, pool = random.Random(9), [f"w{k}" for k in range(13)]
    urls = []
    for i in range(120):
        words = set(rng.sample(pool, 11)) - ({rng.choice(["w9", "w10", "w11", "w12"])} if i % 3 else set())
        urls.append((f"http://x.net/{'/'.join(sorted(words))}", int(not ({"w9", "w10", "w11", "w12"} <= words or rng.random() < 0.15))))
    p = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    toks = {r.page_id: set(r.t) for r in p.select("page_id", tokens(p.url).alias("t")).collect()}
    bad = {i for i, (_, q) in enumerate(urls) if not q}
    sure = brute(toks, bad, 5, 0.8)
    want = {c: v for c, v in sure.items() if not any(sure.get(d, (0, 0))[0] >= v[0] for k in range(1, len(c)) for d in combinations(c, k))}
    assert max(map(len, want)) > 3
    labelled = spark.createDataFrame([(sorted(t), i in bad) for i, t in toks.items()], "tokens array<string>, bad boolean")
    for rows in (GROUP_ROWS, 20):
        rules, member, _ = mined(labelled, 0.0, 5, 0.8, rows)
        alike = {}
        for m in member.collect():
            alike.setdefault(m.name, []).append(m.token)
        assert all(len(v) == 1 for v in alike.values())
        assert {tuple(r.rule): (r.confidence, r.n_bad) for r in rules.collect()} == want
