from __future__ import annotations

import random

import pytest

from tessera.llm import warc
from tessera.llm.warc import PERMITTED, canonical_url, resolved_revisits

SCHEMA = "record_id long, url string, at long, type string, headers map<string,string>, payload string"


@pytest.mark.parametrize(("url", "want"), [
    ("https://www.Example.com:443/a/b/?b=2&utm_source=x&a=1#top", "example.com/a/b?a=1&b=2"),
    ("http://u:p@example.com", "example.com"), ("example.com/A/", "example.com/A"), ("https://m.x.org/?ref=1", "m.x.org"),
    ("HTTP://x.org:80/p?", "x.org/p"), ("", None), ("https:///p", None), (None, None),
])
def test_canonical(spark, url, want):
    df = spark.createDataFrame([(url,)], "url string")
    assert df.select(canonical_url(df.url)).head()[0] == want


def low(h):
    return {k.lower(): v for k, v in (h or {}).items()}


def brute(rows):
    out = []
    for i, url, at, kind, headers, _ in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and r[1] == url and url is not None and None not in (at, r[2]) and r[2] < at]
        if not earlier:
            out.append((i, None, "no_response", None, None))
            continue
        r = max(earlier, key=lambda r: (r[2], r[0]))
        a, b, agree = low(headers), low(r[4]), None
        for name in ("etag", "last-modified"):
            if name in a and name in b:
                agree = a[name].removeprefix("W/") == b[name].removeprefix("W/")
                break
        if not agree:
            out.append((i, r[0], "unvalidated" if agree is None else "mismatch", None, None))
            continue
        out.append((i, r[0], "resolved", sorted({**b, **{k: v for k, v in a.items() if k in PERMITTED}}.items()), r[5]))
    return sorted(out)


@pytest.mark.parametrize(("span_rows", "hot"), [(10**6, 10**6), (37, 2)])
def test_against_brute_force(spark, monkeypatch, span_rows, hot):
    """Also with time cut into spans, and with responses that are repeated."""
    monkeypatch.setattr(warc, "SPAN_ROWS", span_rows)
    monkeypatch.setattr(warc, "HOT_REVISITS", hot)
    rng, rows = random.Random(4), []
    for i in range(400):
        headers = {k: v for k, v in (("ETag", rng.choice(["x", "W/x", "y"])), ("Last-Modified", rng.choice("12")), ("Date", str(i)), ("Content-Length", str(i)), ("X-Own", "z")) if rng.random() < 0.6}
        rows.append((i, rng.choice(["a.com/1", "a.com/2", "b.com", None]), rng.choice([None, *range(60)]), rng.choice(["response", "revisit", "request", None]), rng.choice([headers, headers, headers, None]), rng.choice([f"body {i}", "", None])))
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA + ", status string, curl int").repartition(4)
    got = [(r.revisit_id, r.response_id, r.status, None if r.headers is None else [tuple(h) for h in r.headers], r.payload) for r in resolved_revisits(df).collect()]
    assert sorted(got, key=lambda r: r[0]) == brute(rows)
    assert {r[2] for r in got} == {"no_response", "resolved", "unvalidated", "mismatch"}
    assert resolved_revisits(df.limit(0)).count() == 0


def test_repeated_rows_and_long_payloads(spark):
    body = "x" * 2_000_000
    a, b = (1, "a.com", 1, "response", {"ETag": "t"}, body), (2, "http://a.com/", 2, "revisit", {"etag": "t"}, None)
    got = resolved_revisits(spark.createDataFrame([a, a, b, b], SCHEMA)).collect()
    assert [(r.revisit_id, r.status, r.payload == body) for r in got] == [(2, "resolved", True)] * 2
