from __future__ import annotations

import math
import random
from collections import Counter

from tessera.llm import hashed
from tessera.llm.quality_rules import PRIOR, REJECT, filtered, scored

M, R = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def grams(text) -> list[int]:
    """Buckets of the words and pairs of words of a text, number by number."""
    h = [mix(sum((b + 1) * pow(R, i, 1 << 64) for i, b in enumerate(w.encode())) & M) for w in (text or "").encode().decode().split()]
    return [mix(x) >> 64 - hashed.BITS for x in h] + [mix((x + y * R) & M) >> 64 - hashed.BITS for x, y in zip(h, h[1:])]


def brute(docs, labels, held) -> dict:
    """{doc_id: (score, keep)}; held: the ids that a fifth of the documents has by hash."""
    good = {d for d, q, t in labels if q == 1 and (t or 0) == 0}
    raw, trusted = Counter(), Counter()
    for d, t in docs:
        g = grams(t)
        raw.update(g)
        if d in good and d not in held:
            trusted.update(g)
    n = hashed.BUCKETS
    a, b = sum(trusted.values()) + n, sum(raw.values()) + n
    ratio = lambda x: math.log((trusted[x] + 1) / a) - math.log((raw[x] + 1) / b) if trusted else 0.0
    score = {(d, t): sum(map(ratio, g)) / (len(g) + PRIOR) if (g := grams(t)) else None for d, t in docs}
    of_held = sorted(s for (d, _), s in score.items() if s is not None and d in good and d in held)
    line = 0.0
    if of_held:
        bins = Counter(math.floor(s / 1e-4) for s in of_held)
        below = 0
        for k in sorted(bins):
            if below <= REJECT * len(of_held):
                line = k * 1e-4
            below += bins[k]
    line = min(0.0, line)
    return {k: (s, s is not None and s >= line) for k, s in score.items()}


def held_of(spark, ids) -> set:
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return {r[0] for r in df.filter(hashed.holdout(df.doc_id)).collect()}


def test_against_brute_force(spark):
    rng = random.Random(6)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    docs, labels = [], []
    for d in range(150):
        kind = d % 3
        docs.append((d, " ".join(rng.choice(bad if kind == 2 else good) for _ in range(rng.randint(1, 200)))))
        if d < 100:
            labels.append((d, int(kind != 2), 0))
    docs += [(200, None), (201, "")]
    df, lab = spark.createDataFrame([(*r, 3, "q") for r in docs], "doc_id long, text string, label_id int, _score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels, held_of(spark, range(202)))
    got = {r.doc_id: r for r in scored(df, lab).collect()}
    assert len(got) == 152
    for (d, _), (s, keep) in want.items():
        assert got[d].keep == keep and (got[d].score is None if s is None else abs(got[d].score - s) < 1e-8)
    kept = filtered(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for (d, _), (_, k) in want.items() if k}
    assert sum(not k for _, k in want.values()) > 20


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, "w " * 300_000), (3, " \n")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, None, None), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(((r.doc_id or 0, r.score, r.keep) for r in scored(df, lab).collect()), key=str) == sorted([(1, 0.0, True), (1, 0.0, True), (0, 0.0, True), (2, 0.0, True), (3, None, False)], key=str)
    assert scored(df.limit(0), lab).count() == 0 and filtered(df, lab.limit(0)).count() == 4


def test_buckets_grow_with_the_corpus(spark, monkeypatch):
    """The load of a bucket stays between half of LOAD and LOAD, and scores are those of so many buckets."""
    rng = random.Random(8)
    docs = [(d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(4000))) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(hashed, "LOAD", 4)
    bits = hashed.bits(df)
    distinct = len({g for _, t in docs for w in [t.split()] for g in [*w, *zip(w, w[1:])]})
    assert bits == 17 and 1.9 < distinct / (1 << bits) < 4.1
    assert hashed.bits(df.limit(1)) == hashed.bits(df.limit(0)) == hashed.BITS
    lab = spark.createDataFrame([(d, d % 2, 0) for d in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.score, r.keep) for r in scored(df, lab).collect()}
    monkeypatch.setattr(hashed, "BITS", 17)
    monkeypatch.setattr(hashed, "BUCKETS", 1 << 17)
    for (d, _), (s, keep) in brute(docs[:], [(d, d % 2, 0) for d in range(60)], held_of(spark, range(60))).items():
        assert abs(got[d][0] - s) < 1e-8 and got[d][1] == keep


def test_ids_of_text_and_columns_of_any_type(spark):
    docs = [(f"d{i}", " ".join(f"w{(i * k) % 23}" for k in range(40)), (f"x{i}",)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id string, text string, extra struct<`content-type`:string>")
    lab = spark.createDataFrame([(f"d{i}", int(i % 3 > 0), 0) for i in range(40)], "doc_id string, quality int, toxic int")
    got = {r.doc_id: r.keep for r in scored(df, lab).collect()}
    kept = filtered(df, lab)
    assert kept.schema == df.schema and len(got) == 60
    assert {r.doc_id: r.extra[0] for r in kept.collect()} == {d: f"x{d[1:]}" for d, k in got.items() if k}
    assert scored(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 60
