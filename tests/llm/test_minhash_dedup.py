from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from tessera.llm import textvec as tv
from tessera.llm.minhash_dedup import SIMILAR, dedup_near, multisets, near_groups, overlap, signatures


def both(texts, gram):
    for i, j, raw, offs in tv.chunks(pa.array(texts)):
        own, g, w = multisets(raw, offs, gram)
        e = np.searchsorted(own, np.arange(j - i + 1))
        return own, g, w, [(g[e[k] : e[k + 1]], w[e[k] : e[k + 1]]) for k in range(j - i)]


def test_signatures_are_unbiased():
    rng, off = np.random.default_rng(1), []
    for _ in range(60):
        a = rng.integers(0, int(rng.choice([3, 10, 50])), 200)
        b = np.where(rng.random(200) < rng.random(), rng.integers(0, 50, 200), a)
        own, g, w, sets = both([" ".join(f"w{x}" for x in t) for t in (a, b)], 1)
        s, true = signatures(own, g, w, 2, 2048), overlap(*sets)
        assert np.isfinite(s).all()
        off.append(((s[0] == s[1]).mean() - true) / np.sqrt(true * (1 - true) / 2048 + 1e-9))
    assert abs(np.mean(off)) < 0.4 and 0.6 < np.std(off) < 1.4


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    shared = [word() for _ in range(80)]
    docs, d = {}, 0
    for _ in range(40):
        base = [word() for _ in range(rng.randint(1, 300))] + (shared if rng.random() < 0.4 else [])
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            docs[d] = " ".join(word() if rng.random() < 0.04 else x for x in base)
            d += 1
    return docs


def test_recall_against_all_pairs(spark):
    docs = corpus(random.Random(8))
    sets = both(list(docs.values()), 3)[3]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if overlap(sets[a], sets[b]) >= SIMILAR]
    df = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string").repartition(6)
    rows = near_groups(df).collect()
    group = {r.doc_id: r.group_id for r in rows}
    hit = sum(group.get(a, -1) == group.get(b, -2) for a, b in pairs)
    assert len(pairs) > 200 and hit >= 0.95 * len(pairs)
    linked = {x for p in pairs for x in p}
    assert set(group) <= linked
    assert all(r.keep == (r.doc_id == r.group_id) for r in rows)
    assert {r.doc_id for r in dedup_near(df).collect()} == set(docs) - {r.doc_id for r in rows if not r.keep}


def test_every_pair_of_a_bucket_counts(spark, monkeypatch):
    """With one slot a band, buckets hold documents that aren't alike; the groups are those of all their pairs."""
    import pandas as pd

    import tessera.llm.minhash_dedup as m

    monkeypatch.setattr(m, "BANDS", m.SLOTS)
    monkeypatch.setattr(m, "PARTNERS", 3)
    monkeypatch.setattr(m, "SENT_IDS", 10)
    docs = corpus(random.Random(12))
    sets = both(list(docs.values()), 3)[3]
    df = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string").repartition(3)
    bands: pd.DataFrame = df.mapInArrow(m._signed(m.SLOTS, m.BANDS), "doc_id long, k1 long, k2 long, size long, bands array<long>").selectExpr("explode(bands) AS band", "doc_id").toPandas()
    pairs = {(b, a) for _, x in bands.groupby("band")["doc_id"] for a in x for b in x if b < a}
    of = {d: d for d in docs}
    for a, b in sorted(p for p in pairs if overlap(sets[p[0]], sets[p[1]]) >= SIMILAR):
        low, high = sorted((of[a], of[b]))
        of = {d: low if c == high else c for d, c in of.items()}
    sizes = {c: sum(x == c for x in of.values()) for c in of.values()}
    assert {r.doc_id: r.group_id for r in m.near_groups(df).collect()} == {d: c for d, c in of.items() if sizes[c] > 1}


def test_ids_of_text_and_rows_equal_in_id_and_text(spark):
    docs = corpus(random.Random(3))
    want = {r.doc_id: r.group_id for r in near_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    schema = "doc_id string, text string, extra struct<`content-type`:string>, n int"
    rows = [(f"{d:04}", t, (f"x{d}",), n) for d, t in docs.items() for n in ((2, 1) if d % 7 == 0 else (5,))]
    df = spark.createDataFrame(rows, schema).repartition(4)
    assert {int(r.doc_id): int(r.group_id) for r in near_groups(df).collect()} == want
    for parts in (1, 5):
        kept = dedup_near(df.repartition(parts))
        assert kept.schema == df.schema
        assert {(int(r.doc_id), r.n) for r in kept.collect()} == {(d, 1 if d % 7 == 0 else 5) for d in docs if want.get(d, d) == d}


def test_odd_rows(spark):
    long = " ".join(f"v{i % 7000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (5, "one"), (6, "one two"), (None, "one"), (7, long), (8, long + " x"), (9, "la " * 3000), (10, "la " * 2000), (11, "la " * 900)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, hub int, `_nth_row` string")
    got = {r.doc_id: r.group_id for r in near_groups(df).collect()}
    assert got == {4: 4, 5: 4, 7: 7, 8: 7, 9: 9, 10: 9}
    kept = dedup_near(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9, 11]
    assert near_groups(df.limit(0)).count() == 0 and dedup_near(df.limit(0)).count() == 0
