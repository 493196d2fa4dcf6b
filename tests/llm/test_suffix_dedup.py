from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm.suffix_dedup import dedup_passages, permuted_prefixes, repeated_passages, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(docs: dict, length: int) -> dict:
    first, gone = {}, {}
    for d in sorted(docs):
        w = docs[d].split()
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in first:
                gone.setdefault(first[key], set())
                gone.setdefault(d, set()).update(range(i, i + length))
            else:
                first[key] = d
    return {d: [x for i, x in enumerate(docs[d].split()) if i not in g] for d, g in gone.items()}


@pytest.mark.parametrize("symbols", [1, 2, 4, 30])
def test_suffix_array_and_prefixes(symbols):
    rng = random.Random(symbols)
    for _ in range(150):
        t = [rng.randrange(symbols) for _ in range(rng.randint(1, 70))]
        order = suffix_array(np.array(t))
        assert list(order) == sorted(range(len(t)), key=lambda i: t[i:])
        common = permuted_prefixes(np.array(t), order)
        for a, b in zip(order, order[1:]):
            same = 0
            while max(a, b) + same < len(t) and t[a + same] == t[b + same]:
                same += 1
            assert common[b] == same


def corpus(rng) -> dict:
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 90, 300)]
    docs = {}
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += [word() for _ in range(rng.randint(0, 60))]
            if rng.random() < 0.6:
                parts += rng.choice(shared)
        docs[d] = rng.choice([" ", "\n", "  "]).join(parts)
    docs[60] = "la " * 200
    docs[61] = docs[3]
    return docs


def test_against_brute_force(spark):
    docs = corpus(random.Random(5))
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs.items()], SCHEMA).repartition(5)
    want = brute(docs, 50)
    got = {r.doc_id: r.text.split() for r in repeated_passages(df).collect()}
    assert got == want and len(got) > 20
    clean = {r.doc_id: r.text for r in dedup_passages(df).collect()}
    assert clean == {d: t if d not in want or len(want[d]) == len(t.split()) else clean[d] for d, t in docs.items() if d not in want or want[d]}
    assert all(clean[d].split() == want[d] for d in want if want[d])


def test_anchors_that_too_many_places_share(spark, monkeypatch):
    """Their passages are found without gathering them, also where the anchors are too many for one list."""
    import tessera.llm.suffix_dedup as m

    docs = corpus(random.Random(9))
    df = spark.createDataFrame([(d, t) for d, t in docs.items()], "doc_id long, text string").repartition(3)
    for hot, sent in ((3, 1000), (1, 7)):
        monkeypatch.setattr(m.spans, "__defaults__", (50, hot, sent))
        assert {r.doc_id: r.text.split() for r in repeated_passages(df).collect()} == brute(docs, 50)


def test_ids_of_text_and_columns_of_any_type(spark):
    docs = corpus(random.Random(3))
    schema = "doc_id string, text string, extra struct<`content-type`:string,`a b`:array<int>>, n_chars int"
    df = spark.createDataFrame([(f"é{d:03}", t, (f"x{d}", [d]), len(t)) for d, t in docs.items()], schema).repartition(3)
    want = {f"é{d:03}": x for d, x in brute(docs, 50).items()}
    assert {r.doc_id: r.text.split() for r in repeated_passages(df).collect()} == want
    kept = dedup_passages(df)
    assert kept.schema == df.schema
    assert all(r.extra == (f"x{int(r.doc_id[1:])}", [int(r.doc_id[1:])]) and r.text.split() == want.get(r.doc_id, docs[int(r.doc_id[1:])].split()) for r in kept.collect())


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n", "en", "a", 4), (None, passage, "en", "a", 1), (4, passage, None, "a", 1), (4, passage, None, "a", 1), (4, "other " + passage, None, "b", 1), (5, long, "en", "a", 1), (6, "x " + long, "en", "a", 1)]
    df = spark.createDataFrame([(*r, "q", 7) for r in rows], SCHEMA + ", spans string, `_clean` int")
    got = sorted(((r.doc_id, r.n_kept, r.n_removed) for r in repeated_passages(df).collect()), key=str)
    assert got == [(4, 0, 60), (4, 0, 60), (4, 1, 60), (5, 60_000, 0), (6, 1, 60_000), (None, 60, 0)]
    kept = dedup_passages(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "-")[:6]) for r in kept.collect()) == [(0, "w0 w1 "), (1, "-"), (2, "-"), (3, "   \n"), (4, "other "), (5, "v0 v1 "), (6, "x ")]
    assert repeated_passages(df.limit(0)).count() == 0 and dedup_passages(df.limit(0)).count() == 0
