from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import tessera.llm.mixing as m


def brute(rows, weights=None):
    by = defaultdict(list)
    for d, s, n in rows:
        by[s].append((d, n))
    total = {s: sum(n for _, n in x) for s, x in by.items()}
    w = {s: round(math.sqrt(t) * 1000) if weights is None else round(weights.get(s, 0) * 1e9) for s, t in total.items()}
    out = []
    for s, x in by.items():
        budget = sum(total.values()) * w[s] // sum(w.values()) if sum(w.values()) else 0
        full, rest = divmod(budget, total[s]) if total[s] else (1, 0)
        out += [(d, s, n, e) for d, n in x for e in range(full)]
        key = lambda d: hashlib.md5("|".join([m.SEED, str(full)] + ([] if d is None else [str(d)])).encode()).hexdigest()  # noqa: E731, B023
        used = 0
        for _, _, n, d in sorted((key(d), d is not None and d, n, d) for d, n in x) if rest else []:
            used += n
            if used > rest:
                break
            out.append((d, s, n, full))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), rng.choice([0, 1, 5, 30, 400])) for i in range(700)] + [(None, "a", 3), (9000, "empty", 0), (9001, "one", 7)]
    df = spark.createDataFrame([(d, " x\n" * n if n else rng.choice([None, "", "  "]), s, "q", 1) for d, s, n in rows], "doc_id long, text string, source string, `_key` string, epoch int").repartition(5)
    for ranges, sent, weights in ((50_000, 50_000, None), (20, 50_000, None), (20, 0, None), (20, 50_000, {"a": 1, "one": 2.5})):
        monkeypatch.setattr(m, "RANGE_ROWS", ranges)
        monkeypatch.setattr(m, "SENT_SOURCES", sent)
        assert sorted(((r.doc_id, r.source, r.n_tokens, r.epoch) for r in m.sampled(df, weights).collect()), key=str) == brute(rows, weights)
    out = m.mixed(df)
    assert out.columns == df.columns and out.count() == len(brute(rows))
    assert m.sampled(df.limit(0)).count() == 0 and m.mixed(df.limit(0)).count() == 0


def test_many_epochs_of_a_small_source(spark, monkeypatch):
    """A budget of a thousand times what a source holds, made in blocks."""
    import tessera.llm.spread as spread

    monkeypatch.setattr(spread, "BLOCK", 300)
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s"), (3, "d", "t")], "doc_id long, text string, source string")
    rows = m.sampled(df, {"s": 1, "t": 1}, 6000).collect()
    assert sorted((r.doc_id, r.epoch) for r in rows) == sorted([(d, e) for d in (1, 2) for e in range(1000)] + [(3, e) for e in range(3000)])
    assert m.mixed(df, {"t": 1}, 2_000_000).groupBy("doc_id").count().collect()[0]["count"] == 2_000_000
