from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from tessera.llm import cotraining, hashed, textvec as tv
from tessera.llm.cotraining import PRIOR, REJECT, platt, scored
from tests.llm.test_quality_rules import grams, held_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng, n, labelled):
    """Good and bad texts whose words overlap, in sources and layouts that mostly go with them."""
    common, good, bad = ([f"{c}{i}" for i in range(80)] for c in "cgb")
    docs, labels = [], []
    for d in range(n):
        y = rng.random() < 0.7
        words = [rng.choice(common if rng.random() < 0.7 else good if y else bad) for _ in range(rng.randint(20, 120))]
        text = " ".join(words) if y else "\n".join(w.upper() if rng.random() < 0.3 else w for w in words)
        docs.append((d, text, "en", ("a" if y else "b") if rng.random() < 0.9 else "c", len(text)))
        if d < labelled:
            labels.append((d, int(y), 0))
    return docs, labels, [w for w in docs]


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    docs, labels, _ = corpus(rng, 900, 150)
    df = spark.createDataFrame([(*r, 1, "q") for r in docs], SCHEMA + ", label int, text_score string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in scored(df, lab).collect()}
    true = {d: any(w.lower().startswith("g") for w in t.split()) for d, t, *_ in docs}
    rest = [d for d in got if d >= 150]
    assert len(rest) == 750 and np.mean([got[d].keep == true[d] for d in rest]) > 0.95
    line = min(got[d].p_quality for d in got if got[d].keep)
    assert all(got[d].keep == (got[d].p_quality >= line) for d in got) and all(got[d].p_quality < 0.5 for d in got if not got[d].keep)
    assert np.mean([(got[d].p_text >= 0.5) == true[d] for d in rest]) > 0.9
    assert np.mean([(got[d].p_meta >= 0.5) == true[d] for d in rest]) > 0.9


def test_calibration_against_search():
    rng = np.random.default_rng(1)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(float)
    a, b = platt(s, y, np.ones(400))
    loss = lambda a, b: np.sum(np.log1p(np.exp(-(2 * y - 1) * (a * s + b))))
    least = min(loss(x, z) for x in np.linspace(0, 4, 81) for z in np.linspace(-2, 2, 81))
    assert loss(a, b) <= least + 0.05


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "x y", None, None, None), (3, "x y", None, None, None), (None, "z", "en", "a", 1), (4, "w " * 300_000, "en", "a", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([(1, 1, 0), (3, None, 1), (4, 7, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(((r.doc_id or 0, r.p_quality is None, r.keep) for r in scored(df, lab).collect()))
    assert [g[:2] for g in got] == [(0, False), (1, True), (2, True), (3, False), (3, False), (4, False)]
    assert not any(k for d, _, k in got if d in (1, 2))
    assert scored(df.limit(0), lab).count() == 0 and scored(df, lab.limit(0)).count() == 6


def fitted(rows):
    """Slope and shift of the logistic curve through (score, label) rows, by Newton steps in two numbers."""
    scale = math.sqrt(sum(s * s for s, _ in rows) / len(rows)) or 1.0
    a = b = 0.0
    for _ in range(200):
        ga, gb, haa, hab, hbb = 1e-3 * a, 1e-3 * b, 1e-3, 0.0, 1e-3
        for s, y in rows:
            x = s / scale
            p = 1 / (1 + math.exp(-max(-30, min(30, a * x + b))))
            w = p * (1 - p)
            ga, gb, haa, hab, hbb = ga + (p - y) * x, gb + p - y, haa + w * x * x, hab + w * x, hbb + w
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        cut = min(1.0, 4 / max(1e-12, abs(da), abs(db)))
        a, b = a - cut * da, b - cut * db
    return max(a, 0.0) / scale, b


def brute(docs, labels, held, keys):
    """{doc_id: (p_text, p_meta, p_quality, keep)}, counted and fitted document by document."""
    size = lambda x: math.floor(2 * math.log2(x + 1))
    number = lambda c, k: int(tv.key_hash(np.array([c], np.int64), 100 + k)[0]) >> 52

    def meta(d, t, n_chars):
        lines, octets = t.count("\n") + 1, len(t.encode())
        return [number(c, k) for k, c in enumerate([*keys[d], size(n_chars), size(lines), size(octets / lines)])]

    seen = {d: (grams(t), meta(d, t, n)) for d, t, _, _, n in docs}
    label = {d: q for d, q, _ in labels}
    base = ([Counter(), Counter()], [Counter(), Counter()])
    for d, y in label.items():
        if d not in held:
            base[0][y].update(seen[d][0])
            base[1][y].update(seen[d][1])
    counts = base
    for r in range(3):
        odds = []
        for v, n in ((0, 1 << hashed.BITS), (1, 4096)):
            t = [sum(c.values()) + n for c in counts[v]]
            weight = lambda x: math.log((counts[v][1][x] + 1) / t[1]) - math.log((counts[v][0][x] + 1) / t[0])  # noqa: E731, B023
            score = {d: sum(map(weight, s[v])) / ((len(s[0]) + PRIOR) if v == 0 else 1) for d, s in seen.items()}
            rows = [(math.floor(abs(score[d]) * 100 + 0.5) / 100 * (1 if score[d] >= 0 else -1), y) for d, y in label.items() if d in held]
            a, b = fitted(rows)
            odds.append({d: a * s + b for d, s in score.items()})
        good = sum(y for _, y in rows)
        prior = math.log(good / (len(rows) - good))
        if r < 2:
            line = math.log(0.95 / 0.05)
            counts = tuple([c.copy() for c in base[v]] for v in (0, 1))
            for d in seen:
                if d not in label:
                    for v in (0, 1):
                        if abs(odds[v][d]) >= line:
                            counts[1 - v][int(odds[v][d] > 0)].update(seen[d][1 - v])
    p = lambda x: round(1 / (1 + math.exp(-x)), 6)
    quality = {d: p(odds[0][d] + odds[1][d] - prior) for d in seen}
    bins = Counter(math.floor(quality[d] / 1e-4) for d, y in label.items() if d in held and y)
    below, line = 0, 0.0
    for k in sorted(bins):
        if below <= REJECT * sum(bins.values()):
            line = k * 1e-4
        below += bins[k]
    return {d: (p(odds[0][d]), p(odds[1][d]), quality[d]) for d in seen}, min(0.5, line)


def test_whole_query_against_brute_force(spark):
    rng = random.Random(11)
    docs, labels, _ = corpus(rng, 400, 200)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = held_of(spark, range(400))
    keys = {r[0]: (r[1], r[2]) for r in df.select("doc_id", F.xxhash64("lang"), F.xxhash64("source")).collect()}
    want, line = brute(docs, labels, held, keys)
    got = {r.doc_id: r for r in scored(df, lab).collect()}
    for d, w in want.items():
        assert all(abs(x - y) < 2e-3 for x, y in zip(w, (got[d].p_text, got[d].p_meta, got[d].p_quality))), (d, w, got[d])
        assert got[d].keep == (w[2] >= line) or abs(w[2] - line) < 2e-3
    assert 40 < sum(not got[d].keep for d in got) < 250


def test_documents_held_out_and_labelled_get_no_pseudo_labels(spark, monkeypatch):
    rng = random.Random(5)
    docs, labels, _ = corpus(rng, 200, 120)
    seen = []
    count = cotraining._count_confident
    monkeypatch.setattr(hashed, "unlabelled", lambda plain, marks, f=hashed.unlabelled: seen.append({r[0] for r in f(plain, marks).select("doc_id").collect()}) or f(plain, marks))
    assert count is cotraining._count_confident
    scored(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert seen == [set(range(120, 200))]


def test_ids_of_text_and_ties(spark):
    rng = random.Random(4)
    docs, labels, _ = corpus(rng, 200, 120)
    df = spark.createDataFrame([(f"d{r[0]}", *r[1:]) for r in docs] + [("same", *docs[7][1:]), ("same", *docs[7][1:])], SCHEMA.replace("doc_id long", "doc_id string"))
    rows = scored(df, spark.createDataFrame([(f"d{d}", q, t) for d, q, t in labels], "doc_id string, quality int, toxic int")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert len(rows) == 202 and got["same"] == [got["d7"][0]] * 2
