from __future__ import annotations

from collections import Counter

import corpus_pipeline
from tessera.llm.minhash_dedup import SIMILAR, overlap
from tessera.llm.subwords import decoded
from tests.llm.test_minhash_dedup import both
from tests.llm.test_mixing import brute as mixing_brute
from tests.llm.test_quality_rules import brute as quality_brute, held_of
from tests.llm.test_suffix_dedup import brute as passages_brute

FOLDER = "/root/testdata/sf0.001"


def components(ids, pairs) -> dict:
    of = {i: i for i in ids}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {i: find(i) for i in ids}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(stage(spark, outs[-1], FOLDER).cache())
    assert len(corpus_pipeline.STAGES) == 5 and all(o.columns == docs.columns for o in outs[:-1])
    rows = [[(r.doc_id, r.text, r.source) for r in o.collect()] for o in outs[:-1]]
    judged = quality_brute([r[:2] for r in rows[0]], labels, held_of(spark, [r[0] for r in rows[0]]))
    assert {r[0] for r in rows[1]} == {d for (d, _), (_, keep) in judged.items() if keep}
    own, g, w, sets = both([t for _, t, _ in rows[1]], 3)
    ids = [d for d, _, _ in rows[1]]
    near = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if len(sets[a][0]) and len(sets[b][0]) and overlap(sets[a], sets[b]) >= SIMILAR]
    assert near and {r[0] for r in rows[2]} == {i for i, c in components(ids, near).items() if i == c}
    texts = {d: t for d, t, _ in rows[2]}
    shorter = passages_brute(texts, 50)
    want = {d: shorter.get(d, t.split()) for d, t in texts.items()}
    assert {d: t.split() for d, t, _ in rows[3]} == {d: x for d, x in want.items() if x or not texts[d].split()}
    tokens = [(d, s, len(t.split())) for d, t, s in rows[3]]
    assert Counter(r[0] for r in rows[4]) == Counter(r[0] for r in mixing_brute(tokens))
    taken = Counter((r[0], r[1]) for r in rows[4])
    spelt = Counter((r.doc_id, r.text) for r in decoded(outs[5].filter("sample = 0")).collect())
    assert spelt == taken
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "sample", "perturbed").collect())) == sorted((r.doc_id, r["sample"], r.perturbed) for r in outs[5].collect())


def test_odd_rows_in_every_stage(spark, tmp_path):
    """Nulls, empty, long and repeated texts, and extra columns by the names that operators use, whose values stay."""
    names = ["_drop_id", "_nth_row", "_score", "_c0", "x0", "_src", "_span_id", "spans", "group", "label_id", "band", "_text", "pieces"]
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    texts = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", None, "a"), (None, "one two three four", "en", None), (4, long, "en", "a"), (4, long, "en", "a"), (5, long + " z", None, None), (6, "plain words here", "en", "b"), (7, "plain words there", "en", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*t, None, *(f"{n}!" for n in names)) for t in texts], schema)
    labels = spark.createDataFrame([(6, 1, 0), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, str(tmp_path))
            assert out.columns == docs.columns, name
            rows = out.collect()
            assert all(r[n] == f"{n}!" for r in rows for n in names), name
            assert bool(rows) == (df is docs), name
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 6, 7, None}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
