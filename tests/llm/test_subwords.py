from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import textvec as tv
from tessera.llm.subwords import SEED, Trie, Vocabulary, _inclusion, decoded, sample, sampled

V = Vocabulary()


def segmentations(text):
    """All tilings, each with its probability."""
    s, ids, out = (b" " + text.encode() if text else b""), {}, []
    for i in V.normal:
        ids.setdefault(V.pieces[i], i)

    def go(p, path, log):
        if p == len(s):
            out.append((tuple(path), log))
            return
        w = 1
        while p + w < len(s) and s[p + w] & 0xC0 == 0x80:
            w += 1
        if s[p : p + w] not in ids:
            go(p + w, path + [V.bytes_at + b for b in s[p : p + w]], log + w * V.byte_log)
        for q in range(p + 1, min(len(s), p + 48) + 1):
            if s[p:q] in ids:
                go(q, path + [ids[s[p:q]]], log + V.logs[ids[s[p:q]]])

    go(0, [], 0.0)
    z = np.logaddexp.reduce([x for _, x in out])
    return {a: x - z for a, x in out}


def test_samples_follow_the_lattice():
    texts, trie, runs = ["ab", "the é☃", " \nx", "", "ing", "zq", "a    b"], Trie.of(V), 1200
    every = [segmentations(t) for t in texts]
    first, weight = [Counter() for _ in texts], [Counter() for _ in texts]
    (_, _, raw, offs), = tv.chunks(pa.array(texts))
    for r in range(runs):
        keys = tv.key_hash(np.arange(len(texts)) + 100 * r, SEED)
        for d, (found, left) in enumerate(sample(trie, V.bytes_at, raw, offs, keys, 3)):
            paths = [tuple(x[0].tolist()) for x in found]
            assert len(set(paths)) == len(paths) == min(3, len(every[d]))
            assert all(abs(x[1] - every[d][p]) < 1e-9 for x, p in zip(found, paths))
            values = [x[2] for x in found] + [left]
            assert values == sorted(values, reverse=True)
            first[d][paths[0]] += 1
            for x, p in zip(found, paths):
                weight[d][p] += 1 if left == -np.inf else np.exp(-_inclusion(x[1], left))
    for d, table in enumerate(every):
        for path, log in table.items():
            p = np.exp(log)
            assert abs(first[d][path] / runs - p) < 4 * np.sqrt(p * (1 - p) / runs) + 1e-3
            if p > 0.05:
                assert abs(weight[d][path] / runs - 1) < 0.15


def test_round_trip_and_odd_rows(spark):
    long = "Ünï ☃ x\n\n  tab\tend " * 3000
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "hello world"), (5, "hello ▁ world \n"), (6, "x" * 5000), (7, long)]
    df = spark.createDataFrame([(*r, [1], "q") for r in rows], "doc_id long, text string, pieces array<int>, sample string").repartition(3)
    got = sampled(df)
    assert got.columns == ["doc_id", "sample", "log_prob", "perturbed", "log_inclusion", "pieces", "decodes"]
    assert all(r.decodes for r in got.collect())
    back = decoded(got).collect()
    want = {r[0]: r[1] or "" for r in rows}
    assert all(r.text == want[r.doc_id] for r in back)
    n = Counter(r.doc_id for r in back)
    assert n == {1: 1, 2: 1, 3: 2, 4: 4, None: 2, 5: 2, 6: 2, 7: 2}
    assert len({(r.sample, tuple(r.pieces)) for r in back if r.doc_id == 4}) == 2
    assert all(r.log_inclusion == 0 for r in back if r.doc_id in (1, 2, 3))
    assert sampled(df.limit(0)).count() == 0
    odd = decoded(spark.createDataFrame([([-1, 99_999_999, None, 0, 3],), (None,), ([],)], "pieces array<int>"))
    assert [r.text for r in odd.collect()] == ["\x00", None, ""]


def test_spelling_is_compared_byte_for_byte():
    raw, offs = np.frombuffer(b" ab cd", np.uint8), np.array([0, 3, 6])
    ids = lambda text: [V.bytes_at + b for b in text]
    for first, second in ((b" ab", b" cd"), (b" ab", b" ce"), (b" ax", b" cd"), (b" a", b" cd")):
        flat = np.array(ids(first) + ids(second) + ids(b" ab"))
        got = V.spell_out(flat, np.cumsum([len(first), len(second), 3]), raw, offs, np.array([0, 1, 0]))
        assert got.tolist() == [first == b" ab", second == b" cd", True]
    assert V.spell_out(np.zeros(0, np.int64), np.zeros(0, np.int64), raw, offs, np.zeros(0, np.int64)).tolist() == []
