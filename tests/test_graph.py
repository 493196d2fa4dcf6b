from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.graph import connected_components


def brute(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5000, 5000)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, 1), (1, None)], "a long, b long")
    assert dict(map(tuple, connected_components(df).collect())) == brute(edges)
    assert connected_components(df.limit(0)).count() == 0


def plain_cover(cells):
    by = {}
    for t, i in cells:
        by.setdefault(t, set()).add(i)
    left, want = {i for _, i in cells}, []
    while left:
        t = min(by, key=lambda t: (-len(by[t] & left), t))
        want.append((t, len(by[t] & left)))
        left -= by[t]
    return want


def test_cover_by_parts_and_rounds(spark, monkeypatch):
    rng = random.Random(4)
    # one part of 60 tests, and 30 parts of a few
    cells = [(rng.randrange(60), rng.randrange(150)) for _ in range(700)] + [(100 + 3 * k + rng.randrange(3), 1000 + 4 * k + rng.randrange(4)) for k in range(30) for _ in range(8)]
    df = spark.createDataFrame([*cells, (None, 1), (1, None)], "test long, item long")
    text = df.select(F.concat(F.lit("t"), F.lpad(F.col("test").cast("string"), 4, "0")).alias("test"), F.col("item").cast("string").alias("item"))
    want = plain_cover(cells)
    monkeypatch.setattr(graph, "GROUP_ROWS", 40)
    for limit in (10_000, 300, 20, 0):
        assert [(r.test, r.gain) for r in graph.greedy_cover(df, limit).orderBy("step").collect()] == want
    assert [(int(r.test[1:]), r.gain) for r in graph.greedy_cover(text, 20).orderBy("step").collect()] == want
    assert graph.greedy_cover(df.limit(0)).count() == 0 and graph.greedy_cover(df.limit(0), 0).count() == 0


def test_groups_come_whole():
    import pyarrow as pa

    rng = random.Random(5)
    groups = sorted(rng.choices(range(40), k=3000))
    for size in (1, 7, 100, 3000):
        batches = [pa.RecordBatch.from_pydict({"g": groups[k : k + size]}) for k in range(0, len(groups), size)]
        got = []
        for out in graph.by_groups(lambda t: got.append(t["g"].to_pylist()) or t.to_batches()[0], "g")(iter([batches[0].slice(0, 0), *batches])):
            pass
        assert sum(got, []) == groups and all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_a_cover_of_many_steps_needs_few_jobs(spark):
    # every test shares an item with the next and has one item more: as many rounds as tests, before
    cells = [(k, f"{k}:{j}") for k in range(120) for j in range(k + 1)] + [(k, f"{k + 1}:0") for k in range(119)]
    spark.sparkContext.setJobGroup("cover", "")
    got = [(r.test, r.gain) for r in graph.greedy_cover(spark.createDataFrame(cells, "test long, item string")).orderBy("step").collect()]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cover"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_cover(cells) and 0 < jobs < 20
