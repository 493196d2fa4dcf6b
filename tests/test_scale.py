"""That what a task holds, and what goes by way of the driver, doesn't grow with the tables."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tessera.operators import graph, history, imports
from tessera.plans import graph_queries, source_queries
from tessera.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_depths_send_nothing_by_the_driver(spark, monkeypatch):
    seen, cut = [], graph.cut

    def watched(df):
        df.collect()
        seen.append(plan(df))
        return cut(df)

    monkeypatch.setattr(graph, "cut", watched)
    rows = [(k, k // 3 if k else None, k > 0) for k in range(40)] + [(50, 51, True), (51, 50, True)]
    got = {r.node: r.depth for r in graph.depths(spark.createDataFrame(rows, "node long, base long, known boolean")).collect()}
    assert got[39] == 5 and got[50] == 1
    assert any("SortMergeJoin" in p for p in seen) and not any("BroadcastHashJoin" in p for p in seen)


def test_pairs_of_paths_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    rng = random.Random(2)
    cells = sorted({(rng.randrange(60), rng.randrange(25)) for _ in range(500)})
    df = history.change_coupling(spark.createDataFrame([(c, c, 1, 0, p) for c, p in cells], "commit long, seq long, added long, deleted long, path long"), 2)
    parts = [int(n) for n in re.findall(r"hashpartitioning\(a#[^)]*, (\d+)\)", plan(df))]
    assert parts and min(parts) > 20
    by = {}
    for c, p in cells:
        by.setdefault(p, set()).add(c)
    want = {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and len(by[a] & by[b]) >= 2}
    assert {(r.a, r.b): r.support for r in df.collect()} == want


def test_covered_lines_are_spread_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 50)
    rows = [(k % 7, k % 3, k % 40) for k in range(2000)] + [(9, 9, 9)]
    df = history.unique_coverage(spark.createDataFrame(rows, "test long, file long, line long"))
    assert re.search(r"hashpartitioning\(file#[^)]*line#[^)]*, 41\)", plan(df)) and plan(df).count("Exchange") <= 4
    got = {r.test: (r["lines"], r.unique_lines) for r in df.collect()}
    assert got[9] == (1, 1) and got[0] == (len({r for r in rows if r[0] == 0}), 0)


def test_small_classes_are_solved_together(monkeypatch, spark):
    import pyarrow as pa

    rng = random.Random(8)
    rows = [(k % 30, rng.choice("abcdef"), rng.randrange(9)) for k in range(150)]
    df = spark.createDataFrame([*rows, (99, None, None)], "class long, method string, other long")
    members, links = df.select("class", "method"), df.filter("method IS NOT NULL").select("class", "method", F.lit("f").alias("kind"), "other")
    want = {99: 0}
    for c in range(30):
        groups = [({m}, {o}) for k, m, o in rows if k == c]
        while hit := next(((a, b) for a in groups for b in groups if a is not b and (a[0] & b[0] or a[1] & b[1])), None):
            groups = [g for g in groups if g is not hit[0] and g is not hit[1]] + [(hit[0][0] | hit[1][0], hit[0][1] | hit[1][1])]
        want[c] = len(groups)
    assert dict(map(tuple, graph.cohesion(members, links).collect())) == want
    many = pa.table({"class": [1, 1, 2, None], "method": ["a", "b", "a", "a"], "kind": ["f", "f", None, None], "other": ["x", "x", None, None], "_at": [1, 1, 2, 3]})
    assert graph._cohesive(many).to_pydict() == {"class": [1, 2, None], "lcom": [1, 1, 1]}


def test_keys_of_many_rows_are_joined_alike(spark, monkeypatch):
    monkeypatch.setattr(tables, "MANY_ROWS", 3)
    a = spark.createDataFrame([(k % 4 if k < 20 else k, k) for k in range(40)], "k long, v long")
    b = spark.createDataFrame([(k, s) for k in range(2, 30) for s in "xy"], "k long, w string")
    out = tables.joined(a, b, ["k"])
    assert "BroadcastHashJoin" in plan(out) and "Union" in plan(out)
    assert sorted(map(tuple, out.select("k", "v", "w").collect())) == sorted(map(tuple, a.join(b, "k").select("k", "v", "w").collect()))


def test_what_is_imported_often_is_looked_up_once(spark, monkeypatch):
    monkeypatch.setattr(tables, "MANY_ROWS", 5)
    seen, joined = [], imports.joined
    monkeypatch.setattr(imports, "joined", lambda rows, other, keys: seen.append(rows.count()) or joined(rows, other, keys))
    facts = spark.createDataFrame([(f"app.m{k}", "app.base", ["Base", "Other"]) for k in range(50)], "source string, prefix string, names array<string>")
    mods = spark.createDataFrame([("app.base",), ("app",)], "module string")
    assert {(r.source, r.target) for r in imports.resolve(facts, mods, "app").collect()} == {(f"app.m{k}", "app.base") for k in range(50)}
    assert seen[0] < 30 and seen[1] == 100


def test_shares_of_nations_are_counted_before_they_are_joined(spark, monkeypatch):
    seen, plain = [], imports.main_sequence_of
    monkeypatch.setattr(imports, "main_sequence_of", lambda share, edges, of: seen.append((share.count(), share.select("module").distinct().count(), edges.schema["source"].dataType.typeName())) or plain(share, edges, of))
    n = graph_queries.q_main_sequence(spark, FOLDER).count()
    assert n == tables.table(spark, FOLDER, "supplier").count()
    rows, modules, kind = seen[0]
    assert rows == modules <= n and kind == "long"


def test_dependencies_are_compared_by_key(spark, monkeypatch):
    seen, plain = [], imports.unstable_dependencies
    monkeypatch.setattr(imports, "unstable_dependencies", lambda e, of: seen.append(e.schema["source"].dataType.typeName()) or plain(e, of))
    assert graph_queries.q_sdp(spark, FOLDER).schema["module"].dataType.typeName() == "string" and seen == ["long"]


def test_a_narrative_scores_only_what_is_wanted(spark):
    text = plan(source_queries.q_source_narrative(spark, FOLDER))
    assert "regexp_extract_all" not in text and "name_clarity" not in text
