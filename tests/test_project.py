from __future__ import annotations

import json
import sqlite3
import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import run
from tessera.functions import names, paths, python_source, script_source
from tessera.operators import graph, history, imports
from tessera import plugins, report
from tessera.project import Project, compared
from tessera.sources import cache, code, numstat, settings as config

TREE = {
    "pkg/__init__.py": "import pkg.cli\n",
    "pkg/cli.py": "from pkg.core import Engine, start\nfrom . import util\n\n\ndef main(args, verbose=True):\n    start(args)\n    util.helper(args)\n    return Engine()\n",
    "pkg/core.py": "from abc import ABC\nfrom pkg import util\n\nSTATE = 1\ncounter = 0\n\n\nclass Base(ABC):\n    def go(self):\n        self.x = 1\n\n    def stop(self):\n        return self.x\n\n    def other(self):\n        return self.y\n\n\nclass Engine(Base):\n    def run(self, n: int) -> int:\n        total = 0\n        for i in range(n):\n            if i % 2 and i > 3:\n                total += counter\n        return total\n\n\ndef start(args):\n    try:\n        util.helper(args)\n    except Exception:\n        pass\n",
    "pkg/util.py": "import pkg.cli\n\n\ndef helper(a):\n    # TODO later\n    return a.b.c.d()\n\n\ndef twin_one(p, q):\n    r = p + q\n    return r * 2\n\n\ndef twin_two(x, y):\n    z = x + y\n    return z * 2\n",
    "pkg/bad.py": "def broken(:\n",
    "web/app.ts": "export function go(a: number): number {\n  if (a > 1 && a < 5) { return 1 }\n  return a ? 2 : 3\n}\nconst f = (x) => { for (;;) { break } }\n",
    "tests/test_core.py": "def test_go():\n    assert 1\n    assert [1, 2, 3, 4, 5, 6, 7, 8]\n",
    "build/out.py": "x = 1\n",
    ".gitignore": "# built\nbuild/\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def project(spark, tree):
    return Project(spark, code.code_files(spark, tree), {"import_graph": {}, "tree_shape": {"layers": ["pkg"]}, "narrative": {}}, root="pkg")


def test_files(spark, tree):
    have = lambda **kw: {r.path for r in code.code_files(spark, tree, **kw).collect()}
    assert have() == set(TREE) - {".gitignore", "build/out.py"}
    assert "build/out.py" in have(use_gitignore=False) and "build/out.py" in have(include=["build/*"])
    assert have(ignore=["**/test_*.py", "web/"]) == {k for k in TREE if k.startswith("pkg")}


def test_metrics(project):
    m = {(r.path, r.metric, r.function, r.kind): r.value for r in project.extract.metrics.collect()}
    assert m["pkg/core.py", "cyclomatic_complexity", "run", "method"] == 4 and m["pkg/core.py", "cognitive_complexity", "Engine::run", "function"] == 4
    assert m["pkg/core.py", "exception_discipline", "start", "function"] == 1 and m["pkg/core.py", "global_state_reach", "run", "function"] == 1
    assert m["pkg/util.py", "message_chain_depth", "helper", "function"] == 3 and m["pkg/util.py", "marker_density", None, "file"] == pytest.approx(1000 / 16)
    assert m["pkg/cli.py", "boolean_flag_parameters", "main", "function"] == 1
    assert m["tests/test_core.py", "assertions_per_test", "test_go", "function"] == 2 and m["tests/test_core.py", "big_literal_assertions", "test_go", "function"] == 1
    assert m["web/app.ts", "cyclomatic_complexity", "go", "function"] == 4 and m["web/app.ts", "cyclomatic_complexity", "f", "function"] == 2
    assert m["pkg/core.py", "weighted_methods_per_class", "Engine", "class"] == 4 and m["pkg/core.py", "coupling_between_objects", "Base", "class"] == 1
    assert [r.path for r in project.extract.errors.collect()] == ["pkg/bad.py"]


def test_graph_of_modules(project):
    assert {(r.source, r.target) for r in project.edges.collect()} == {("pkg", "pkg.cli"), ("pkg.cli", "pkg.core"), ("pkg.cli", "pkg.util"), ("pkg.core", "pkg.util"), ("pkg.util", "pkg.cli")}
    assert [(r.subject, r["size"]) for r in project.cycles.collect()] == [("cycle: pkg.cli <-> pkg.core <-> pkg.util", 3)]
    seq = {r.module: r for r in project.main_sequence.collect()}
    assert seq["pkg.core"].abstractness == 0.5 and seq["pkg.cli"].inversion == 0.25


def test_classes(project):
    got = {r.node: r for r in project.class_report.collect()}
    base, engine = got["pkg.core::Base"], got["pkg.core::Engine"]
    assert (base.depth, base.approximate, base.children, base.lcom) == (2, True, 1, 2)
    assert (engine.depth, engine.approximate, engine.children, engine.lcom, engine.weighted, engine.statements) == (3, True, 0, 1, 4, 5)
    assert engine.single_responsibility == round((1 + 4 / 30) * (1 + 5 / 60), 2)


def test_clones_and_narrative(project):
    assert sorted(r.name for r in project.clones.collect()) == ["twin_one", "twin_two"]
    assert {r.path: r.lines for r in project.duplication.collect()} == {"pkg/util.py": 6}
    n = {(r.module, r.metric): r for r in project.narrative.collect()}
    assert n["pkg.core", "step_down_ordering"].value == 1.0 and n["pkg.core", "naming_antipatterns"].value == 0
    assert n["pkg.core", "computer_budget_exceeded"].names == ["run"]


def test_commands(spark, tree, tmp_path, capsys):
    assert run(spark, ["metrics", "-d", tree, "--format", "json", "--root", "pkg", "--threshold", "cyc=3"]) == 2
    out = json.loads(capsys.readouterr().out)
    assert {v["function"] for v in out["violations"] if v["metric"] == "cyclomatic_complexity"} == {"run"} and out["summary"]["total_files"] == 6
    assert run(spark, ["metrics", "-d", str(tmp_path)]) == 1
    assert run(spark, ["stats", "-d", tree, "--by-directory", "--format", "csv", "--metric", "loc"]) == 0
    assert capsys.readouterr().out.splitlines()[0].startswith("folder,files,total_lines_of_code")
    old, page = str(tmp_path / "a.json"), str(tmp_path / "b.html")
    assert run(spark, ["report", "-d", tree, "--format", "json", "--output", old]) == 0
    assert run(spark, ["report", "-d", tree, "--output", page, "--baseline", old, "--top", "2"]) == 0
    assert "://" not in open(page).read()
    snap = code.snapshot(spark, old)
    assert code.worst_cyclomatic(snap).filter("path = 'pkg/core.py'").head().complexity == 4
    same = compared(snap, snap)
    assert {r.status for r in same["files"].collect()} == {"common"} and same["values"].count() == 0 and same["regressions"].count() == 0
    assert run(spark, ["config", "generate", str(tmp_path / "c.json")]) == 0 and run(spark, ["config", "validate", str(tmp_path / "c.json")]) == 0


def test_snapshot_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"files": [1, {"path": "a", "metrics": {"m": "no", "n": True, "k": 2}}, {"metrics": {}}]}))
    assert [(r.path, r.metric, r.value) for r in code.snapshot_values(code.snapshot(spark, str(tmp_path / "x.json"))).collect()] == [("a", "k", 2.0)]
    with pytest.raises(OSError):
        code.snapshot(spark, str(tmp_path / "none.json"))
    assert code.snapshot(spark, str(tmp_path / "none.json"), False).count() == 0


def test_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", "-C", str(tmp_path), *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "tests").mkdir()
    for k in range(4):
        for f in ("engine.py", "tests/test_engine.py") + (("config.py",) if k < 3 else ()):
            (tmp_path / f).write_text("x\n" * (k + 1))
        git("add", "-A")
        git("commit", "-qm", str(k))
    log = numstat.git_log(spark, str(tmp_path)).cache()
    assert {r.path: (r.churn, r.commits) for r in history.churn(log).collect()} == {"engine.py": (4, 4), "tests/test_engine.py": (4, 4), "config.py": (3, 3)}
    pairs = {(r.a, r.b): (r.support, r.confidence) for r in history.change_coupling(log).collect()}
    assert pairs["config.py", "engine.py"] == (3, 1.0) and len(pairs) == 3
    assert tuple(history.suite_health(log).head()) == (4 / 7, 1.0)
    assert numstat.git_log(spark, str(tmp_path / "none")).count() == 0


def test_coverage(spark, tmp_path):
    con = sqlite3.connect(tmp_path / ".coverage")
    con.executescript("CREATE TABLE context(id, context); CREATE TABLE file(id, path); CREATE TABLE line_bits(file_id, context_id, numbits)")
    con.executemany("INSERT INTO context VALUES (?, ?)", [(0, ""), (1, "a|run"), (2, "b|run"), (3, "c|run")])
    con.executemany("INSERT INTO file VALUES (?, ?)", [(1, "m"), (2, "n")])
    con.executemany("INSERT INTO line_bits VALUES (?, ?, ?)", [(1, 1, b"\x0e"), (1, 2, b"\x06"), (2, 3, b"\x02"), (1, 0, b"\xff")])
    con.commit()
    cells = code.coverage(spark, str(tmp_path)).cache()
    assert {r.test: r.ratio for r in history.unique_coverage(cells).collect()} == {"a": 1 / 3, "b": 0.0, "c": 1.0}
    assert {r.file: r.tests for r in history.blast_radius(cells).collect()} == {"m": 2, "n": 1}
    cover = graph.greedy_cover(cells.select("test", F.concat_ws(":", "file", F.col("line").cast("string")).alias("item")))
    assert [(r.test, r.gain) for r in cover.orderBy("step").collect()] == [("a", 3), ("c", 1)]
    assert history.redundancy(cells, cover).head().redundancy == pytest.approx(1 / 3)
    assert history.redundancy(cells.limit(0), cover.limit(0)).head().redundancy == 0.0


def test_cache(spark, tmp_path):
    files = spark.createDataFrame([("a", "x = 1"), ("b", "y = 2")], "path string, content string")
    keys = files.withColumn("content_key", cache.content_key(F.col("content"), "v", "python")).withColumn("errors", F.when(F.col("path") == "b", F.array(F.lit("no"))))
    assert cache.read_entries(spark, str(tmp_path / "c"), 1) is None
    cache.put(keys.select("content_key", "errors", "path"), str(tmp_path / "c"), 1)
    entries = cache.read_entries(spark, str(tmp_path / "c"), 1)
    assert [r.path for r in cache.absent(keys, entries).collect()] == ["b"] and cache.read_entries(spark, str(tmp_path / "c"), 2).count() == 0


def test_source_rules():
    one = python_source.analyse("class A:\n    def f(self, one, two, *rest, **named):\n        return self.helper()\n\ndef g(a, strict=True):\n    '''doc'''\n    return q.where(p).sort(r)\n\ndef h(a, *, strict=True):\n    pass\n")["metrics"]
    of = {(m["metric"], m["function"]): m["value"] for m in one}
    assert of["function_arity", "f"] == 4 and of["message_chain_depth", "f"] == 0 and of["message_chain_depth", "g"] == 2
    assert of["boolean_flag_parameters", "g"] == 1 and of["boolean_flag_parameters", "h"] == 0 and of["comment_density", None] == 0
    assert python_source.analyse("") ["errors"] == [] and python_source.analyse("\0")["errors"]
    assert [(f["name"], f["cyclomatic"], f["end_line"]) for f in script_source.functions("class K {\n go(a) {\n  while (a) { a = a || 1 }\n }\n}\nconst t = x => 1\nlet u = (y) => y ? 1 : 2;\n")] == [("go", 3, 4), ("u", 2, 7)]
    assert report.page({"files": [{"path": "<a>", "functions": [], "violations": [], "error": "</script> http://x"}]}).count("://") == 0


def test_strong_components_both_ways(spark):
    import random

    rng = random.Random(3)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(100, 101), (101, 102), (102, 100)]
    e = spark.createDataFrame(pairs, "source int, target int")
    reach = {a: {a} for p in pairs for a in p}
    for _ in range(60):
        for a, b in pairs:
            for s in reach.values():
                if a in s:
                    s.add(b)
    want = {(min(y for y in reach if x in reach[y] and y in reach[x]), x) for x in reach if any(x in reach[y] and y in reach[x] for y in reach if y != x)}
    for limit in (1000, 0):
        assert {(r.component, r.node) for r in graph.strong_components(e, task_edges=limit).collect()} == want


def test_depths(spark):
    rows = [("a", None, False), ("b", "a", True), ("c", "ext", False), ("d", "c", True), ("e", "f", True), ("f", "e", True), ("g", "b", True), ("g", "d", True)]
    got = {r.node: (r.depth, r.flagged) for r in graph.depths(spark.createDataFrame(rows, "node string, base string, known boolean")).collect()}
    assert got == {"a": (1, False), "b": (2, False), "c": (2, True), "d": (3, True), "e": (1, True), "f": (1, True), "g": (4, True)}


def test_imports_and_paths(spark):
    mods = spark.createDataFrame([("core",), ("core.model",), ("util",)], "module string")
    facts = spark.createDataFrame([("cli", "myproj.core", ["model"]), ("cli", "other.model", []), ("core", "core", ["x"]), ("util", "", ["core"])], "source string, prefix string, names array<string>")
    assert {(r.source, r.target) for r in imports.resolve(facts, mods, "myproj").collect()} == {("cli", "core.model"), ("util", "core")}
    df = spark.createDataFrame([("pkg/sub/__init__.py",), ("a.py",)], "p string")
    assert [r[0] for r in df.select(paths.module(df.p)).collect()] == ["pkg.sub", "a"]
    assert [r[0] for r in df.select(F.array_join(paths.ancestors(df.p), ",")).collect()] == [".,pkg,pkg/sub", "."]
    n = spark.createDataFrame([("getUsersByNameDesc",), ("fetch_users_v2",)], "n string")
    assert [r[0] for r in n.select(F.array_join(names.words(n.n), " ")).collect()] == ["get users by name desc", "fetch users v"]


def test_greedy_cover_against_plain(spark):
    import random

    rng = random.Random(9)
    cells = [(f"t{rng.randrange(25):02}", rng.randrange(60)) for _ in range(300)]
    left, by, want = {i for _, i in cells}, {}, []
    for t, i in cells:
        by.setdefault(t, set()).add(i)
    while left:
        t = min(by, key=lambda t: (-len(by[t] & left), t))
        want.append((t, len(by[t] & left)))
        left -= by[t]
    assert [(r.test, r.gain) for r in graph.greedy_cover(spark.createDataFrame(cells, "test string, item int")).orderBy("step").collect()] == want


def test_only_what_changed_is_parsed(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    class Counting:
        names = ()

        def available(self):
            return True

        def analyse(self, text, test_file):
            import os

            with open(os.path.join(str(seen), str(len(text))), "a") as f:
                f.write("x")
            return python_source.analyse(text, test_file)

    runners = {"python": [Counting()]}
    rows = [("a.py", "def f():\n    pass\n"), ("b.py", "def f():\n    pass\n"), ("c.py", "x = 1\n"), ("bad.py", "def (\n"), ("tests/a.py", "def f():\n    pass\n"), ("n.py", None)]
    read = lambda rows: Project(spark, spark.createDataFrame(rows, "path string, content string"), cache=str(tmp_path / "cache"), runners=runners)
    plain = Project(spark, spark.createDataFrame(rows, "path string, content string"))
    every = lambda p: sorted(map(tuple, p.extract.all.collect()))
    first = read(rows)
    assert first.extract.parsed == 4 and every(first) == every(plain)
    again = read(rows)
    assert again.extract.parsed == 1 and every(again) == every(plain)  # what fails isn't kept
    changed = read([*rows[:2], ("c.py", "y = 22\n"), ("new.py", "x = 1\n")])
    assert changed.extract.parsed == 1 and {r.path for r in changed.extract.all.select("path").collect()} == {"a.py", "b.py", "c.py", "new.py"}
    cache.clear(spark, str(tmp_path / "cache"))
    assert read(rows).extract.parsed == 4


def test_analysers_and_derivers_of_users(spark):
    class Words:
        names = ("words",)

        def available(self):
            return True

        def analyse(self, text, test_file):
            return {"metrics": [{"metric": "words", "value": float(len(text.split())), "line": None, "function": None, "kind": "file", "owner": None, "ord": 0}]}

    class Missing(Words):
        def available(self):
            return False

    files = spark.createDataFrame([("a.py", "x = 1\n"), ("b.ts", "let y\n")], "path string, content string")
    long = lambda p: [p.extract.metrics.filter("metric = 'words' AND value > 2").select(F.col("path").alias("subject"), "metric", "value", F.lit("long").alias("message"))]
    p = Project(spark, files, runners={"python": [*plugins.RUNNERS["python"], Words()], "typescript": [Missing()]}, derivers=[long])
    assert {(r.path, r.metric) for r in p.extract.metrics.filter("metric IN ('words', 'lines_of_code')").collect()} == {("a.py", "words"), ("a.py", "lines_of_code")}
    assert [(r.subject, r.value) for r in p.findings.collect()] == [("a.py", 3.0)]
    assert Project(spark, files, {"import_graph": {}}, derivers=[]).findings.count() == 0


def test_settings():
    text = '# c\nlanguages:\n  - name: python   # note\n    metrics:\n      - type: cyclomatic_complexity\n        threshold: 10\n        comparison: "<="\n      - {type: x, threshold: 1.5, enabled: false}\nignore_patterns: ["**/t#x", \'a, b\']\nuse_gitignore: true\ntree_shape:\n  layers:\n  - cli\n  - core\nprofile: ~\n'
    want = {"languages": [{"name": "python", "metrics": [{"type": "cyclomatic_complexity", "threshold": 10, "comparison": "<="}, {"type": "x", "threshold": 1.5, "enabled": False}]}], "ignore_patterns": ["**/t#x", "a, b"], "use_gitignore": True, "tree_shape": {"layers": ["cli", "core"]}, "profile": None}
    assert config.parsed(text) == want == config.parsed(config.as_yaml(want, comments=True)) == config.parsed(json.dumps(want))
    assert config.as_yaml(want, comments=True).startswith("# ") and config.parsed("") == {}
    for wrong in ("a: 1\n   b: 2\n", "a: &x 1\n", "just words\n"):
        with pytest.raises(ValueError):
            config.parsed(wrong)
    assert "python: 1 thresholds" in config.view(want, "summary") and "1.5" in config.view(want, "table") and config.view(want, "raw", text) == text
    assert config.schema()["properties"]["profile"]["enum"] == ["extreme", "standard", "relaxed"]


def test_words_of_a_report():
    rows = [{"rank": 1, "path": "a.py", "name": "f", "line": 3, "score": 12.0, "cyclomatic": 12.0, "cognitive": None}]
    assert report.worst_table(rows).splitlines()[2].split() == ["1", "12", "12", "-", "f", "a.py:3"] and "no function" in report.worst_table([])
    assert report.schema_warnings(1, 1) == [] and len(report.schema_warnings(1, 2)) == 1
    nothing = report.diff_summary("x", [{"path": "a", "status": "common"}], [], [], [], [], 0.01)
    assert "nothing differs by more than 0.01" in nothing
    said = report.diff_summary("x", [{"path": "n", "status": "added"}], [{"path": "a", "name": "", "metric": "m", "old": 1.0, "new": 2.5, "delta": 1.5}], [{"path": "a", "metric": "m", "name": "f", "change": "added"}], [{"path": "a", "name": "f", "delta": 2.0, "newly": True}], [], 0.01)
    assert "  new n" in said and "a m: 1 to 2.5 (+1.5)" in said and "+2 a f *" in said and "new violations: 1" in said


def test_scan_options_and_words(spark, tmp_path):
    import gzip
    import os

    for name in ("a.py", "skip/b.py", "sub/c.py", "sub/d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    os.symlink(tmp_path / "a.py", tmp_path / "link.py")
    found = lambda **kw: {r.path for r in code.code_files(spark, str(tmp_path), **kw).collect()}
    assert found(excludes=["skip"]) == {"a.py", "link.py", "sub/c.py"} and found(links=False) == {"a.py", "skip/b.py", "sub/c.py"}
    assert found(ignore=["**/*.py"], also=["sub/c.py"]) == {"sub/c.py"}
    with gzip.open(tmp_path / "words.gz", "wt") as f:
        f.write("Apple pear\n\nfig\n")
    assert sorted(r.word for r in code.words(spark, str(tmp_path / "words.gz")).collect()) == ["apple", "fig", "pear"]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tessera.sources import tables

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))}))})

    fake = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})})
    with pytest.raises(RuntimeError):
        tables.shared_folder(fake)
