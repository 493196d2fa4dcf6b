"""Command line: metrics, stats, report, vcs, test-health and config."""

from __future__ import annotations

import argparse
import copy
import json
import os
import sys

from pyspark.sql import SparkSession, functions as F

from tessera import project as pj, report
from tessera.operators import gates, graph, history, snapshots
from tessera.sources import code, numstat, settings as config

DEFAULT = {
    "languages": [dict(name="python", metrics=[dict(type=m, threshold=t, comparison=c, enabled=True) for m, t, c in gates.DEFAULTS])],
    "ignore_patterns": ["**/*_test.py", "**/test_*.py", "**/tests/**"], "use_gitignore": True, "profile": "standard",
}


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__, allow_abbrev=True)
    sub = top.add_subparsers(dest="command", required=True)

    def scanning(name: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--directory", "-d", default=".")
        p.add_argument("--files", nargs="*", default=[])
        p.add_argument("--include", action="append", default=[])
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--threshold", action="append", default=[])
        p.add_argument("--no-gitignore", action="store_true")
        p.add_argument("--force-analyze", action="store_true")
        p.add_argument("--cache", help="a folder of results by content; only files that it lacks are parsed")
        p.add_argument("--words", help="a list of words, one a line or by white space, plain or packed with gzip")
        p.add_argument("--skip", action="append", default=[], help="a name of files or folders to leave out wherever they lie")
        p.add_argument("--no-links", action="store_true")
        p.add_argument("--root", default="", help="the root package, stripped from absolute imports")
        return p

    m = scanning("metrics")
    m.add_argument("--format", choices=("text", "json"), default="text")
    m.add_argument("--quiet", action="store_true")
    s = scanning("stats")
    s.add_argument("--pattern", default=code.GLOB)
    s.add_argument("--by-directory", action="store_true")
    s.add_argument("--by-module", action="store_true")
    s.add_argument("--depth", type=int, default=0)
    s.add_argument("--path-style", choices=("relative", "parent", "full"), default="relative")
    s.add_argument("--metric", action="append", default=[])
    s.add_argument("--format", choices=("table", "json", "csv", "all"), default="table")
    s.add_argument("--output")
    r = scanning("report")
    r.add_argument("--format", choices=("html", "json"), default="html")
    r.add_argument("--output", default="report.html")
    r.add_argument("--top", type=int, default=20)
    r.add_argument("--baseline")
    r.add_argument("--save-baseline", action="store_true")
    r.add_argument("--text", action="store_true", help="also print the worst functions and what differs from the baseline")
    r.add_argument("--open", action="store_true", help="show the page")
    v = sub.add_parser("vcs")
    v.add_argument("--repo", default=".")
    v.add_argument("--window", type=int, default=90)
    v.add_argument("--snapshot")
    v.add_argument("--format", choices=("text", "json"), default="text")
    t = sub.add_parser("test-health")
    t.add_argument("--coverage-file", default=".coverage")
    t.add_argument("--format", choices=("text", "json"), default="text")
    c = sub.add_parser("config")
    c.add_argument("action", choices=("generate", "validate", "view", "schema"))
    c.add_argument("--format", choices=("summary", "table", "yaml", "json", "raw"), default="json")
    c.add_argument("--force", action="store_true", help="write over a file that is there")
    c.add_argument("path", nargs="?", default="tessera.json")
    return top


def validated(settings: dict) -> list[str]:
    """What is wrong with a configuration."""
    wrong = []
    for lang in settings.get("languages", ()):
        for m in lang.get("metrics", ()):
            low, high = gates.BOUNDS.get(m.get("type"), (0, float("inf")))
            if not isinstance(m.get("threshold"), (int, float)) or not low <= m["threshold"] <= high:
                wrong.append(f"{lang.get('name')}: threshold of {m.get('type')} isn't from {low} to {high}")
            if m.get("comparison", "<=") not in ("<", "<=", ">", ">=", "==", "!="):
                wrong.append(f"{lang.get('name')}: {m.get('comparison')} isn't a comparison")
        wrong += [f"{lang.get('name')}: extension {e} must begin with a dot" for e in lang.get("extensions", ()) if not e.startswith(".")]
    if settings.get("profile", "standard") not in ("extreme", "standard", "relaxed"):
        wrong.append("profile is extreme, standard or relaxed")
    return wrong


def _project(spark: SparkSession, a: argparse.Namespace, pattern: str = code.GLOB) -> pj.Project:
    settings = code.config(a.config) if a.config else copy.deepcopy(DEFAULT)
    for text in a.threshold:
        name, value = gates.parse_threshold(text)
        for lang in settings.get("languages", ()):
            old = next((m.get("comparison", "<=") for m in lang["metrics"] if m["type"] == name), "<=")
            lang["metrics"] = [*(m for m in lang["metrics"] if m["type"] != name), {"type": name, "threshold": value, "comparison": old, "enabled": True}]
    ignore = [] if a.force_analyze else list(dict.fromkeys([*settings.get("ignore_patterns", ()), *a.exclude]))
    files = code.code_files(spark, a.directory, ignore, a.include, settings.get("use_gitignore", True) and not (a.no_gitignore or a.force_analyze), pattern, excludes=a.skip, links=not a.no_links, also=a.files)
    return pj.Project(spark, files, settings, code.words(spark, a.words) if a.words else None, a.root, a.cache)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _write(text: str, path: str | None) -> None:
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def run(spark: SparkSession, argv: list[str]) -> int:
    """Runs a command; 0 for success, 2 for violations, 1 for what can't be analysed."""
    a = _parser().parse_args(argv)
    if a.command == "config":
        if a.action == "schema":
            _write(json.dumps(config.schema(), indent=2) + "\n", None)
            return 0
        if a.action == "generate":
            if os.path.exists(a.path) and not a.force:
                sys.stderr.write(f"{a.path} is there already; --force writes over it\n")
                return 1
            _write(config.as_yaml(DEFAULT, comments=True) if a.path.endswith((".yaml", ".yml")) else json.dumps(DEFAULT, indent=2) + "\n", a.path)
            return 0
        settings = code.config(a.path)
        wrong = validated(settings)
        with open(a.path, encoding="utf-8") as f:
            raw = f.read()
        _write(config.view(settings, a.format, raw) if a.action == "view" else "\n".join(wrong or ["valid"]) + "\n", None)
        return int(bool(wrong))
    if a.command == "vcs":
        log = numstat.git_log(spark, a.repo, a.window).cache()
        out = {"churn": _rows(history.top_churn(log)), "coupling": _rows(history.change_coupling(log).orderBy(F.desc("support"), "a", "b").limit(20)), "suite": _rows(history.suite_health(log))}
        if a.snapshot:
            out["hotspots"] = _rows(history.hotspots(history.churn(log), code.worst_cyclomatic(code.snapshot(spark, a.snapshot, False))).orderBy(F.desc("hotspot"), "path").limit(20))
    elif a.command == "test-health":
        cells = code.coverage(spark, a.coverage_file).cache()
        lines = cells.select("test", F.concat_ws(":", "file", F.col("line").cast("string")).alias("item"))
        unique = history.unique_coverage(cells)
        out = {"redundancy": _rows(history.redundancy(cells, graph.greedy_cover(lines))), "blast_radius": _rows(history.blast_radius(cells).orderBy(F.desc("tests"), "file").limit(15)), "without_unique_lines": [r["test"] for r in unique.filter("unique_lines = 0").orderBy("test").limit(15).collect()]}
    else:
        p = _project(spark, a, getattr(a, "pattern", code.GLOB))
        if p.files.isEmpty():
            sys.stderr.write("no files to analyse\n")
            return 1
        if a.command == "metrics":
            s, v, f = p.summary.head().asDict(recursive=True), _rows(p.violations.orderBy("path", "line", "metric")), _rows(p.findings)
            if a.format == "json":
                _write(json.dumps({"summary": s, "violations": v, "project": f}, indent=2) + "\n", None)
            elif not (a.quiet and s["success"]):
                _write(pj.as_text(s, v, f), None)
            return 0 if s["success"] else 2
        if a.command == "stats":
            if a.format == "all":
                for by in ("all", "folder", "package"):
                    rows = _rows(p.statistics(by, a.metric))
                    for end, text in (("json", json.dumps(rows, indent=2)), ("csv", pj.as_csv(rows)), ("txt", pj.as_table(rows))):
                        _write(text, f"{a.output or 'stats'}-{by}.{end}")
                return 0
            by = "folder" if a.by_directory else "package" if a.by_module else "all"
            found = p.statistics(by, a.metric)
            if by == "folder":
                from tessera.functions.paths import shown

                found = found.filter(F.when(F.col("folder") == ".", 0).otherwise(F.size(F.split("folder", "/"))) < (a.depth or 20)).orderBy("folder").withColumn("folder", shown(F.col("folder"), a.path_style))
            rows = _rows(found)
            _write({"json": lambda r: json.dumps(r, indent=2) + "\n", "csv": pj.as_csv, "table": pj.as_table}[a.format](rows), a.output)
            return 0
        p.settings["top"] = a.top
        snap = p.snapshot()
        snap["worst"] = _rows(p.worst)
        if a.save_baseline:
            pj.write_snapshot(snap, a.output.rsplit(".", 1)[0] + ".json", True)
        if a.baseline:
            path = a.output.rsplit(".", 1)[0] + ".current.json"
            pj.write_snapshot(snap, path)
            old = code.snapshot(spark, a.baseline)
            diff = {k: _rows(d) for k, d in pj.compared(old, code.snapshot(spark, path)).items()}
            before = old.head()["schema_version"]
            sys.stderr.writelines(f"{w}\n" for w in report.schema_warnings(before, pj.SCHEMA_VERSION))
            if a.text:
                _write(report.diff_summary(a.baseline, diff["files"], diff["values"], diff["violations"], diff["regressions"], diff["improvements"], snapshots.EPSILON), None)
            snap["diff"] = {k: d for k, d in diff.items() if k != "values"}
        if a.text:
            _write(report.worst_table(snap["worst"]), None)
        _write(json.dumps(snap, indent=2) if a.format == "json" else report.page(snap), a.output)
        if a.open and a.format == "html":
            import webbrowser

            webbrowser.open(f"file:{os.path.abspath(a.output)}")
        return 0
    if a.format == "json":
        _write(json.dumps(out, indent=2) + "\n", None)
    else:
        _write("\n".join(f"{k}\n{pj.as_table(v) if v and isinstance(v[0], dict) else chr(10).join(map(str, v))}" for k, v in out.items()) + "\n", None)
    return 0


def main() -> int:
    spark = SparkSession.builder.appName("tessera").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, sys.argv[1:])


if __name__ == "__main__":
    sys.exit(main())
