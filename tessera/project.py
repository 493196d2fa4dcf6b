"""A whole project: its files, what is extracted and derived from them, and how that is reported."""

from __future__ import annotations

import csv
import io
import json
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import names
from tessera.functions.paths import folder, glob_regex, module
from tessera.operators import classes, clones, gates, graph, imports, narrative, snapshots, stats
from tessera.operators.extract import Extract, reported_errors
from tessera.sources.tables import cut

SCHEMA_VERSION = 2


class Project:
    """Tables over the files (path, content) of one project; each is computed when asked for, the extraction once."""

    def __init__(self, spark: SparkSession, files: DataFrame, settings: dict | None = None, vocabulary: DataFrame | None = None, root: str = "", cache: str | None = None, runners: dict | None = None, derivers: list | None = None, only: dict | None = None):
        """vocabulary: words (word and, where it has one, role); the words of the project's modules and classes and those
        that the settings allow are added. cache: a folder of earlier results by content. runners: analysers by language.
        derivers: functions of a project that give (subject, metric, value, message); DERIVERS where None. only: the kinds
        of rows (see extract.extracted) that are asked for, where not all are; a table of another kind is an error."""
        self.spark, self.settings, self.root = spark, settings or {}, root
        self.extract = Extract(files.dropDuplicates(["path"]), folder=cache, runners=runners, only=only)
        self.files = self.extract.files
        self.words = vocabulary if vocabulary is not None else spark.createDataFrame([], "word string, role string")
        self.derivers = DERIVERS if derivers is None else derivers

    @cached_property
    def vocabulary(self) -> DataFrame:
        plain = names.vocabulary(self.words)
        own = self.modules.select(F.col("module").alias("name")).unionByName(self.extract.classes.select("name"))
        return cut(names.vocabulary(plain, names.anchors(own, plain), self.settings.get("allowed_words")))

    @cached_property
    def modules(self) -> DataFrame:
        """(path, module) of the Python files that aren't empty."""
        return self.files.filter("language = 'python' AND length(content) > 0").select("path", module(F.col("path")).alias("module")).filter("module IS NOT NULL")

    @cached_property
    def edges(self) -> DataFrame:
        """(source, target) between modules that import one another."""
        facts = self.extract.imports.join(self.modules.withColumnRenamed("module", "source"), "path")
        prefix = imports.absolute(F.col("module"), F.col("level"), F.col("source"), F.col("path").rlike("(^|/)__init__\\.[^/]*$"))
        return cut(imports.resolve(facts.select("source", prefix.alias("prefix"), "names"), self.modules, self.root or "\x00"))

    @cached_property
    def coupling(self) -> DataFrame:
        return imports.coupling(self.modules, self.edges)

    @cached_property
    def cycles(self) -> DataFrame:
        return graph.cycles(graph.strong_components(self.edges))

    def _classes(self, keep_init: bool) -> DataFrame:
        return self.extract.classes.withColumn("module", module(F.col("path"), keep_init)).filter("module IS NOT NULL")

    @cached_property
    def main_sequence(self) -> DataFrame:
        of = self._classes(False).select("module", classes.is_abstract(F.col("bases"), F.col("keywords"), F.col("methods")).alias("abstract"))
        return imports.main_sequence(of, self.edges, self.coupling)

    @cached_property
    def class_report(self) -> DataFrame:
        named = lambda df: df.withColumn("source_module", module(F.col("path"), True))
        bound = classes.bindings(named(self.extract.imports))
        node = F.concat(module(F.col("path"), True), F.lit("::"), F.col("owner"))
        weighted = self.extract.metrics.filter("metric = 'cyclomatic_complexity' AND owner IS NOT NULL").groupBy(node.alias("node")).agg(F.sum("value").alias("weighted"))
        mine = self.extract.callables.filter("class_name IS NOT NULL").groupBy(F.concat(module(F.col("path"), True), F.lit("::"), F.col("class_name")).alias("node")).agg(F.sum("statements").alias("statements"))
        return classes.report(self._classes(True), bound, weighted, mine)

    @cached_property
    def narrative(self) -> DataFrame:
        c = self.extract.callables.withColumn("module", module(F.col("path"))).filter("module IS NOT NULL")
        tolerance = narrative.TOLERANCE[self.settings.get("profile", "standard")]
        return narrative.report(c, self.vocabulary, tolerance)

    @cached_property
    def clones(self) -> DataFrame:
        return clones.clone_groups(self.extract.clones)

    @cached_property
    def duplication(self) -> DataFrame:
        sloc = self.extract.metrics.filter("metric = 'source_lines_of_code'").groupBy("path").agg(F.max("value").alias("sloc"))
        return clones.duplication(self.clones, sloc)

    @cached_property
    def fan_out(self) -> DataFrame:
        return stats.fan_out(self.files.filter("language = 'python'"))

    @cached_property
    def limits(self) -> DataFrame:
        rows = [(lang["name"], m["type"], float(m["threshold"]), m.get("comparison", "<="), m.get("enabled", True), k) for lang in self.settings.get("languages", ()) for k, m in enumerate(lang.get("metrics", ()))]
        return gates.thresholds(self.spark, rows)

    @cached_property
    def violations(self) -> DataFrame:
        v = gates.violations(self.extract.metrics, self.limits)
        text = gates.message(F.col("path"), F.col("line"), F.col("function"), F.col("metric"), F.col("value"), F.col("threshold"), F.col("comparison"))
        return v.withColumn("message", text)

    @cached_property
    def findings(self) -> DataFrame:
        """(subject, metric, value, message): what the settings forbid of modules, folders and cycles."""
        out = self.spark.createDataFrame([], "subject string, metric string, value double, message string")
        for derive in self.derivers:
            for part in derive(self):
                out = out.unionByName(part)
        return out

    @cached_property
    def summary(self) -> DataFrame:
        return gates.summary(self.files, self.violations, self.findings.withColumn("path", F.col("subject")))

    # --- snapshots

    @cached_property
    def function_values(self) -> DataFrame:
        """(path, name, line, values) of functions; a name that several classes have in a file stands with its class."""
        m = self.extract.metrics.filter("function IS NOT NULL AND kind IN ('function', 'method')").withColumn("bare", F.element_at(F.split("function", "::"), -1))
        forms = m.groupBy("path", "bare").agg(F.count_distinct(F.coalesce("owner", F.lit(""))).alias("forms"))
        name = F.when((F.col("forms") > 1) & F.col("owner").isNotNull(), F.concat("owner", F.lit("::"), "bare")).otherwise(F.col("bare"))
        return stats.functions_of(m.join(forms, ["path", "bare"]).withColumn("name", name), "path", "name")

    def snapshot(self) -> dict:
        """A snapshot as one document, built on the driver: for a report, not for further queries."""
        of: dict[str, dict] = {r["path"]: {"path": r["path"], "language": r["language"], "error": None, "metrics": {}, "violations": [], "functions": []} for r in self.files.select("path", "language").orderBy("path").collect()}
        for r in reported_errors(self.extract.all).collect():
            of[r["path"]]["error"] = r["message"]
        last = self.extract.metrics.filter("function IS NULL").groupBy("path", "metric").agg(F.max_by("value", "ord").alias("value"))
        for r in last.orderBy("path", "metric").collect():
            of[r["path"]]["metrics"][r["metric"]] = r["value"]
        for r in self.violations.orderBy("path", "metric", "line").collect():
            of[r["path"]]["violations"].append({"type": r["metric"], "message": r["message"], "line_number": r["line"], "function": r["function"], "value": r["value"], "threshold": r["threshold"], "comparison": r["comparison"]})
        for r in self.function_values.orderBy("path", F.asc_nulls_last("line"), "name").collect():
            of[r["path"]]["functions"].append({"name": r["name"], "line": r["line"], "metrics": r["values"]})
        size = F.coalesce(*(F.max(F.when(F.col("metric") == m, F.col("value"))) for m in ("source_lines_of_code", "lines_of_code")))
        sizes = self.files.select("path").join(self.extract.metrics.filter("function IS NULL").groupBy("path").agg(size.alias("value")), "path", "left")
        tree = [r.asDict() for r in snapshots.nodes(sizes).orderBy("id").collect()]
        s = self.summary.head().asDict(recursive=True)
        return {"schema_version": SCHEMA_VERSION, "root": self.root, "summary": s, "files": list(of.values()), "project": [r.asDict() for r in self.findings.orderBy("subject", "metric").collect()], "treemap": tree}

    @cached_property
    def worst(self) -> DataFrame:
        f = self.function_values.select("path", "name", F.col("values")["cyclomatic_complexity"].alias("cyclomatic"), F.col("values")["cognitive_complexity"].alias("cognitive"))
        return gates.worst(f, self.settings.get("top", 20))

    # --- statistics

    def statistics(self, by: str = "all", metrics: list[str] | None = None) -> DataFrame:
        known = [r[0] for r in self.extract.metrics.select("metric").distinct().collect()]
        chosen, _ = stats.wanted(metrics or [], known)
        rows = self.extract.metrics.filter(F.col("metric").isin(*chosen))
        if by == "all":
            return stats.by_metric(rows)
        per_file = rows.filter("function IS NULL").groupBy("path").pivot("metric", chosen).agg(F.max("value")) if chosen else self.files.select("path")
        files = self.files.select("path").join(per_file, "path", "left")
        values = {m: m for m in chosen}
        if by == "folder":
            return stats.by_folder(files, values)
        packages = [r[0] for r in self.files.filter("path RLIKE '(^|/)__init__\\\\.py$'").select(folder(F.col("path"))).distinct().collect()]
        name = F.when(folder(F.col("path")).isin(*packages), F.replace(folder(F.col("path")), F.lit("/"), F.lit("."))).otherwise("<root>")
        return stats.by_package(files.withColumn("package", name), "package", values)


# --- what settings forbid


def _said(df: DataFrame, subject: str, metric: str, value: str, text: str) -> DataFrame:
    out = df.select(F.col(subject).alias("subject"), F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"))
    return out.withColumn("message", F.concat("subject", F.lit(f": {text}, "), F.format_string("%.2f", "value")))


def forbidden_shapes(p: Project) -> list[DataFrame]:
    tree = p.settings.get("tree_shape")
    if tree is None:
        return []
    low, high = tree.get("fan_out_min", 2), tree.get("fan_out_max", 7)
    bad = p.fan_out.filter((F.col("children") > high) | ((F.col("children") < low) & (F.col("folder") != ".")))
    for pattern in tree.get("exclude", ()):
        bad = bad.filter(~F.col("folder").rlike(glob_regex(pattern)))
    out = [_said(bad, "folder", "directory_children", "children", f"children outside {low} to {high}")]
    if tree.get("layers"):
        up = imports.layering(p.edges, p.modules, tree["layers"]).filter("violations > 0")
        out.append(_said(up, "module", "layering_violations", "violations", "imports of outer layers"))
    return out


def forbidden_imports(p: Project) -> list[DataFrame]:
    rules = p.settings.get("import_graph")
    if rules is None:
        return []
    most = rules.get("max_stable_dependencies_violations", 0)
    bad = imports.unstable_dependencies(p.edges, p.coupling).filter(F.col("violations") > most)
    out = [_said(bad, "module", "stable_dependencies_violations", "violations", "imports of less stable modules")]
    return [_said(p.cycles, "subject", "dependency_cycles", "size", "modules on a cycle"), *out] if rules.get("forbid_cycles", True) else out


def forbidden_stories(p: Project) -> list[DataFrame]:
    rules = p.settings.get("narrative")
    if rules is None:
        return []
    counted = p.narrative.filter(F.col("metric").isin("narrative_mixed_functions", "narrator_budget_exceeded", "computer_budget_exceeded", "naming_antipatterns") & (F.col("value") > 0))
    out = [counted.select(F.col("module").alias("subject"), "metric", "value", F.concat("module", F.lit(": "), F.array_join("names", ", ")).alias("message"))]
    if rules.get("name_clarity_floor") is not None:
        low = p.narrative.filter((F.col("metric") == "name_clarity") & (F.col("value") < rules["name_clarity_floor"]))
        out.append(_said(low, "module", "name_clarity", "value", "clarity of names below the floor"))
    return out


#: What a project's findings are derived by, each giving any number of tables.
DERIVERS = [forbidden_shapes, forbidden_imports, forbidden_stories]


# --- text, JSON, CSV and HTML


def as_text(summary: dict, violations: list, findings: list) -> str:
    lines = [f"files: {summary['total_files']}", f"files with violations: {summary['files_with_violations']}", f"violations: {summary['total_violations']}"]
    lines += [f"  {k}: {v}" for k, v in sorted((summary["violations_by_type"] or {}).items())]
    lines += [v["message"] for v in violations] + [f["message"] for f in findings]
    return "\n".join([*lines, "PASS" if summary["success"] else "FAIL"]) + "\n"


def as_csv(rows: list[dict]) -> str:
    out = io.StringIO()
    if rows:
        w = csv.DictWriter(out, list(rows[0]), lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
    return out.getvalue()


def as_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    text = [[*rows[0]], *([f"{v:.2f}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows)]
    widths = [max(len(r[k]) for r in text) for k in range(len(text[0]))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in text) + "\n"


def write_snapshot(snapshot: dict, path: str, baseline: bool = False) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(snapshot, f, indent=2)
    if baseline:
        with open(f"{path.removesuffix('.json')}.baseline.json", "w", encoding="utf-8") as f:
            json.dump(snapshot, f, indent=2)


def compared(old: DataFrame, new: DataFrame) -> dict[str, DataFrame]:
    """What differs between two snapshots, as read by sources.code.snapshot: files, values and violations."""
    from tessera.sources.code import snapshot_values, snapshot_violations

    a, b = snapshot_values(old).withColumn("name", F.coalesce("name", F.lit(""))), snapshot_values(new).withColumn("name", F.coalesce("name", F.lit("")))
    values = snapshots.changed_values(a, b, "path", "name")
    va, vb = snapshot_violations(old), snapshot_violations(new)
    newly = snapshots.changed_violations(va, vb, "path", "metric", "name")
    score = values.filter(F.col("metric").isin("cyclomatic_complexity", "cognitive_complexity") & (F.col("name") != "")).groupBy("path", "name").agg(F.max_by("delta", F.abs("delta")).alias("delta"))
    fresh = newly.filter("change = 'added' AND name IS NOT NULL").select("path", "name").distinct().withColumn("newly", F.lit(True))
    scores = score.join(fresh, ["path", "name"], "full_outer").select("path", "name", F.coalesce("delta", F.lit(0.0)).alias("delta"), F.coalesce("newly", F.lit(False)).alias("newly"))
    paths = lambda s: s.select(F.explode("files.path").alias("path"))
    return {"files": snapshots.changed_keys(paths(old), paths(new), "path"), "values": values, "violations": newly, "regressions": snapshots.regressions(scores), "improvements": snapshots.improvements(scores)}
