"""Source trees, ignore files, coverage records, snapshots and configuration as tables."""

from __future__ import annotations

import fnmatch
import json
import os
import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.paths import ignored, language

GLOB = "*.{py,pyw,pyi,js,mjs,cjs,jsx,ts,tsx,mts,cts}"


def ignore_lines(root: str) -> list[str]:
    """The lines of a tree's .gitignore; none without one."""
    try:
        with open(os.path.join(root, ".gitignore"), encoding="utf-8") as f:
            return f.read().splitlines()
    except OSError:
        return []


def _braces(pattern: str) -> list[str]:
    """The plain patterns of one with alternatives in braces."""
    a, b = pattern.find("{"), pattern.find("}")
    return [pattern] if a < 0 or b < a else [x for y in pattern[a + 1 : b].split(",") for x in _braces(pattern[:a] + y + pattern[b + 1 :])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, at in zip(batch["path"].to_pylist(), batch["at"].to_pylist()):
            try:
                with open(at, "rb") as f:
                    content = f.read()
            except OSError:
                content = None
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])


def code_files(spark: SparkSession, root: str, ignore: Sequence[str] = (), include: Sequence[str] = (), use_gitignore: bool = True, pattern: str = GLOB, depth: int = 0, excludes: Sequence[str] = (), links: bool = True, also: Sequence[str] = ()) -> DataFrame:
    """(path, language, content) of the files of a tree in known languages, paths relative to it.

    Patterns of ignore and, unless told otherwise, the tree's .gitignore leave files out, before anything is read as
    text; those of include keep them in. depth, if not 0, bounds how many folders deep files lie. Content that isn't
    UTF-8 is null. Each file occurs once. Names are listed by the driver and read by the tasks, which must see the tree at
    the same place; a tree with a scheme (such as hdfs://) is listed by Spark, which leaves out names that begin with _
    or a dot. Code that is stored in tables needs neither: whatever takes files takes any table of path and content.
    """
    if "://" in root:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        base, known = root.rstrip("/"), found.select(F.expr(f"substring(path, length('{root.rstrip('/')}') + 2)").alias("path"), F.col("path").alias("at"), "content")
    else:
        base = os.path.abspath(root)
        names = [(os.path.relpath(os.path.join(d, n), base).replace(os.sep, "/"), os.path.join(d, n)) for d, _, ns in os.walk(base, followlinks=links) for n in ns if any(fnmatch.fnmatch(n, x) for x in _braces(pattern)) or also]
        if not links:
            names = [(n, at) for n, at in names if not os.path.islink(at)]
        known = spark.createDataFrame(names, "path string, at string")
    rules = [*ignore, *(ignore_lines(base) if use_gitignore else ())]
    named = F.element_at(F.split("path", "/"), -1).rlike("|".join(f"(?:{fnmatch.translate(x)})" for x in _braces(pattern)).replace("(?s:", "(?:").replace("\\z", "$").replace("\\Z", "$"))
    chosen = named & ~ignored(F.col("path"), rules, include)
    if excludes:
        chosen &= ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excludes)))
    if also:
        chosen |= F.col("path").isin(*also)
    files = known.filter(language(F.col("path")) != "unknown").filter(chosen)
    if depth:
        files = files.filter(F.size(F.split("path", "/")) - 1 < depth)
    if "://" not in root:
        files = files.repartition("path").mapInArrow(_read, "path string, content binary")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", language(F.col("path")).alias("language"), text.alias("content"))


def _coverage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch["file"].to_pylist():
            out = []
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                for context, file, bits in con.execute("SELECT c.context, f.path, b.numbits FROM line_bits b JOIN context c ON c.id = b.context_id JOIN file f ON f.id = b.file_id"):
                    test = context.split("|")[0]
                    if test:
                        out += [(test, file, 8 * k + j) for k, byte in enumerate(bits) for j in range(8) if byte >> j & 1]
            t, f, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(f, pa.string()), pa.array(n, pa.int32())], ["test", "file", "line"])


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """(test, file, line), distinct, of a coverage record with contexts; a folder stands for the record in it. The file
    must be where executors can read it."""
    if os.path.isdir(path):
        path = os.path.join(path, ".coverage")
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no coverage record at {path}")
    return spark.createDataFrame([(os.path.abspath(path),)], "file string").mapInArrow(_coverage, "test string, file string, line int").distinct()


SNAPSHOT = (
    "schema_version int, root string, files array<struct<path: string, language: string, error: string, metrics: map<string, double>, "
    "violations: array<struct<type: string, message: string, line_number: int, function: string, value: double, threshold: double, comparison: string>>, "
    "functions: array<struct<name: string, line: int, metrics: map<string, double>>>>>"
)


def snapshot(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row of a snapshot; without strict, none where the file is missing or isn't one."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if not isinstance(data, dict) or not isinstance(data.get("files"), list):
            raise ValueError(f"{path} isn't a snapshot")
    except (OSError, ValueError):
        if strict:
            raise
        return spark.createDataFrame([], SNAPSHOT)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    tidy = lambda m: {k: float(v) for k, v in m.items() if number(v)} if isinstance(m, dict) else {}
    files = []
    for x in data["files"]:
        if isinstance(x, dict) and isinstance(x.get("path"), str):
            functions = [{**f, "metrics": tidy(f.get("metrics"))} for f in x.get("functions") or () if isinstance(f, dict) and isinstance(f.get("name"), str)]
            violations = [v for v in x.get("violations") or () if isinstance(v, dict)]
            files.append({**x, "metrics": tidy(x.get("metrics")), "functions": functions, "violations": violations})
    line = json.dumps({"schema_version": data.get("schema_version"), "root": data.get("root"), "files": files})
    return spark.createDataFrame([(line,)], "line string").select(F.from_json("line", SNAPSHOT).alias("s")).select("s.*")


def snapshot_values(snap: DataFrame) -> DataFrame:
    """(path, name, metric, value) of a snapshot's files, name null, and functions."""
    files = snap.select(F.explode("files").alias("f"))
    own = files.select("f.path", F.lit(None).cast("string").alias("name"), F.explode("f.metrics").alias("metric", "value"))
    inner = files.select("f.path", F.explode("f.functions").alias("g")).select("path", "g.name", F.explode("g.metrics").alias("metric", "value"))
    return own.unionByName(inner)


def snapshot_violations(snap: DataFrame) -> DataFrame:
    """(path, metric, name) of a snapshot's violations."""
    return snap.select(F.explode("files").alias("f")).select("f.path", F.explode("f.violations").alias("v")).select("path", F.col("v.type").alias("metric"), F.col("v.function").alias("name"))


def worst_cyclomatic(snap: DataFrame) -> DataFrame:
    """(path, complexity): the greatest cyclomatic complexity of each file's functions, 0 where a function has none; the
    snapshot's root stands before paths."""
    files = snap.select("root", F.explode("files").alias("f")).select("root", "f.path", F.explode("f.functions").alias("g"))
    full = F.when(F.coalesce("root", F.lit("")).isin("", "."), F.col("path")).otherwise(F.concat("root", F.lit("/"), "path"))
    return files.groupBy(full.alias("path")).agg(F.max(F.coalesce(F.col("g.metrics")["cyclomatic_complexity"], F.lit(0.0))).alias("complexity"))


def config(path: str) -> dict:
    """A configuration in JSON or plain YAML (see settings.parsed)."""
    from tessera.sources.settings import parsed

    with open(path, encoding="utf-8") as f:
        return parsed(f.read())


def words(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list of words, by white space, packed with gzip or plain."""
    return spark.read.text(path).select(F.explode(F.split(F.lower(F.trim("value")), r"\s+")).alias("word")).filter("word <> ''").distinct()
