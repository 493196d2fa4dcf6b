"""Extraction of metric and fact rows from source files, one parse a file."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera import plugins
from tessera.functions.paths import is_test, language
from tessera.sources import cache
from tessera.sources.tables import cut

#: Names the analysers' state: raise it when what they give changes. Version of the entries of a cache.
FINGERPRINT, VERSION = "2", 1

METRIC = "metric string, value double, line int, function string, kind string, owner string, ord int"
IMPORT = "module string, names array<string>, level int, ord int"
CALLABLE = "name string, lineno int, is_method boolean, class_name string, call_names array<string>, computation_weight int, statements int, nesting int, returns_value boolean, return_annotation string, ord int"
CLASS = "name string, lineno int, bases array<string>, decorators array<string>, keywords array<string>, methods array<struct<name: string, decorators: array<string>, fields_read: array<string>, fields_written: array<string>, calls_local: array<string>>>, ord int"
CLONE = "name string, lineno int, end_lineno int, group_hash string, ord int"
ERROR = "message string, ord int"
KINDS = {"metrics": METRIC, "imports": IMPORT, "callables": CALLABLE, "classes": CLASS, "clones": CLONE, "errors": ERROR}


#: Files after which a task passes on their rows, so that it holds those of no more.
CHUNK = 200


def _runner(runners: dict, only: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # trees of files are many objects and short-lived: what stands is left out when Python looks for cycles
        gc.collect()
        gc.freeze()
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), CHUNK):
                batch = whole.slice(at, CHUNK)
                paths, texts, tests, langs = (batch[c].to_pylist() for c in ("path", "content", "_test", "language"))
                out: list[tuple] = []
                for path, text, test, lang in zip(paths, texts, tests, langs):
                    if text is None:
                        if only is None or "errors" in only:
                            out.append((path, lang, "errors", json.dumps({"message": "the file can't be read as text", "ord": 0})))
                        continue
                    out += [(path, lang, kind, json.dumps(r)) for kind, each in plugins.analyse(runners, lang, text, test, only).items() for r in each]
                columns = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "language", "kind_of_row", "payload"])

    return run


def spread(files: DataFrame, *by: str) -> DataFrame:
    """files, spread over tasks by count and not by bytes, as work on them outweighs their reading by far."""
    spark = files.sparkSession
    return files.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def extracted(files: DataFrame, runners: dict | None = None, only: Mapping[str, Sequence[str] | None] | None = None) -> DataFrame:
    """(path, language, kind_of_row, payload) of files (path, content): rows of every kind, as JSON. Files in languages
    that aren't known are left out before anything is parsed. A content of null is an error row; a repeated row of a
    file gives its rows again, so drop those first. runners are by language, plugins.RUNNERS by default. With only, every
    file is still parsed, but nothing found in it beyond those kinds of rows (and of metrics those names, None: all)."""
    known = files.select("path", "content").withColumn("language", language(F.col("path"))).filter("language <> 'unknown'").withColumn("_test", is_test(F.col("path")))
    if only is not None:
        only = {kind: None if names is None else frozenset(names) for kind, names in only.items()}
    return spread(known, "path").mapInArrow(_runner(plugins.RUNNERS if runners is None else runners, only), "path string, language string, kind_of_row string, payload string")


def rows(found: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind, typed, with path and language."""
    return found.filter(F.col("kind_of_row") == kind).select("path", "language", F.from_json("payload", KINDS[kind]).alias("p")).select("path", "language", "p.*")


def reported_errors(found: DataFrame) -> DataFrame:
    """(path, message): the errors, put together, of files that have no metric at all."""
    by = found.groupBy("path").agg(F.count_if(F.col("kind_of_row") == "metrics").alias("n"), F.array_sort(F.collect_list(F.when(F.col("kind_of_row") == "errors", F.get_json_object("payload", "$.message")))).alias("said"))
    return by.filter("n = 0 AND size(said) > 0").select("path", F.array_join("said", "; ").alias("message"))


class Extract:
    """All tables of some files, or those that only asks for. The extraction runs once; what is derived reads the table
    that it wrote. With a cache, a folder of earlier results by content, only files are parsed that it doesn't have; parsed
    is their number, and all of their tables are found."""

    def __init__(self, files: DataFrame, keep: bool = True, folder: str | None = None, runners: dict | None = None, fingerprint: str = FINGERPRINT, only: Mapping[str, Sequence[str] | None] | None = None):
        self.files = files.withColumn("language", language(F.col("path"))).filter("language <> 'unknown'")
        self.parsed: int | None = None
        self.only = None if folder is not None else only
        if folder is None:
            self.all = cut(extracted(files, runners, only)) if keep else extracted(files, runners, only)
            return
        # what is found in a file depends on whether it is a test, too
        kind = F.concat("language", F.when(is_test(F.col("path")), "|test").otherwise(""))
        keyed = cut(self.files.filter("content IS NOT NULL").select("path", "language", "content", cache.content_key(F.col("content"), fingerprint, kind).alias("content_key")))
        known = cache.read_entries(files.sparkSession, folder, VERSION)
        missing = keyed if known is None else cache.absent(keyed, known)
        one = cut(missing.dropDuplicates(["content_key"]).select("path", "content", "content_key"))
        self.parsed = one.count()
        rows_ = extracted(one, runners).groupBy("path").agg(F.collect_list(F.struct("kind_of_row", "payload")).alias("rows"))
        none = F.array().cast("array<struct<kind_of_row:string,payload:string>>")
        failed = F.transform(F.filter("rows", lambda r: r["kind_of_row"] == "errors"), lambda r: r["payload"])
        fresh = cut(one.select("path", "content_key").join(rows_, "path", "left").select("content_key", F.coalesce("rows", none).alias("rows")).withColumn("errors", failed))
        cache.put(fresh, folder, VERSION)
        every = fresh.select("content_key", "rows") if known is None else fresh.select("content_key", "rows").unionByName(known.select("content_key", "rows").join(keyed.select("content_key").distinct(), "content_key", "left_semi"))
        once = every.groupBy("content_key").agg(F.first("rows").alias("rows"))
        unreadable = extracted(self.files.filter("content IS NULL"), runners)
        self.all = cut(keyed.select("path", "language", "content_key").join(once, "content_key").select("path", "language", F.inline("rows")).unionByName(unreadable))

    def __getattr__(self, kind: str) -> DataFrame:
        if kind not in KINDS:
            raise AttributeError(kind)
        if self.only is not None and kind not in self.only:
            raise LookupError(f"{kind} weren't asked for")
        return rows(self.all, kind)
