"""Statistics of metric rows: over all files, by folder, by package, and for maps of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.paths import ancestors

PREFIXES = {
    "loc": ("lines_of_code", "source_lines_of_code", "logical_lines_of_code", "blank_lines", "comment_lines"),
    "cyc": ("cyclomatic_complexity",), "cog": ("cognitive_complexity",), "mai": ("maintainability_index",),
    "hal": ("halstead_bugs", "halstead_difficulty", "halstead_effort", "halstead_time", "halstead_volume"),
}


def wanted(names: list[str], known: list[str]) -> tuple[list[str], list[str]]:
    """(metrics, names that mean none) for a list of metrics and prefixes; all metrics for "all", lines for no names."""
    out, unknown = [], []
    for n in names or ["loc"]:
        found = known if n == "all" else PREFIXES.get(n) or ([n] if n in known else [])
        out += [m for m in found if m not in out]
        if not found:
            unknown.append(n)
    return out, unknown


def spread(x: Column) -> Column:
    """Sample standard deviation; 0 for one value."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def by_metric(metrics: DataFrame, *keys: str) -> DataFrame:
    """count, avg, min, max and std of value by metric and keys."""
    v = F.col("value")
    return metrics.groupBy(*keys, "metric").agg(F.count(v).alias("n"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), spread(v).alias("std"))


def overall(metrics: DataFrame) -> DataFrame:
    """One row: files, functions, and the lines of files that have any (sum, mean, extremes, deviation)."""
    loc = F.when((F.col("metric") == "lines_of_code") & (F.col("value") > 0), F.col("value"))
    cyc = F.when((F.col("metric") == "cyclomatic_complexity") & F.col("function").isNotNull(), F.col("value"))
    return metrics.agg(
        F.count_distinct("path").alias("files"), F.count_distinct("path", "function").alias("functions"),
        F.sum(loc).alias("total_loc"), F.avg(loc).alias("avg_loc"), F.min(loc).alias("min_loc"), F.max(loc).alias("max_loc"), spread(loc).alias("std_loc"),
        F.avg(cyc).alias("avg_cyc"), F.min(cyc).alias("min_cyc"), F.max(cyc).alias("max_cyc"),
    )


def by_folder(files: DataFrame, values: dict[str, str]) -> DataFrame:
    """files, and total_ and avg_ of each value, for every folder and all that lies under it, the root "." first."""
    each = files.withColumn("folder", F.explode(ancestors(F.col("path"))))
    aggs = [a for n, c in values.items() for a in (F.sum(c).alias(f"total_{n}"), F.avg(c).alias(f"avg_{n}"))]
    return each.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), *aggs)


def greatest_by_folder(files: DataFrame, value: str) -> DataFrame:
    """(folder, files, total, greatest, path): sum and greatest value under each folder, with its path, the first of equals."""
    each = files.withColumn("folder", F.explode(ancestors(F.col("path"))))
    best = F.min(F.struct((-F.col(value)).alias("less"), F.col("path").alias("path")))
    out = each.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum(value).alias("total"), F.max(value).alias("greatest"), best.alias("b"))
    return out.select("folder", "files", "total", "greatest", F.col("b.path").alias("path"))


def by_package(files: DataFrame, package: str, values: dict[str, str]) -> DataFrame:
    """files, and total_ and avg_ of each value, by package."""
    aggs = [a for n, c in values.items() for a in (F.sum(c).alias(f"total_{n}"), F.avg(c).alias(f"avg_{n}"))]
    return files.groupBy(package).agg(F.count(F.lit(1)).alias("files"), *aggs)


def functions_of(metrics: DataFrame, *keys: str) -> DataFrame:
    """Least line and last value (by ord) of each function's metrics: keys, line and a column values, a map by metric."""
    last = metrics.groupBy(*keys, "metric").agg(F.min("line").alias("line"), F.max_by("value", "ord").alias("value"))
    return last.groupBy(*keys).agg(F.min("line").alias("line"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("values"))


def coverage_by_language(metrics: DataFrame) -> DataFrame:
    """(language, metrics): the metrics that occur in each language, sorted and joined by commas."""
    return metrics.groupBy("language").agg(F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"))


def ninth_decile(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The value at place min(n - 1, floor(0.9 n)), from 0, of the sorted ones, as p90."""
    from pyspark.sql.window import Window

    by = Window.partitionBy(*keys)
    placed = rows.filter(F.col(value).isNotNull()).withColumn("_at", F.row_number().over(by.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(by))
    return placed.filter(F.col("_at") == F.least(F.col("_n") - 1, F.expr("_n * 9 div 10"))).select(*keys, F.col(value).alias("p90"), F.col("_n").alias("n"))


def fan_out(files: DataFrame) -> DataFrame:
    """(folder, modules, folders, children): what lies in each folder itself; __init__ and __main__ aren't modules."""
    up = files.withColumn("a", ancestors(F.col("path"))).withColumn("name", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    own = up.filter(~F.col("name").isin("__init__", "__main__")).groupBy(F.element_at("a", -1).alias("folder")).agg(F.count(F.lit(1)).alias("modules"))
    pairs = up.select(F.explode(F.arrays_zip(F.slice("a", 1, F.size("a") - 1).alias("folder"), F.slice("a", 2, F.size("a")).alias("child"))).alias("p")).select("p.folder", "p.child").distinct()
    inner = pairs.groupBy("folder").agg(F.count(F.lit(1)).alias("folders"))
    every = up.select(F.explode("a").alias("folder")).distinct()
    out = every.join(own, "folder", "left").join(inner, "folder", "left").na.fill(0, ["modules", "folders"])
    return out.withColumn("children", F.col("modules") + F.col("folders"))
