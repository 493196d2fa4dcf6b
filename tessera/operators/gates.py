"""Thresholds: which metric rows violate them, how that reads, and what a run comes to.

metrics: path, language, metric, value double, line int, function string, and, where known, details type.
thresholds: language, metric, threshold double, comparison, enabled boolean, ord int.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.tables import cut

#: Metrics whose function rows inform and aren't gated.
UNGATED = ("halstead_bugs", "halstead_difficulty", "halstead_effort", "halstead_time", "halstead_volume")
#: Thresholds where a language has no block of its own: metric, threshold, comparison.
DEFAULTS = (
    ("cyclomatic_complexity", 10.0, "<="), ("maintainability_index", 50.0, ">="), ("halstead_volume", 1000.0, "<="),
    ("halstead_difficulty", 10.0, "<="), ("halstead_effort", 10000.0, "<="), ("cognitive_complexity", 15.0, "<="),
)
#: Bounds within which a threshold of a command line must lie.
BOUNDS = {
    "cyclomatic_complexity": (1, 50), "maintainability_index": (0, 100), "halstead_volume": (0, 100_000),
    "halstead_difficulty": (0, 100), "halstead_effort": (0, 1_000_000), "cognitive_complexity": (1, 100),
}
_SHORT = {
    "cog": "cognitive_complexity", "cyc": "cyclomatic_complexity", "dif": "halstead_difficulty",
    "eff": "halstead_effort", "mai": "maintainability_index", "vol": "halstead_volume",
}
SCHEMA = "language string, metric string, threshold double, comparison string, enabled boolean, ord int"


def thresholds(spark: SparkSession, rows: list[tuple] | None = None, languages: tuple = ("python", "javascript", "typescript")) -> DataFrame:
    """A table of thresholds: the given rows, and the defaults for languages that have none."""
    rows = list(rows or ())
    have = {r[0].lower() for r in rows}
    rows = [(r[0].lower(), *r[1:]) for r in rows]
    rows += [(x, m, t, c, True, -1) for x in languages if x not in have for m, t, c in DEFAULTS]
    return spark.createDataFrame(rows, SCHEMA)


def parse_threshold(text: str) -> tuple[str, float]:
    """(metric, threshold) of "name=value", where name may be a metric's short form."""
    name, _, value = text.partition("=")
    name = name.strip().lower()
    metric = _SHORT.get(name, name)
    if not value or metric not in BOUNDS:
        raise ValueError(f"{text!r} isn't metric=value; metrics: {', '.join(sorted(BOUNDS))}")
    low, high = BOUNDS[metric]
    number = float(value)
    if not low <= number <= high:
        raise ValueError(f"{metric} must be from {low} to {high}, not {number:g}")
    return metric, number


def violates(value: Column, threshold: Column, comparison: Column) -> Column:
    """True where value comparison threshold doesn't hold."""
    holds = {"<": value < threshold, "<=": value <= threshold, ">": value > threshold, ">=": value >= threshold, "==": value == threshold, "!=": value != threshold}
    out = F.lit(False)
    for sign, condition in holds.items():
        out = F.when(comparison == sign, ~condition).otherwise(out)
    return F.coalesce(out, F.lit(False))


def violations(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """The rows of metrics that violate the last enabled threshold of their language and metric, with threshold and
    comparison. Function rows of ``UNGATED`` metrics don't count."""
    last = limits.groupBy("language", "metric").agg(F.max_by(F.struct("threshold", "comparison", "enabled"), "ord").alias("t")).filter("t.enabled")
    last = last.select("language", "metric", "t.threshold", "t.comparison")
    gated = metrics.filter(~(F.col("function").isNotNull() & F.col("metric").isin(*UNGATED))) if "function" in metrics.columns else metrics
    return gated.join(last, ["language", "metric"]).filter(violates(F.col("value"), F.col("threshold"), F.col("comparison")))


def message(path: Column, line: Column, function: Column, metric: Column, value: Column, threshold: Column, comparison: Column) -> Column:
    """How a violation reads: place, metric, value and threshold."""
    at = F.when(F.coalesce(line, F.lit(0)) != 0, F.concat(F.lit(":"), line.cast("string"))).otherwise("")
    of = F.when(F.coalesce(function, F.lit("")) != "", F.concat(F.lit(" ("), function, F.lit(")"))).otherwise("")
    return F.concat(path, at, of, F.lit(": "), F.initcap(F.replace(metric, F.lit("_"), F.lit(" "))), F.lit(" is "), F.format_string("%.2f", value), F.lit(" (threshold: "), comparison, F.lit(" "), threshold.cast("string"), F.lit(")"))


def summary(files: DataFrame, found: DataFrame, project: DataFrame | None = None) -> DataFrame:
    """One row of what a run comes to. files: path, language, one row each; found: violations of files; project: those of
    other subjects, which count among all violations but not among files."""
    languages = files.groupBy("language").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "count")))).alias("files_by_language")
    )
    # one pass over the violations, by metric and file; what is left is small
    every = found.select("metric", "path", F.lit(True).alias("of_file"))
    if project is not None:
        every = every.unionByName(project.select("metric", "path", F.lit(False).alias("of_file")))
    counted = cut(every.groupBy("metric", "path", "of_file").count())
    hit = counted.agg(F.count_distinct(F.when(F.col("of_file"), F.col("path"))).alias("files_with_violations"))
    types = counted.groupBy("metric").agg(F.sum("count").alias("count")).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_violations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "count")))).alias("violations_by_type"))
    # each has one row
    out = languages.crossJoin(hit).crossJoin(types).select("total_files", "files_with_violations", "total_violations", "violations_by_type", "files_by_language")
    return out.withColumn("success", F.col("total_violations") == 0)


def worst(functions: DataFrame, limit: int = 20) -> DataFrame:
    """Functions (path, name, cyclomatic, cognitive) ranked by the greater of their two scores, then by path and name;
    those without either are left out. A limit of 0 or less means all."""
    score = F.greatest("cyclomatic", "cognitive")
    order = [F.desc("score"), F.asc("path"), F.asc("name")]
    out = functions.withColumn("score", score).filter("score IS NOT NULL")
    if limit > 0:
        out = out.orderBy(*order).limit(limit)
        from pyspark.sql.window import Window

        return out.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of what a report shows
    return ranked(out, order)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """rows with their rank by order, equals in any order: sorted by ranges, each of which knows how many come before."""
    from pyspark.sql.window import Window

    placed = cut(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    # a row a range, of which there are as many as tasks
    return placed.join(F.broadcast(sizes.drop("count")), "_range").withColumn("rank", (nth + F.col("_before")).cast("int")).drop("_range", "_before")
