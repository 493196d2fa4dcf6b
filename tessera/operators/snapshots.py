"""Snapshots of a tree's metrics, and what differs between two.

A side of a comparison is two tables: values (path, name, metric, value), name null for files, and violations (path,
metric, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EPSILON = 0.01
#: Metrics that get worse by falling.
LOWER_IS_WORSE = ("maintainability_index",)


def changed_keys(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """keys and status (added, removed or common) of the keys of either side."""
    status = F.when(~F.col("_old"), "added").when(~F.col("_new"), "removed").otherwise("common")
    return _sides(old, new, *keys).select(*keys, status.alias("status"))


def _sides(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """keys, each once, with _old and _new: which sides have them; null keys are equal."""
    both = old.select(*keys, F.lit(True).alias("_o")).unionByName(new.select(*keys, F.lit(False).alias("_o")))
    return both.groupBy(*keys).agg(F.max("_o").alias("_old"), F.max(~F.col("_o")).alias("_new"))


def regressed(metric: Column, delta: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_WORSE), delta < 0).otherwise(delta > 0)


def changed_values(old: DataFrame, new: DataFrame, *keys: str, epsilon: float = EPSILON) -> DataFrame:
    """keys, metric, old, new, delta and regressed, of values on both sides that differ by more than epsilon."""
    on = [*keys, "metric"]
    both = old.select(*on, F.col("value").alias("old")).join(new.select(*on, F.col("value").alias("new")), on).filter("old IS NOT NULL AND new IS NOT NULL")
    out = both.withColumn("delta", F.col("new") - F.col("old")).filter(F.abs("delta") > epsilon)
    return out.withColumn("regressed", regressed(F.col("metric"), F.col("delta")))


def changed_violations(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """keys and change (added or removed) of violations on one side alone; null keys are equal."""
    return _sides(old, new, *keys).filter("NOT (_old AND _new)").select(*keys, F.when(F.col("_new"), "added").otherwise("removed").alias("change"))


def regressions(scores: DataFrame) -> DataFrame:
    """scores: path, name, delta, newly. The functions that are worse or newly violate, those first, then by falling
    delta, path and name, with their rank."""
    from tessera.operators.gates import ranked

    return ranked(scores.filter("newly OR delta > 0"), [F.desc("newly"), F.desc("delta"), F.asc("path"), F.asc("name")])


def improvements(scores: DataFrame) -> DataFrame:
    """The functions that are better and don't newly violate, the most first."""
    from tessera.operators.gates import ranked

    return ranked(scores.filter("NOT newly AND delta < 0"), [F.asc("delta"), F.asc("path"), F.asc("name")])


def nodes(files: DataFrame, value: str = "value") -> DataFrame:
    """(id, parent, label, value): a tree's folders and files (path, value) as an adjacency list; the root "." has no
    parent, a file's value is at least 1, a folder's is null."""
    from tessera.functions.paths import ancestors, folder

    leaves = files.groupBy("path").agg(F.max(value).alias("v"))
    leaf = leaves.select(F.col("path").alias("id"), folder(F.col("path")).alias("parent"), F.element_at(F.split("path", "/"), -1).alias("label"), F.coalesce(F.nullif("v", F.lit(0)), F.lit(1)).cast("double").alias("value"))
    inner = leaves.select(F.explode(ancestors(F.col("path"))).alias("id")).distinct()
    named = F.when(F.col("id") == ".", F.lit(".")).otherwise(F.element_at(F.split("id", "/"), -1))
    return leaf.unionByName(inner.select("id", F.when(F.col("id") != ".", folder(F.col("id"))).alias("parent"), named.alias("label"), F.lit(None).cast("double").alias("value")))
