"""Maps and tables of a report: sizes of folders, how bad a value is, and what a page lists of functions and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.functions.paths import ancestors, folder
from tessera.operators.gates import worst

#: Rows of functions that a page lists.
LISTED = 50


def totals(files: DataFrame, least: float = 0) -> DataFrame:
    """(id, parent, label, value, is_folder) of files (path, value) of at least so much, and of all folders above them,
    with the sum of what lies below; the root "." has no parent."""
    own = files.filter(F.col("value") >= least).select("path", "value")
    leaves = own.select(F.col("path").alias("id"), folder(F.col("path")).alias("parent"), "value", F.lit(False).alias("is_folder"))
    sums = own.select(F.explode(ancestors(F.col("path"))).alias("id"), "value").groupBy("id").agg(F.sum("value").alias("value"))
    folders = sums.select("id", F.when(F.col("id") != ".", folder(F.col("id"))).alias("parent"), "value", F.lit(True).alias("is_folder"))
    return leaves.unionByName(folders).select("id", "parent", F.element_at(F.split("id", "/"), -1).alias("label"), "value", "is_folder")


def placed(nodes: DataFrame) -> DataFrame:
    """nodes with their place among those of one parent: the greatest value first, then by id."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("value"), "id")))


def badness(value: Column, threshold: Column, lower_is_worse: Column, scale: Column) -> Column:
    """Value by threshold, or threshold by value where less is worse (1.5 for nothing); without a threshold above 0, value
    by scale, and 0 without a scale either."""
    limited = F.when(lower_is_worse, F.when(value <= 0, 1.5).otherwise(threshold / value)).otherwise(value / threshold)
    return F.when(F.coalesce(threshold, F.lit(0.0)) > 0, limited).when(F.coalesce(scale, F.lit(0.0)) > 0, value / scale).otherwise(0.0)


def beyond(value: Column, threshold: Column, lower_is_worse: Column) -> Column:
    """True where a value is on the wrong side of a threshold above 0."""
    wrong = F.when(lower_is_worse, value < threshold).otherwise(value > threshold)
    return F.coalesce((threshold > 0) & wrong, F.lit(False))


def delta_scale(changes: DataFrame) -> DataFrame:
    """(metric, scale): the greatest change of each metric, whatever its sign."""
    return changes.groupBy("metric").agg(F.max(F.abs("delta")).alias("scale"))


def listed(functions: DataFrame, limit: int = LISTED) -> DataFrame:
    """The worst functions (path, name, cyclomatic, cognitive) that a page lists, with total, how many there are in all."""
    total = functions.agg(F.count_if(F.col("cyclomatic").isNotNull() | F.col("cognitive").isNotNull()).alias("total"))
    return worst(functions, limit).crossJoin(F.broadcast(total))


def located(functions: DataFrame, files: DataFrame) -> DataFrame:
    """functions (path and others) with here, whether the current files (path) still hold theirs."""
    now = files.select("path").distinct().withColumn("here", F.lit(True))
    return functions.join(now, "path", "left").withColumn("here", F.coalesce("here", F.lit(False)))


def by_column(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """rows in the order of a column, those without a value last either way."""
    return rows.orderBy(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))


def common_base(files: DataFrame) -> DataFrame:
    """One row (base): the deepest folder that holds all files (path); "." where that is the root, null without files."""
    at = F.split(folder(F.col("path")), "/")
    ends = files.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    # what the first and the last folder in order have in common, all have
    same = F.aggregate(F.arrays_zip("a", "b"), F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("go")), lambda acc, x: F.struct(F.when(acc["go"] & x["a"].eqNullSafe(x["b"]), F.concat(acc["parts"], F.array(x["a"]))).otherwise(acc["parts"]).alias("parts"), (acc["go"] & x["a"].eqNullSafe(x["b"])).alias("go")))["parts"]
    return ends.select(F.when(F.col("a").isNotNull(), F.when(F.size(same) == 0, ".").otherwise(F.array_join(same, "/"))).alias("base"))


def grouping_kind(keys: DataFrame, key: str) -> DataFrame:
    """One row (kind): directory where any key has a slash or is ".", else module."""
    return keys.agg(F.when(F.coalesce(F.max((F.col(key) == ".") | F.col(key).contains("/")), F.lit(False)), "directory").otherwise("module").alias("kind"))
