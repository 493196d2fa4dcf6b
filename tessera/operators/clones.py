"""Groups of equal functions, and what share of each file they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def clone_groups(units: DataFrame, least: int = 2) -> DataFrame:
    """units (group_hash and other columns) of groups of at least so many, with the group's size n."""
    groups = units.groupBy("group_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return units.join(groups, "group_hash")


def duplication(clones: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, lines, ratio): lines of clones (path, lineno, end_lineno) in each file, and their share, 1 at most, of its
    source lines (path, sloc); 0 where those aren't known."""
    lines = clones.groupBy("path").agg(F.sum(F.col("end_lineno") - F.col("lineno") + 1).alias("lines"))
    share = F.when(F.coalesce("sloc", F.lit(0)) > 0, F.least(F.col("lines") / F.col("sloc"), F.lit(1.0))).otherwise(0.0)
    return lines.join(sizes, "path", "left").select("path", "lines", share.alias("ratio"))
