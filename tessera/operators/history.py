"""What a version history and a coverage record tell: churn, change coupling, the suite's share, and its redundancy.

numstat: commit, seq, added long, deleted long, path. coverage: test, file, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.functions.paths import is_test
from tessera.sources.tables import by_rows, cut

SUPPORT = 3


def churn(numstat: DataFrame) -> DataFrame:
    """(path, churn, commits, first): lines added and deleted, commits that touch it, and where it appears first."""
    lines = (F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).cast("long")
    return numstat.groupBy("path").agg(F.sum(lines).alias("churn"), F.count_distinct("commit").alias("commits"), F.min("seq").alias("first"))


def top_churn(numstat: DataFrame, limit: int = 20) -> DataFrame:
    """The paths of most churn; of equals, those that appear first."""
    return churn(numstat).orderBy(F.desc("churn"), "first", "path").limit(limit)


def change_coupling(numstat: DataFrame, least: int = SUPPORT, key: str = "path") -> DataFrame:
    """(a, b, support, confidence): pairs of paths that change in the same commits, at least so often; confidence is by
    the path that changes less. Commits are joined with themselves, so one of n paths gives n (n - 1) / 2 pairs; paths of
    fewer than ``least`` commits can't be in a pair and are left out first."""
    touched = by_rows(numstat.select("commit", F.col(key).alias("path")).filter("path IS NOT NULL"), "commit", "path").distinct()
    often = touched.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # a table of its own, so that both sides are plain shuffles and the join can split a commit of many paths
    live = cut(by_rows(cut(touched.join(often, "path").select("commit", "path", "n")), "commit"))
    a, b = live.select("commit", F.col("path").alias("a"), F.col("n").alias("na")), live.select("commit", F.col("path").alias("b"), F.col("n").alias("nb"))
    # hardly any pair occurs twice in a task, so they are spread by pair before they are counted
    pairs = by_rows(cut(a.hint("merge").join(b, "commit").filter("a < b").select("a", "b", "na", "nb")), "a", "b")
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least)
    return pairs.select("a", "b", "support", (F.col("support") / F.least("na", "nb")).alias("confidence"))


def hotspots(changed: DataFrame, complexity: DataFrame) -> DataFrame:
    """(path, churn, complexity, hotspot): churn times the greatest complexity, of paths that have both."""
    return changed.join(complexity, "path").select("path", "churn", "complexity", (F.col("churn") * F.col("complexity")).alias("hotspot"))


def suite_health(numstat: DataFrame, test: Column | None = None) -> DataFrame:
    """One row: lines changed in tests by those changed elsewhere (0 without any), and the median number of test files
    in commits that touch other files (null without such commits)."""
    mine = numstat.withColumn("t", is_test(F.col("path")) if test is None else test).withColumn("n", F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0)))
    by = mine.groupBy("commit").agg(F.count_distinct(F.when(F.col("t"), F.col("path"))).alias("tests"), F.count_if(~F.col("t")).alias("others"), F.sum(F.when(F.col("t"), F.col("n")).otherwise(0)).alias("tn"), F.sum(F.when(F.col("t"), 0).otherwise(F.col("n"))).alias("sn"))
    out = by.agg(F.sum("tn").alias("tn"), F.sum("sn").alias("sn"), F.median(F.when(F.col("others") > 0, F.col("tests"))).alias("multiplicity"))
    return out.select(F.when(F.coalesce("sn", F.lit(0)) == 0, 0.0).otherwise(F.col("tn") / F.col("sn")).alias("test_churn_ratio"), "multiplicity")


def unique_coverage(coverage: DataFrame) -> DataFrame:
    """(test, lines, unique_lines, ratio): lines that each test covers, and those that no other does."""
    # by line, so that its tests are seen together; what is left by test is small
    cells = by_rows(coverage.select("test", "file", "line"), "file", "line").distinct()
    alone = F.count(F.lit(1)).over(Window.partitionBy("file", "line")) == 1
    by = cells.withColumn("alone", alone).groupBy("test").agg(F.count(F.lit(1)).alias("lines"), F.count_if("alone").alias("unique_lines"))
    return by.withColumn("ratio", F.col("unique_lines") / F.col("lines"))


def blast_radius(coverage: DataFrame) -> DataFrame:
    """(file, tests): how many tests run each file."""
    return coverage.groupBy("file").agg(F.count_distinct("test").alias("tests"))


def redundancy(coverage: DataFrame, cover: DataFrame) -> DataFrame:
    """One row: tests, those that a greedy cover takes, and 1 less their ratio; 0 without tests."""
    return coverage.agg(F.count_distinct("test").alias("tests")).crossJoin(cover.agg(F.count(F.lit(1)).alias("chosen"))).withColumn("redundancy", F.when(F.col("tests") == 0, 0.0).otherwise(1 - F.col("chosen") / F.col("tests")))
