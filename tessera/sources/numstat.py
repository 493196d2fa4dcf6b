"""Logs of version control with counts of lines, as tables."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

MARK = "@@commit@@"


def parsed(logs: DataFrame, column: str, mark: str, *keys: str) -> DataFrame:
    """(keys, commit, seq, added, deleted, path) of logs: a line that begins with mark begins a commit; rows have three
    fields by tabs, and rows whose counts aren't numbers (binary files) are left out, as are commits without rows. commit
    counts the marks of a log from 1, seq rises with the lines."""
    commits = logs.select(*keys, F.posexplode(F.split(column, rf"(?m)^\Q{mark}\E.*$")).alias("commit", "body")).filter("commit > 0")
    lines = commits.select(*keys, "commit", F.posexplode(F.split("body", "\r?\n")).alias("nth", "line"))
    parts = lines.withColumn("p", F.split("line", "\t")).filter(F.size("p") == 3).filter(F.col("p")[0].rlike("^[0-9]+$") & F.col("p")[1].rlike("^[0-9]+$"))
    seq = F.col("commit").cast("long") * (1 << 32) + F.col("nth")
    return parts.select(*keys, F.col("commit").cast("long").alias("commit"), seq.alias("seq"), F.col("p")[0].cast("long").alias("added"), F.col("p")[1].cast("long").alias("deleted"), F.col("p")[2].alias("path"))


#: Commits of one row of a log.
RUN = 2_000


def git_log(spark: SparkSession, repository: str, days: int = 90) -> DataFrame:
    """numstat rows of the commits, merges left out, of a repository in the last days; none where git fails. The log is
    read line by line and handed over in runs of commits."""
    runs: list[tuple[int, str]] = []
    held: list[str] = []
    n = 0
    with subprocess.Popen(["git", "-C", repository, "log", f"--since={days} days ago", "--numstat", "--no-merges", f"--format={MARK}%H"], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as git:
        for line in git.stdout:
            if line.startswith(MARK):
                n += 1
                if n % RUN == 1 and held:
                    runs.append((len(runs), "".join(held)))
                    held = []
            held.append(line)
    if git.returncode:
        runs, held = [], []
    if held:
        runs.append((len(runs), "".join(held)))
    rows = parsed(spark.createDataFrame(runs, "run long, text string"), "text", MARK, "run")
    at = F.col("run") * RUN
    return rows.select((at + F.col("commit")).alias("commit"), (at * (1 << 32) + F.col("seq")).alias("seq"), "added", "deleted", "path")
