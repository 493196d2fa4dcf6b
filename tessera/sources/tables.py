"""Tables in a folder, and the cutting of lineage."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's spark.checkpoint.dir. Where none is set, a local session gets a
    temporary folder; a cluster has none that all its machines see, so that there it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder, so that a lost executor costs no more
    than its running tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows that a task holds at once where it groups or sorts rows that don't become fewer by it.
TASK_ROWS = 1_000_000


def by_rows(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many parts as hold TASK_ROWS each, if none of the keys has more, so that what a task holds doesn't
    grow with the table. Its rows are counted first."""
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(few, math.ceil(df.count() / TASK_ROWS)), *keys)


#: Rows of one key from which on a join sends what it meets to all tasks.
MANY_ROWS = 100_000


def joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with other by keys of which some may have very many rows, while other has few for each: what those meet
    is sent to all tasks, so that no task gets all rows of a key. There are fewer such keys than rows by MANY_ROWS."""
    many = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MANY_ROWS).select(*keys))
    if many.isEmpty():
        return rows.join(other, keys)
    met = cut(other.join(F.broadcast(many), keys, "left_semi"))
    return rows.join(F.broadcast(met), keys).unionByName(rows.join(F.broadcast(many), keys, "left_anti").join(other, keys))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to a folder of its own in the checkpoint folder and read again."""
    folder = f"{shared_folder(df.sparkSession)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
