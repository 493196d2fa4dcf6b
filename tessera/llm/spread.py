"""Copies of rows, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Copies that one task makes of a row at most.
BLOCK = 10_000


def repeated(df: DataFrame, times: Column, most: int, name: str = "_copy") -> DataFrame:
    """Each row of df as often as times says, at most ``most``, with a column name that counts from 0. Where a row may
    have more copies than ``BLOCK``, they are made block by block, and the blocks are shuffled."""
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    if most <= BLOCK:
        return df.filter(times > 0).withColumn(name, F.explode(upto(times)))
    blocks = df.filter(times > 0).withColumn("_times", times.cast("long")).withColumn("_block", F.explode(upto(F.ceil(F.col("_times") / BLOCK))))
    blocks = blocks.withColumn("_place", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))).repartition("_place")
    mine = F.least(F.lit(BLOCK).cast("long"), F.col("_times") - F.col("_block") * BLOCK)
    return blocks.withColumn("_nth", F.explode(upto(mine))).withColumn(name, F.col("_block") * BLOCK + F.col("_nth")).drop("_times", "_block", "_place", "_nth")
