"""Results by content: what is known already isn't computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PREFIX = 2


def content_key(content: Column, fingerprint: str, language: str | Column) -> Column:
    """SHA-256 over the fingerprint of the tools, the language and the content."""
    part = F.lit(language) if isinstance(language, str) else language
    return F.sha2(F.concat(F.lit("\x01"), F.lit(fingerprint), F.lit("\x01"), part, F.lit("\x01"), content.cast("string")), 256)


def misses(files: DataFrame, known: DataFrame, fingerprint: str, language: str) -> DataFrame:
    """The rows of files (content), with content_key, whose content isn't that of a row of known."""
    return absent(files.withColumn("content_key", content_key(F.col("content"), fingerprint, language)), known.select(content_key(F.col("content"), fingerprint, language).alias("content_key")))


def absent(files: DataFrame, entries: DataFrame) -> DataFrame:
    return files.join(entries.select("content_key").distinct(), "content_key", "left_anti")


def read_entries(spark: SparkSession, folder: str, version: int) -> DataFrame | None:
    """Entries of this version; None where the folder can't be read, which makes everything a miss."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(folder).filter(F.col("version") == version)
    except AnalysisException:
        return None


def put(entries: DataFrame, folder: str, version: int) -> None:
    """Adds entries (content_key, errors and others) without errors, in folders by the first characters of their keys. Files
    appear when the job commits, whole or not at all."""
    good = entries.filter(F.size(F.coalesce("errors", F.array().cast("array<string>"))) == 0)
    good.withColumn("version", F.lit(version)).withColumn("key_prefix", F.substring("content_key", 1, PREFIX)).write.mode("append").partitionBy("key_prefix").parquet(folder)


def clear(spark: SparkSession, folder: str) -> None:
    """Forgets all entries."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
