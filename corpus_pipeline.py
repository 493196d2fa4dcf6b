"""A corpus prepared by five operators in turn.

Each stage takes the session, the documents that its predecessor kept and the folder of the tables, and works on all of
them: documents that the likelihood ratio rejects go, one document of each group of near duplicates stays, repeated
passages are removed, sources are mixed to their weights, and what is left is segmented into subword pieces. The first
four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import minhash_dedup, mixing, quality_rules, subwords, suffix_dedup
from tessera.sources.tables import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that op10 keeps: rejected ones go, others stay as they are. Nulls, empty texts and ties as in quality_rules.scored."""
    return quality_rules.filtered(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each of op7's groups; rows without id or words stay. Ties as in minhash_dedup.dedup_near."""
    return minhash_dedup.dedup_near(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words removed from text (op1); a document of nothing else goes. Odd rows as in suffix_dedup.dedup_passages."""
    return suffix_dedup.dedup_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as op3's budgets take them. Nulls, empty sources and ties as in mixing.sampled."""
    return mixing.mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, decoded again (op9). Odd rows as in subwords.sampled."""
    return subwords.sampled(docs)


STAGES: list = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", mixture),
    ("SentencePiece", pieces),
]
#: Hashed counts, minwise signatures and sampled lattices are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; each stage's are written as Parquet to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
