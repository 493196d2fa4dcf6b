"""Quality by the likelihood ratio of hashed n-grams between a trusted part and the whole of a corpus.

Words and pairs of words are hashed to buckets, as many as keep a bucket to ``hashed.LOAD`` distinct ones. One
multinomial is counted over the trusted documents (quality 1 and not toxic), another over all documents. A document's
score is the mean log ratio of its n-grams, with ``PRIOR`` neutral ones added so that a few words decide nothing. A fifth
of the trusted documents, by a hash of doc_id, stays out of the trusted counts; the threshold is the score that all but
``REJECT`` of them reach. Words of toxic labelled documents reject a document apart from this, by their sum
(``toxicity``). Labels are sent to where the texts are, so that these don't move.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm import hashed, toxicity
from tessera.llm import textvec as tv
from tessera.sources.tables import cut

PRIOR, REJECT, SMOOTHING = 20.0, 0.005, 1.0


def _count(bits: int, k: int):
    def run(batches: hashed.Batches) -> hashed.Batches:
        tally = hashed.Tally(2)
        for batch in batches:
            for _, _, raw, offs in tv.chunks(batch["text"]):
                tally.add(k, hashed.buckets(raw, offs, bits)[1])
                yield from tally.rows()
        yield from tally.rows(last=True)

    return run


def log_ratios(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    """Log ratio of the two multinomials, trusted to all, by bucket; 0 everywhere if nothing is trusted."""
    if not totals[1]:
        return np.zeros(len(counts))
    p, q = counts[:, 1] + SMOOTHING, counts[:, 0] + SMOOTHING
    return np.log(p / (totals[1] + SMOOTHING * size)) - np.log(q / (totals[0] + SMOOTHING * size))


class Model(NamedTuple):
    """Log ratios by bucket, the bits of a bucket, the weights of toxic words, and both thresholds."""

    weights: Broadcast
    bits: int
    words: toxicity.Lexicon
    line: float = 0.0
    toxic_line: float = 0.0

    def keep(self) -> Column:
        return (F.col("_score") >= self.line) & (F.col("_toxic") <= self.toxic_line)


def _scorer(model: Model, column: str):
    score, words = hashed.normalised(model.weights, model.bits, PRIOR), model.words

    def run(batches: hashed.Batches) -> hashed.Batches:
        for batch in batches:
            text = batch[column]
            keep = [n for n in batch.schema.names if n != column or column != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in keep), hashed.nullable(hashed.per_text(score, text)), pa.array(toxicity.score(words, text))], [*keep, "_score", "_toxic"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """With no trusted documents, ratios of 0 and a threshold of 0."""
    key, label_key = hashed.keys(docs, labels)
    mine = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    marks = labels.groupBy(label_key.alias("label_id")).agg(F.max(good).alias("trusted"), F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).alias("toxic"))
    known = hashed.labelled(mine, marks.filter("trusted OR toxic IS NOT NULL"))
    train, held = (known.filter(x) for x in (~hashed.holdout(F.col("key")), hashed.holdout(F.col("key")) & F.col("trusted")))
    bits = hashed.bits(mine)
    counts = mine.select("text").mapInArrow(_count(bits, 0), hashed.COUNTS).unionByName(train.filter("trusted").select("text").mapInArrow(_count(bits, 1), hashed.COUNTS))
    weights = hashed.weighed(hashed.summed(counts, 2), 2, bits, lambda c, n: log_ratios(c, n, 1 << bits))
    model = Model(docs.sparkSession.sparkContext.broadcast(weights), bits, toxicity.lexicon(train))
    of_held = cut(held.select(F.lit(0).alias("row"), F.col("text").alias("_text")).mapInArrow(_scorer(model, "_text"), "row int, _score double, _toxic double"))
    return model._replace(line=min(0.0, hashed.quantile(of_held.filter("NOT isnan(_score)"), "_score", REJECT)), toxic_line=toxicity.line(of_held, "_toxic"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, keep) of every document.

    keep is score >= threshold, and no more toxic words than good documents held out have. A null, empty or white text has
    a null score and isn't kept. Without trusted labels all others have score 0 and are kept. Ids are numbers or text;
    where only one table has numbers, they are compared as text. Labels that are null or refer to no document count for nothing; repeated rows
    count as often as they occur and have equal results; other columns play no part. Texts are read whole.
    """
    model = fit(docs, labels)
    mine = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("_text"))
    out = mine.mapInArrow(_scorer(model, "_text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _score double, _toxic double")
    return out.select("doc_id", F.round("_score", 9).alias("score"), F.coalesce(model.keep(), F.lit(False)).alias("keep"))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that scored() keeps, with all their columns."""
    model = fit(docs, labels)
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    schema = T.StructType(plain.schema.fields + T.StructType().add("_score", "double").add("_toxic", "double").fields)
    return plain.mapInArrow(_scorer(model, names["text"]), schema).filter(model.keep()).select(*(F.col(n).alias(c) for c, n in names.items()))
