"""Words that mark a document as toxic, learned from labels.

A document's words, without case and marks, count once each. A word that at least ``COUNT`` toxic labelled documents hold,
and ``SHARE`` of them, and that is ``LIFT`` times as frequent among them as among those labelled not toxic, weighs the log
of that ratio. A document's score is the sum over its words, so that other words, however many, take nothing away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import hashed
from tessera.llm import textvec as tv

#: Least number and share of the toxic documents that hold a word, least ratio, and share of good documents given up.
COUNT, SHARE, LIFT, REJECT = 10, 0.001, 20.0, 0.005
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32

Lexicon = tuple[np.ndarray, np.ndarray]


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, bounds = tv.words(_PLAIN[raw], offs)
    return tv.owners(bounds), h.view(np.int64)


def _documents(only: np.ndarray | None):
    """How many texts of a batch hold each word, or each of some sorted words."""

    def run(batches: hashed.Batches) -> hashed.Batches:
        for batch in batches:
            for _, _, raw, offs in tv.chunks(batch["text"]):
                own, h = _words(raw, offs)
                if only is not None:
                    inside = np.isin(h, only)
                    own, h = own[inside], h[inside]
                order = np.lexsort((own, h))
                own, h = own[order], h[order]
                first = np.append(True, (np.diff(h) != 0) | (np.diff(own) != 0))[: len(h)]
                u, c = np.unique(h[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], ["word", "n"])

    return run


def lexicon(labelled: DataFrame) -> Lexicon:
    """Sorted word hashes and their weights, from rows (text, toxic); none where either class lacks labels."""
    of = {k: labelled.filter(F.col("toxic") == k).select("text") for k in (0, 1)}
    total = {k: df.count() for k, df in of.items()}
    if not total[0] or not total[1]:
        return np.zeros(0, np.int64), np.zeros(0)
    held = lambda k, only: of[k].mapInArrow(_documents(only), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    bad = held(1, None).filter(F.col("n") >= max(COUNT, SHARE * total[1])).toPandas().sort_values("word")
    words, n = bad["word"].to_numpy(np.int64), bad["n"].to_numpy(np.float64)
    clean = held(0, words).toPandas()
    m = np.zeros(len(words))
    m[np.searchsorted(words, clean["word"].to_numpy(np.int64))] = clean["n"]
    weights = np.log((n + 0.5) / (total[1] + 1)) - np.log((m + 0.5) / (total[0] + 1))
    sure = weights >= np.log(LIFT)
    return words[sure], weights[sure]


def score(mine: Lexicon, column: pa.Array) -> np.ndarray:
    """The weights of the distinct words of each text, summed."""
    words, weights = mine
    if not len(words):
        return np.zeros(len(column))

    def run(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        own, h = _words(raw, offs)
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        pairs = np.unique(own[hit] * len(words) + at[hit])
        return np.bincount(pairs // len(words), weights[pairs % len(words)], minlength=len(offs) - 1).astype(np.float64)

    return hashed.per_text(run, column)


def line(good: DataFrame, column: str) -> float:
    """The score that at most REJECT of good documents exceed."""
    return -min(0.0, hashed.quantile(good.select((-F.col(column)).alias("s")), "s", REJECT))
