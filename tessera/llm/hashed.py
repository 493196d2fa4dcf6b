"""Hashed n-gram counts of texts, gathered by class over whole tables."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.llm import textvec as tv
from tessera.sources.tables import cut

Batches = Iterator[pa.RecordBatch]

#: Fewest bits of a bucket, and n-grams a bucket at most: buckets grow with the distinct n-grams, so that the load of a
#: bucket lies between half of LOAD and LOAD from 2 ** BITS * LOAD / 2 n-grams on.
BITS, LOAD = 16, 32
BUCKETS = 1 << BITS
#: Of the n-grams, those whose low bits are 0 are told apart to count how many there are.
_SAMPLE = 8
#: Buckets of one row of counts; entries of a task's counts that wait to be put together; buckets up to which weights have 8 bytes.
_PART, _WAIT, _EXACT = 1 << 16, 1 << 22, 1 << 20
COUNTS = "part long, n long, keys binary, counts binary"


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word and each pair of neighbouring words."""
    _, _, h, bounds = tv.words(raw, offs)
    own, pairs = tv.owners(bounds), tv.ngrams(h, 2)
    inside = own[: len(pairs)] == own[1:]
    texts = np.concatenate([own, own[:-1][inside] if len(own) else own])
    return texts, np.concatenate([tv.mix(h), pairs[inside]])


def buckets(raw: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word and each pair of neighbouring words."""
    texts, h = grams(raw, offs)
    return texts, (h >> np.uint64(64 - bits)).astype(np.int64)


def _sampled(batches: Batches) -> Batches:
    for batch in batches:
        for _, _, raw, offs in tv.chunks(batch["text"]):
            _, h = grams(raw, offs)
            h = np.unique(h[(h & np.uint64((1 << _SAMPLE) - 1)) == 0])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["gram"])


def bits(docs: DataFrame) -> int:
    """Bits of a bucket for the distinct n-grams of the column text."""
    n = docs.select("text").mapInArrow(_sampled, "gram long").distinct().count() << _SAMPLE
    return max(BITS, math.ceil(math.log2(max(n, 1) / LOAD)))


#: Labels up to which they are sent to all executors; beyond it texts are shuffled to them.
SENT_LABELS = 2_000_000


def keys(docs: DataFrame, labels: DataFrame, name: str = "doc_id") -> tuple[Column, Column]:
    """The ids of both tables as what they can be compared by: numbers where both hold whole numbers, else text."""
    whole = all(isinstance(df.schema[name].dataType, T.IntegralType) for df in (docs, labels))
    return F.col(name).cast("long" if whole else "string"), F.col(name).cast("long" if whole else "string")


def _sent(marks: DataFrame) -> DataFrame:
    return F.broadcast(marks) if marks.count() <= SENT_LABELS else marks.hint("merge")


def labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of docs with the marks of their key, which marks call label_id; kept in the checkpoint folder."""
    return cut(docs.join(_sent(marks), F.col("key") == F.col("label_id")))


def unlabelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of docs whose key has no marks."""
    return docs.join(_sent(marks.select("label_id")), F.col("key") == F.col("label_id"), "left_anti")


def holdout(key: Column, parts: int = 5) -> Column:
    """True for one of so many parts of the documents, by a hash of their key."""
    return F.pmod(F.xxhash64(key, F.lit("holdout")), F.lit(parts)) == 0


def _least(x: np.ndarray) -> np.ndarray:
    """x as unsigned numbers of as few bytes as its greatest needs."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or int(x.max()) <= np.iinfo(t).max))


def _row(part: int, keys: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """A part's counts by ascending key: steps between keys, and counts, in few bytes."""
    return part, len(keys), zlib.compress(_least(np.diff(keys, prepend=0)), 1), zlib.compress(_least(counts), 1)


def _unpacked(n: int, packed: bytes) -> np.ndarray:
    packed = zlib.decompress(packed)
    return np.frombuffer(packed, f"u{len(packed) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["part", "n", "keys", "counts"])


class Tally:
    """Counts by bucket and class of a task's n-grams, as many as there are and no more."""

    def __init__(self, classes: int):
        self.classes, self.keys, self.counts, self.wait = classes, [], [], 0

    def add(self, k: int, buckets: np.ndarray) -> None:
        u, c = np.unique(buckets, return_counts=True)
        self.keys.append(u * self.classes + k)
        self.counts.append(c)
        self.wait += len(u)

    def rows(self, last: bool = False) -> Batches:
        """What waits, as rows: once there is much of it, or at the end."""
        if self.wait < _WAIT and not last or not self.wait:
            return
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        self.keys, self.counts, self.wait = ([keys], [counts], len(keys)) if not last and len(keys) < _WAIT // 2 else ([], [], 0)
        if self.wait:
            return
        part = keys // (_PART * self.classes)
        ends = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
        for at in range(0, len(ends) - 1, 64):
            yield _rows([_row(int(part[i]), keys[i:j] - part[i] * _PART * self.classes, counts[i:j]) for i, j in zip(ends[at : at + 64], ends[at + 1 : at + 65])])


def unpacked(n: int, keys: bytes, counts: bytes, classes: int) -> np.ndarray:
    """(buckets of a part, classes) counts."""
    out = np.zeros(_PART * classes, np.int64)
    out[np.cumsum(_unpacked(n, keys))] = _unpacked(n, counts)
    return out.reshape(-1, classes)


def summed(rows: DataFrame, classes: int) -> DataFrame:
    """Rows of COUNTS with each part once, kept in the checkpoint folder."""

    def run(batches: Batches) -> Batches:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                a = total.setdefault(r["part"], np.zeros(_PART * classes, np.int64))
                a[np.cumsum(_unpacked(r["n"], r["keys"]))] += _unpacked(r["n"], r["counts"])
        for part, a in total.items():
            keys = np.flatnonzero(a)
            yield _rows([_row(part, keys, a[keys])])

    return cut(rows.repartition("part").mapInArrow(run, COUNTS))


def parts(bits: int) -> int:
    """Parts that so many bits of buckets fill."""
    return (1 << bits) // _PART


def weighed(counts: DataFrame, classes: int, bits: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """f of (buckets, classes) counts and of the sums of all classes, part by part, as the weights of all buckets."""
    mine = counts.filter(F.col("part") < parts(bits))

    def sums(batches: Batches) -> Batches:
        for batch in batches:
            every = [unpacked(r["n"], r["keys"], r["counts"], classes).sum(axis=0) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in every for k in range(classes)], pa.int64()), pa.array([k for _ in every for k in range(classes)], pa.int64())], ["n", "k"])

    by = {r["k"]: r["n"] for r in mine.mapInArrow(sums, "n long, k long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    totals = np.array([by.get(k, 0) for k in range(classes)], np.float64)
    kind = np.float64 if 1 << bits <= _EXACT else np.float32

    def weights(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                w = f(unpacked(r["n"], r["keys"], r["counts"], classes), totals).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int64()), pa.array([w], pa.binary())], ["part", "w"])

    out = np.full(1 << bits, f(np.zeros((1, classes), np.int64), totals)[0], kind)
    for r in mine.mapInArrow(weights, "part long, w binary").collect():
        out[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["w"], kind)
    return out


def per_text(f: Callable[[np.ndarray, np.ndarray], np.ndarray], column: pa.Array) -> np.ndarray:
    """f(bytes, offsets) of each run of texts, put together."""
    parts = [f(raw, offs) for _, _, raw, offs in tv.chunks(column)]
    return np.concatenate(parts) if parts else np.zeros(0)


def normalised(weights: Broadcast, bits: int, prior: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Mean weight of a text's n-grams, with so many of weight 0 added; NaN for a text without words."""

    def score(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        own, b = buckets(raw, offs, bits)
        n = np.bincount(own, minlength=len(offs) - 1)
        total = np.bincount(own, weights.value[b], minlength=len(offs) - 1)
        return np.where(n > 0, total / (n + prior), np.nan)

    return score


def nullable(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def quantile(df: DataFrame, column: str, share: float, step: float = 1e-4) -> float:
    """The greatest multiple of step under which at most that share of the rows lies; 0 without rows."""
    rows = df.filter(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / step).alias("bin")).count().toPandas().sort_values("bin")
    if rows.empty:
        return 0.0
    below = rows["count"].cumsum() - rows["count"]
    return float(rows["bin"][below <= share * rows["count"].sum()].iloc[-1]) * step
