"""Quality by co-training of two classifiers that see different sides of a document.

The text view holds words and pairs of words, hashed to as many buckets as their number asks for. The metadata view holds
what a page says of itself, language, source and size, and how it is laid out, number and length of its lines, each in a
few classes, and nothing of its words. Both are naive Bayes models over hashed features, counted over all
labelled documents but a fifth that calibrates. In each of ``ROUNDS`` rounds every document without a label of which one
view is confident adds its features, under that label, to the other view's counts; documents held out never do. Platt
scaling calibrates the views; their log odds are added, less the prior's. A document is kept from the
probability on that all but ``REJECT`` of the good ones held out reach, and from 0.5 at most. Toxic documents are the
reject class too; the weights of their words (``toxicity``) are taken from the log odds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import hashed, toxicity
from tessera.llm import textvec as tv
from tessera.sources.tables import cut

ROUNDS, CONFIDENT, PRIOR, REJECT = 2, 0.95, 20.0, 0.01
_META = 1 << 12


def _classes(x: np.ndarray, per_doubling: int = 2) -> np.ndarray:
    return np.floor(per_doubling * np.log2(x + 1)).astype(np.int64)


def metadata(raw: np.ndarray, offs: np.ndarray, lang: np.ndarray, source: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(texts, 5) buckets of metadata features: what the page says of itself, and how it is laid out; no words."""
    lines = np.append(0, np.cumsum(raw == 10))
    lines = lines[offs[1:]] - lines[offs[:-1]] + 1
    length = np.diff(offs)
    columns = [lang, source, np.where(size < 0, -1, _classes(np.maximum(size, 0))), _classes(lines), _classes(length / lines)]
    return np.stack([(tv.key_hash(c, 100 + k) >> np.uint64(52)).astype(np.int64) for k, c in enumerate(columns)], axis=1)


def _meta(counts: DataFrame, bits: int) -> np.ndarray:
    """(metadata buckets, 2) counts, which lie in a part of their own behind the text's."""
    rows = counts.filter(F.col("part") == hashed.parts(bits)).collect()
    return sum((hashed.unpacked(r["n"], r["keys"], r["counts"], 2)[:_META] for r in rows), np.zeros((_META, 2), np.int64))


def _log_odds(counts: np.ndarray, totals: np.ndarray, size: int) -> np.ndarray:
    x = np.log((counts + 1.0) / (totals + size))
    return x[:, 1] - x[:, 0]


class Views:
    """Both views' log odds by bucket, and their calibrations; without counts, features alone."""

    def __init__(self, bits: int, counts: DataFrame | None = None):
        self.bits, self.weights = bits, None
        if counts is not None:
            text = hashed.weighed(counts, 2, bits, lambda c, n: _log_odds(c, n, 1 << bits))
            meta = _meta(counts, bits)
            self.weights = {"text": counts.sparkSession.sparkContext.broadcast(text), "meta": _log_odds(meta, meta.sum(axis=0), _META)}
        self.platt = {"text": (1.0, 0.0), "meta": (1.0, 0.0)}

    def scores(self, batch: pa.RecordBatch, each=None) -> tuple[np.ndarray, np.ndarray]:
        text, meta = [], []
        lang, source, size = (batch[c].to_numpy(zero_copy_only=False) for c in ("lang_key", "source_key", "size"))
        for i, j, raw, offs in tv.chunks(batch["text"]):
            own, b = hashed.buckets(raw, offs, self.bits)
            m = metadata(raw, offs, lang[i:j], source[i:j], size[i:j])
            if self.weights is None:
                each(own, b, m)
                continue
            n = np.bincount(own, minlength=j - i)
            s = np.where(n > 0, np.bincount(own, self.weights["text"].value[b], minlength=j - i) / (n + PRIOR), np.nan)
            z = np.where(n > 0, self.weights["meta"][m].sum(axis=1), np.nan)
            text.append(s)
            meta.append(z)
            if each is not None:
                each(own, b, m, self.odds("text", s), self.odds("meta", z))
        return (np.concatenate(text), np.concatenate(meta)) if text else (np.zeros(0), np.zeros(0))

    def odds(self, view: str, s: np.ndarray) -> np.ndarray:
        a, b = self.platt[view]
        return a * s + b


def _count(tally: hashed.Tally, bits: int, k: int, text: np.ndarray, meta: np.ndarray) -> None:
    tally.add(k, text)
    tally.add(k, meta.ravel() + (1 << bits))


def _count_labelled(bits: int):
    def run(batches: hashed.Batches) -> hashed.Batches:
        tally, none = hashed.Tally(2), Views(bits)
        for batch in batches:
            label = batch["label"].to_numpy(zero_copy_only=False)
            at = 0

            def each(own, b, m, *_):
                nonlocal at
                y = label[at : at + len(m)]
                at += len(m)
                for k in (0, 1):
                    _count(tally, bits, k, b[(y == k)[own]], m[y == k])

            none.scores(batch, each)
            yield from tally.rows()
        yield from tally.rows(last=True)

    return run


def _count_confident(views: Views, confident: float):
    line = float(np.log(confident / (1 - confident)))

    def run(batches: hashed.Batches) -> hashed.Batches:
        tally = hashed.Tally(2)

        def each(own, b, m, text, meta):
            for k, sign in ((0, -1), (1, 1)):
                _count(tally, views.bits, k, b[(sign * meta >= line)[own]], m[sign * text >= line])

        for batch in batches:
            views.scores(batch, each)
            yield from tally.rows()
        yield from tally.rows(last=True)

    return run


def _score(views: Views, words: toxicity.Lexicon):
    def run(batches: hashed.Batches) -> hashed.Batches:
        for batch in batches:
            text, meta = views.scores(batch)
            rest = ["label"] if "label" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays([batch["doc_id"], hashed.nullable(text), hashed.nullable(meta), pa.array(toxicity.score(words, batch["text"])), *(batch[n] for n in rest)], ["doc_id", "text_score", "meta_score", "toxic_score", *rest])

    return run


def platt(s: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits n rows of score s and label y best; slope 0 at least."""
    scale = float(np.sqrt(np.average(s * s, weights=n))) or 1.0
    x, a, b = s / scale, 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(n * (p - y) * x) + 1e-3 * a, np.sum(n * (p - y)) + 1e-3 * b])
        w = n * p * (1 - p)
        h = np.array([[np.sum(w * x * x) + 1e-3, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0) / scale, b


def _calibrate(views: Views, held: DataFrame) -> float:
    """Sets the views' calibrations from the scores and labels of the documents held out; returns the labels' log odds."""
    prior = 0.0
    for v in ("text", "meta"):
        rows = held.filter(F.col(f"{v}_score").isNotNull()).groupBy(F.round(F.col(f"{v}_score"), 2).alias("s"), "label").count().toPandas()
        if rows["label"].nunique() == 2:
            s, y, n = (rows[c].to_numpy(np.float64) for c in ("s", "label", "count"))
            views.platt[v] = platt(s, y, n)
            prior = float(np.log(n[y == 1].sum() / n[y == 0].sum()))
    return prior


def scored(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT) -> DataFrame:
    """(doc_id, p_text, p_meta, p_quality, keep) of every document; keep is p_quality >= threshold, without more toxic words
    than good documents held out have.

    A toxic label rejects whatever the quality. Labels other than 0 and 1, null ones and those of no document count for
    nothing; of several labels of one document the least counts. Documents of equal score have equal results, whatever
    their number. Ids are numbers or text; where only one table has numbers, they are compared as text. Where one class lacks labels, scores stay uncalibrated. A null, empty or white text has null
    probabilities and isn't kept; a null lang, source or n_chars is a class of its own. Repeated rows count as often as
    they occur and have equal results; other columns play no part. Texts are read whole, labels are all used.
    """
    hashed_ = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\x00")))
    have, (key, label_key) = set(docs.columns), hashed.keys(docs, labels)
    size = F.coalesce(F.col("n_chars").cast("long"), F.lit(-1)) if "n_chars" in have else F.lit(-1)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(hashed_(c).alias(f"{c}_key") if c in have else F.lit(0).cast("long").alias(f"{c}_key") for c in ("lang", "source")), size.cast("long").alias("size"), key.alias("key"))
    reject = F.when(F.col("toxic") == 1, 0).when(F.col("quality").isin(0, 1), F.col("quality").cast("int"))
    marks = labels.groupBy(label_key.alias("label_id")).agg(F.min(reject).alias("label"), F.max(F.when(F.col("toxic").isin(0, 1), F.col("toxic"))).alias("toxic"))
    marks = marks.filter("label IS NOT NULL OR toxic IS NOT NULL")
    known = hashed.labelled(plain, marks)
    train = known.filter(~hashed.holdout(F.col("key")))
    held = known.filter(hashed.holdout(F.col("key")) & F.col("label").isNotNull())
    fresh = hashed.unlabelled(plain, marks)
    words = toxicity.lexicon(train)
    train = train.filter("label IS NOT NULL").select("text", "lang_key", "source_key", "size", "label")
    bits = hashed.bits(plain)
    base = hashed.summed(train.mapInArrow(_count_labelled(bits), hashed.COUNTS), 2)
    views, kind = Views(bits, base), docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_score double, meta_score double, toxic_score double"
    for r in range(rounds + 1):
        prior = _calibrate(views, held.mapInArrow(_score(views, words), schema + ", label int"))
        if r < rounds:
            more = fresh.mapInArrow(_count_confident(views, confident), hashed.COUNTS)
            views = Views(bits, hashed.summed(base.unionByName(more), 2))
    odds = [F.col(f"{v}_score") * views.platt[v][0] + views.platt[v][1] for v in ("text", "meta")]
    p = lambda x: F.round(1 / (1 + F.exp(-x)), 6)
    quality = p(odds[0] + odds[1] - prior - F.col("toxic_score")).alias("p_quality")
    good = cut(held.mapInArrow(_score(views, words), schema + ", label int").filter("label = 1").select(quality, "toxic_score"))
    line, toxic_line = min(0.5, hashed.quantile(good, "p_quality", REJECT)), toxicity.line(good, "toxic_score")
    out = plain.mapInArrow(_score(views, words), schema).select("doc_id", p(odds[0]).alias("p_text"), p(odds[1]).alias("p_meta"), quality, "toxic_score")
    return out.withColumn("keep", F.coalesce((F.col("p_quality") >= line) & (F.col("toxic_score") <= toxic_line), F.lit(False))).drop("toxic_score")
