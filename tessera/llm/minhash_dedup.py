"""Near duplicates by weighted minwise hashing.

A document is a multiset of word trigrams. Its signature has ``SLOTS`` values: each trigram and weight level owns a
Poisson process of rate 1 whose points fall into random slots, and a slot's value is its least point over all trigrams
and levels up to their weights, so that two signatures agree in a slot with the probability of the weighted Jaccard
similarity. Levels are drawn hierarchically: a trigram has one process for each doubling of levels, whose points are
thinned to a level each, and points are made in rising order until no slot can change any more. Bands of the signature
propose pairs, the multisets' overlap is computed for them, and connected pairs form the groups.

Of equal texts (by 128 bits) the least doc_id stands for all, so that copies don't fill buckets. Of the texts in one
bucket of a band, each is first compared with that of the least doc_id; then all pairs in a bucket that this left in
different groups are compared too, but for those whose sizes alone keep them apart. The others are connected already, so
the groups are those that comparing every pair of every bucket would give, without the square of a large group of copies.
What is quadratic is the number of texts of one bucket that are alike in size and not in words. Nothing is gathered by a
bucket or by a hub: buckets are aggregated and joined, and hubs of many partners are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tessera.llm import textvec as tv
from tessera.operators.graph import connected_components
from tessera.sources.tables import cut, written

SLOTS, BANDS, SIMILAR, GRAM = 128, 32, 0.5, 3
#: Rows (pairs and their hubs) up to which their ids are sent to all executors, so that other texts aren't moved; partners
#: of a hub that one task compares.
SENT_IDS, PARTNERS = 1_000_000, 2_000
_U = np.uint64


def multisets(raw: np.ndarray, offs: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight), sorted by text and element. A text of fewer words than gram has one element, all its words."""
    _, _, h, bounds = tv.words(raw, offs)
    own, g = tv.owners(bounds), tv.ngrams(h, gram)
    inside = own[: len(g)] == own[gram - 1 :][: len(g)] if len(g) else np.zeros(0, bool)
    n = np.diff(bounds)
    short = np.flatnonzero((n > 0) & (n < gram))
    whole = np.array([int(tv.ngrams(h[bounds[i] : bounds[i + 1]], int(n[i]))[0]) for i in short.tolist()], _U)
    own, g = np.concatenate([own[: len(g)][inside], short]), np.concatenate([g[inside], whole])
    order = np.lexsort((g, own))
    own, g = own[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (own[1:] != own[:-1]) | (g[1:] != g[:-1])
    i = np.flatnonzero(new)
    return own[i], g[i], np.diff(np.append(i, len(g)))


def signatures(own: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, slots: int = SLOTS) -> np.ndarray:
    """(texts, slots) values; infinite for a text without elements."""
    out = np.full((texts, slots), np.inf)
    total = np.bincount(own, weight, minlength=texts)
    doc, seed, rate, low, top = [own], [tv.mix(element)], [np.ones(len(own))], [np.zeros(len(own), np.int64)], [weight]
    block, idx = 1, np.flatnonzero(weight > 1)
    while len(idx):
        base = 1 << (block - 1)
        doc.append(own[idx])
        seed.append(tv.mix(element[idx] + _U(block * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        rate.append(np.full(len(idx), float(base)))
        low.append(np.full(len(idx), base))
        top.append(weight[idx])
        idx, block = idx[weight[idx] > 2 * base], block + 1
    doc, seed, rate, low, top = (np.concatenate(x) for x in (doc, seed, rate, low, top))
    x = np.zeros(len(doc))
    step = np.zeros(len(doc), np.int64)
    limit = np.where(total > 0, slots / np.maximum(total, 1) * (np.log(slots) + 3), 0.0)
    open_ = total > 0
    flat = out.reshape(-1)
    live = np.arange(len(doc))
    while len(live):
        # x is the last point made; the next of each live process is made until it passes its text's limit
        h = tv.mix(seed[live] + (step[live].astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
        nxt = x[live] - np.log(tv.unit(h)) / rate[live]
        ok = nxt <= limit[doc[live]]
        go = live[ok]
        if len(go):
            x[go] = nxt[ok]
            step[go] += 1
            h2 = tv.mix(h[ok] ^ _U(0xA0761D6478BD642F))
            slot = (h2 & _U(0xFFFF)).astype(np.int64) % slots
            level = low[go] + 1 + np.minimum((tv.unit(tv.mix(h2)) * rate[go]).astype(np.int64), rate[go].astype(np.int64) - 1)
            in_ = level <= top[go]
            np.minimum.at(flat, doc[go][in_] * slots + slot[in_], x[go][in_])
        live = go
        if not len(live):
            open_ = (total > 0) & np.isinf(out).any(axis=1)
            if not open_.any():
                break
            limit = np.where(open_, limit * 2, 0.0)
            live = np.flatnonzero(open_[doc])
    return out


def _signed(slots: int, bands: int):
    """Of each text with words: two hashes of its words in order, its size as a multiset, and its bands."""
    rows = slots // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offs in tv.chunks(batch["text"]):
                own, g, w = multisets(raw, offs)
                sig = signatures(own, g, w, j - i, slots)
                has = np.flatnonzero(np.isfinite(sig[:, 0]))
                bits = np.ascontiguousarray(sig[has]).view(_U)[:, : bands * rows].reshape(-1, bands, rows)
                key = tv.mix(np.arange(bands, dtype=np.int64).view(_U) + _U(77))[None, :]
                for r in range(rows):
                    key = tv.mix(key * _U(0x9E3779B97F4A7C15) + bits[:, :, r])
                _, _, h, bounds = tv.words(raw, offs)
                texts = []
                for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                    total = np.zeros(len(h) + 1, _U)
                    np.cumsum(tv.mix(h + _U(base)) * tv.powers(base, len(h)), out=total[1:])
                    texts.append(tv.mix((total[bounds[1:]] - total[bounds[:-1]])[has] * tv.powers(pow(base, -1, 1 << 64), max(len(h), 1))[np.minimum(bounds[:-1][has], max(len(h) - 1, 0))] + np.diff(bounds)[has].astype(_U)))
                lists = pa.ListArray.from_arrays(np.arange(len(has) + 1, dtype=np.int32) * bands, pa.array(np.ascontiguousarray(key).reshape(-1).view(np.int64)))
                size = np.bincount(own, w, minlength=j - i)[has].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(i + has)), *(pa.array(t.view(np.int64)) for t in texts), pa.array(size), lists], ["doc_id", "k1", "k2", "size", "bands"])

    return run


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (elements, sorted, and weights)."""
    at = np.searchsorted(x[0], y[0])
    same = at < len(x[0])
    same[same] = x[0][at[same]] == y[0][same]
    common = int(np.minimum(x[1][at[same]], y[1][same]).sum())
    return common / (int(x[1].sum()) + int(y[1].sum()) - common)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub and part, a hub's own text (doc_id = hub) before its partners'."""
    hub, held = None, []
    for batch in batches:
        hubs, docs = list(zip(batch["hub"].to_pylist(), batch["part"].to_pylist())), batch["doc_id"].to_pylist()
        out = []
        for i, j, raw, offs in tv.chunks(batch["text"]):
            own, g, w = multisets(raw, offs)
            edge = np.searchsorted(own, np.arange(j - i + 1))
            for r in range(j - i):
                mine = (g[edge[r] : edge[r + 1]], w[edge[r] : edge[r + 1]])
                if hubs[i + r] != hub:
                    hub, held = hubs[i + r], []
                if docs[i + r] == hub[0]:
                    held.append(mine)
                elif len(mine[0]):
                    if max((overlap(x, mine) for x in held if len(x[0])), default=0.0) >= SIMILAR:
                        out.append((hub[0], docs[i + r]))
        a, b = zip(*out) if out else ((), ())
        kind = batch.schema.field("doc_id").type
        yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])


def _compared(pairs: DataFrame, mine: DataFrame) -> DataFrame:
    """(a, b) of the pairs (hub, doc_id) whose multisets overlap enough. A hub of more than PARTNERS partners is compared
    with them in parts."""
    kind = mine.schema["doc_id"].dataType.simpleString()
    many = pairs.groupBy("hub").count().filter(F.col("count") > PARTNERS).select("hub", F.ceil(F.col("count") / PARTNERS).alias("parts"))
    parted = pairs.join(cut(many).hint("merge"), "hub", "left").select("hub", "doc_id", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).alias("part"))
    wanted = cut(parted.union(parted.select("hub", F.col("hub").alias("doc_id"), "part").distinct()))
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= SENT_IDS:
        mine = mine.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = wanted.hint("merge").join(mine, "doc_id").select("hub", "part", "doc_id", "text")
    sorted_ = texts.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("doc_id") != F.col("hub"))
    return sorted_.select("hub", "part", "doc_id", "text").mapInArrow(_verify, f"a {kind}, b {kind}").distinct()


def _groups(docs: DataFrame) -> DataFrame:
    """(node, component) of documents in groups of two or more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = docs.filter("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    signed = written(mine.mapInArrow(_signed(SLOTS, BANDS), f"doc_id {kind}, k1 long, k2 long, size long, bands array<long>"), "signatures")
    # of equal texts the least doc_id stands for all
    texts = cut(signed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "size", "bands")).alias("t"), F.count(F.lit(1)).alias("n")))
    same = texts.filter("n > 1").select("k1", "k2", F.col("t.doc_id").alias("a")).hint("merge")
    copies = cut(signed.select("k1", "k2", F.col("doc_id").alias("b")).join(same, ["k1", "k2"]).filter("a <> b").select("a", "b").distinct())
    bands = texts.select(F.col("t.doc_id").alias("doc_id"), F.col("t.size").alias("size"), F.explode("t.bands").alias("band"))
    buckets = cut(bands.groupBy("band").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))
    shared = cut(bands.join(buckets.hint("merge"), "band"))
    alike = lambda x, y: F.least(x, y) >= SIMILAR * F.greatest(x, y)
    pairs = cut(shared.filter("first < doc_id").select(F.col("first").alias("hub"), "doc_id").distinct())
    edges = cut(copies.unionByName(_compared(pairs, mine)))
    groups = cut(connected_components(edges))
    of = shared.select("band", "doc_id", "size").distinct().join(groups.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", "size", F.coalesce("component", "doc_id").alias("group"))
    of = cut(of)
    mixed = cut(of.groupBy("band").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("band"))
    apart = cut(of.join(mixed.hint("merge"), "band"))
    other = apart.select("band", F.col("doc_id").alias("hub"), F.col("group").alias("theirs"), F.col("size").alias("its"))
    rest = apart.join(other, "band").filter("hub < doc_id AND group <> theirs").filter(alike(F.col("size"), F.col("its"))).select("hub", "doc_id").distinct()
    rest = cut(rest.join(pairs, ["hub", "doc_id"], "left_anti"))
    if rest.isEmpty():
        return groups
    more = cut(_compared(rest, mine))
    return groups if more.isEmpty() else connected_components(edges.unionByName(more))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id, keep) of each document that has near copies; group_id is the least doc_id, which stays.

    Documents of a group are connected by pairs that share a bucket and have a weighted Jaccard similarity of ``SIMILAR``
    or more. Texts without words (null, empty, white space) and rows with a null doc_id take no part; a text of one or two
    words is near only to the same words. Rows of one doc_id count as one document, alike or not; ids are of any type that
    has an order. Other columns play no part; texts are read
    whole. An empty table gives no rows.
    """
    groups = _groups(docs)
    return groups.select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"), (F.col("node") == F.col("component")).alias("keep"))


def dedup_near(docs: DataFrame) -> DataFrame:
    """docs with one document of each group (see near_groups), and of rows equal in doc_id and text one: the one whose
    other columns, as JSON, come first. All columns stay. Rows with a null doc_id stay as they are."""
    names = {c: c if c in ("doc_id", "text") else f"x{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    drop = cut(near_groups(plain).filter("NOT keep").select(F.col("doc_id").alias("_drop_id")))
    few = lambda df: F.broadcast(df) if df.count() <= SENT_IDS else df.hint("merge")
    kept = plain.join(few(drop), F.col("doc_id") == F.col("_drop_id"), "left_anti")
    twice = cut(kept.filter("doc_id IS NOT NULL").groupBy("doc_id", F.xxhash64("text").alias("h")).count().filter("count > 1").select(F.col("doc_id").alias("_twice")).distinct())
    if not twice.isEmpty():
        twice, same = few(twice), F.col("doc_id") == F.col("_twice")
        rest = [n for n in plain.columns if n not in ("doc_id", "text")]
        order = F.to_json(F.struct(*rest)) if rest else F.lit(0)
        nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(order))
        once = kept.join(twice, same, "left_semi").withColumn("_nth_row", nth).filter("_nth_row = 1").drop("_nth_row")
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
