"""Removal of passages that repeat, by suffix arrays.

A passage is a run of ``length`` or more words. Candidate places come from winnowing: of the hashes of all ``GRAM``-word
runs, each window of a passage's length gives its least one as an anchor, so equal passages always have an anchor in
common. Anchors that occur once are dropped; the words around the others (every passage that holds the anchor) are
gathered by anchor into shards. In a shard, suffixes are classified as smaller or larger than their successors, the
leftmost smaller ones' substrings are named by sorting, recursively, the order of all suffixes is induced from them by two
linear scans, and the permuted common prefixes show which passages are equal. Each occurrence but the first, in the order
of doc_id and place, is removed. The result doesn't depend on how rows are spread over shards.

Two things come before the arrays. Places whose surroundings are alike to the last word, by a hash of 64 bits beside the
anchor's, are repeats of their first, which alone goes to the shard; so copies, however many, aren't gathered. And an
anchor of more than ``HOT`` places would be too much for one task: its passages are grouped by the hash of all their words
instead, by all tasks, which finds the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tessera.llm import textvec as tv
from tessera.sources.tables import cut, written

LENGTH, GRAM = 50, 12
#: Places of an anchor up to which one task orders the words around them; hot anchors that one pass over the texts looks for.
HOT, SENT = 20_000, 1_000_000
_U = np.uint64


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of t (whole numbers from 0), the shorter of two first where one begins the other."""
    return _induced(np.concatenate([np.asarray(t, np.int64) + 1, [0]]))[1:]


def _induced(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes of t, which ends with a symbol less than all others."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(t))
    where = np.where(step != 0, np.arange(n - 1), n - 1)
    where = np.minimum.accumulate(where[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(step, 1)[where] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ranks, distinct = _name(2 * t + small, lms, np.append(lms[1:], n - 1))
    order = np.argsort(ranks) if distinct == len(lms) else _induced(np.concatenate([ranks[:-1] + 1, [0]]))
    return _scans(t, small, lms[order])


def _scans(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order of all suffixes from that of the leftmost smaller ones: these lie at the ends of their symbols' buckets; a
    scan to the right puts each larger suffix in the next free place at the front of its bucket when its successor is
    met, a scan to the left the smaller ones at the back."""
    n = len(t)
    ends = np.cumsum(np.bincount(t))
    of = t[lms]
    left = np.searchsorted(of, of, "right") - np.arange(len(lms))
    out = np.full(n, -1, np.int64)
    out[ends[of] - left] = lms
    sa = out.tolist()
    # bucket of the suffix before each place, if that one is larger (smaller) than its successor; -1 also at place -1
    before = np.concatenate([[-1], t[:-1], [-1]])
    is_small = np.concatenate([[False], small[:-1], [False]])
    larger, smaller = np.where(is_small, -1, before).tolist(), np.where(is_small, before, -1).tolist()
    head, tail = np.append(0, ends[:-1]).tolist(), (ends - 1).tolist()
    for j in sa:
        c = larger[j]
        if c >= 0:
            k = head[c]
            head[c] = k + 1
            sa[k] = j - 1
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            k = tail[c]
            tail[c] = k - 1
            sa[k] = j - 1
    return np.array(sa)


def _name(c: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of c[begin : end + 1], equal ones alike, and how many distinct ones there are."""
    bits = max(1, int(c.max()).bit_length())
    per = max(1, 62 // bits)
    size = end - begin + 1
    rank = np.zeros(len(begin), np.int64)
    todo = np.arange(len(begin))
    at, blocks = 0, int(-(-size.max() // per))
    padded = np.concatenate([c, np.zeros(per * (blocks + 1), np.int64)])
    while len(todo) and at < blocks:
        key = np.zeros(len(todo), np.int64)
        p, left = begin[todo] + at * per, size[todo] - at * per
        for j in range(per):
            key = (key << bits) | np.where(left > j, padded[p + j], 0)
        todo = _split(rank, todo, key)
        at += 1
        todo = todo[size[todo] > at * per]
    used = np.zeros(len(begin) + 1, np.int64)
    used[rank] = 1
    dense = np.cumsum(used) - 1
    return dense[rank], int(used.sum())


def _split(rank: np.ndarray, todo: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Refines ranks (the place of the first of its equals) by key; returns those that still have equals."""
    order = np.lexsort((key, rank[todo])) if rank.any() else np.argsort(key, kind="stable")
    ids = todo[order]
    r, k = rank[ids], key[order]
    new = np.ones(len(ids), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    group = np.ones(len(ids), bool)
    group[1:] = r[1:] != r[:-1]
    i = np.arange(len(ids))
    first, head = np.maximum.accumulate(np.where(new, i, 0)), np.maximum.accumulate(np.where(group, i, 0))
    rank[ids] = r + first - head
    alone = new & np.append(new[1:], True)
    return ids[~alone]


def permuted_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, the length it has in common with the suffix sorted before it in order. Only irreducible places
    are compared; elsewhere the suffix before is the successor of that of the place before, and the length one less."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    whole = np.ones(n, bool)
    whole[1:] = (before[1:] < 1) | (before[:-1] + 1 != before[1:]) | (before[:-1] < 0)
    whole[1:] |= t[i[1:] - 1] != t[np.maximum(before[1:], 1) - 1]
    start = i[whole & (before >= 0)]
    length = np.zeros(n, np.int64)
    live, a, b, done = start, start, before[start], 0
    ext = np.concatenate([t, [-5, -6]])
    while len(live):
        same = (np.maximum(a, b) < n) & (ext[np.minimum(a, n)] == ext[np.minimum(b, n + 1)])
        length[live[~same]] = done
        live, a, b = live[same], a[same] + 1, b[same] + 1
        done += 1
    source = np.maximum.accumulate(np.where(whole, i, 0))
    return np.maximum(length[source] - (i - source), 0) * (before >= 0)


def _slide(h: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    d = 1
    while d * 2 <= w:
        h, d = f(h[:-d], h[d:]), d * 2
    return f(h[: len(h) - (w - d)], h[w - d :]) if w > d else h


def _least(h: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of GRAM words, and the least one of each passage, 0 for one across texts; none if all are too short."""
    g, w = tv.ngrams(h, GRAM), length - GRAM + 1
    if len(g) < w:
        return g, g[:0]
    least, own = _slide(g, w, np.minimum), tv.owners(bounds)
    least[own[: len(least)] != own[length - 1 : length - 1 + len(least)]] = 0
    return g, least


def _run_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, _U)
    np.cumsum(h * tv.powers(0x9E3779B97F4A7C15, len(h)), out=total[1:])
    return tv.mix((total[hi] - total[lo]) * tv.powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), len(h))[lo] + (hi - lo).astype(_U))


def _anchors(length: int):
    w, span = length - GRAM + 1, length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, raw, offs in tv.chunks(batch["text"]):
                _, _, h, bounds = tv.words(raw, offs)
                g, least = _least(h, bounds, length)
                if not len(least):
                    continue
                edge = np.zeros(w - 1, _U)
                at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), w, np.maximum) == g)
                if not len(at):
                    continue
                o = tv.owners(bounds)[at]
                lo, hi = np.maximum(at - span, bounds[o]), np.minimum(at + length, bounds[o + 1])
                around, rows = _run_hash(h, lo, hi), pa.array(i + o)
                pos = (at - bounds[o]) << 34 | (at - lo) << 27 | (hi - at) << 20 | batch["tag"].take(rows).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(around.view(np.int64)), batch["doc_id"].take(rows), pa.array(pos)], ["fp", "around", "doc_id", "at"])

    return run


def _windows(length: int, hot: np.ndarray):
    """Each passage whose anchor is one of some sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, raw, offs in tv.chunks(batch["text"]):
                _, _, h, bounds = tv.words(raw, offs)
                _, least = _least(h, bounds, length)
                at = np.flatnonzero((least != 0) & np.isin(least.view(np.int64), hot))
                if len(at):
                    o, key = tv.owners(bounds)[at], _run_hash(h, at, at + length)
                    rows = pa.array(i + o)
                    yield pa.RecordBatch.from_arrays([pa.array(least[at].view(np.int64)), pa.array(key.view(np.int64)), batch["doc_id"].take(rows), pa.array((at - bounds[o]) << 20 | batch["tag"].take(rows).to_numpy())], ["fp", "key", "doc_id", "at"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch["wanted"]
        for i, j, raw, offs in tv.chunks(batch["text"]):
            a, e, h, bounds = tv.words(raw, offs)
            part, tags = wanted.slice(i, j - i), batch["tag"].slice(i, j - i).to_numpy()
            flat = part.flatten()
            row = np.repeat(np.arange(j - i), np.asarray(part.value_lengths()))
            fp, at = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("fp", "at"))
            p, lo, hi = at >> 34, at >> 27 & 127, at >> 20 & 127
            ok = bounds[row] + p + hi <= bounds[row + 1]
            row, fp, p, lo, hi = row[ok], fp[ok], p[ok], lo[ok], hi[ok]
            first = bounds[row] + p - lo
            data = raw.tobytes()
            texts = [data[x:y] for x, y in zip(a[first].tolist(), e[first + lo + hi - 1].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(fp), batch["doc_id"].take(pa.array(i + row)), pa.array((p - lo) << 20 | tags[row]), pa.array(texts, pa.binary()).cast(pa.string())], ["fp", "doc_id", "lo", "segment"])


def repeats(segments: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, segment, offset) of each run of length words that occurs more than once in the segments of word hashes."""
    sizes = np.array([len(s) for s in segments])
    starts = np.append(0, np.cumsum(sizes + 1)[:-1])
    _, ids = np.unique(np.concatenate(segments), return_inverse=True)
    t = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    ends = starts + sizes
    body = np.ones(len(t), bool)
    body[ends] = False
    t[ends] = np.arange(len(sizes))
    t[body] = ids + len(sizes)
    fits = np.arange(len(t)) + length <= np.repeat(ends, sizes + 1)
    order = suffix_array(t)
    order = order[fits[order]]
    common = permuted_prefixes(t, order)[order] >= length
    member = common | np.append(common[1:], False)[: len(common)]
    at, group = order[member], np.cumsum(~common)[member]
    s = np.searchsorted(starts, at, "right") - 1
    return group, s, at - starts[s]


def _shard(length: int, budget: int = 60_000):
    kind: list[pa.DataType] = []

    def solve(fps: list, docs: list, los: list, texts: list) -> pa.RecordBatch | None:
        column = pa.array(texts, pa.string())
        segs: list[np.ndarray] = []
        for _, _, raw, offs in tv.chunks(column, 1 << 40):
            _, _, h, bounds = tv.words(raw, offs)
            segs = [h[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        group, s, off = repeats(segs, length)
        if not len(group):
            return None
        lo = np.array(los)
        named = [None, *sorted({d for d in docs if d is not None})]
        number = {d: k for k, d in enumerate(named)}
        ids = np.array([number[d] for d in docs])
        doc, pos, tag = ids[s], (lo[s] >> 20) + off, lo[s] & (1 << 20) - 1
        o = np.lexsort((tag, pos, doc, group))
        group, doc, pos, tag = group[o], doc[o], pos[o], tag[o]
        head = np.ones(len(o), bool)
        head[1:] = group[1:] != group[:-1]
        h = np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))
        again = (doc != doc[h]) | (pos != pos[h]) | (tag != tag[h])
        many = np.zeros(len(o), bool)
        many[h[again]] = True
        holders = np.unique(np.stack([doc[many], tag[many]]), axis=1)
        doc, pos, tag = doc[again], pos[again], tag[again]
        if not len(doc):
            return None
        o = np.lexsort((pos, tag, doc))
        doc, pos, tag = doc[o], pos[o], tag[o]
        new = np.ones(len(o), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] > pos[:-1] + 1)
        i = np.flatnonzero(new)
        last, none = np.append(i[1:], len(o)) - 1, np.zeros(holders.shape[1], np.int64)
        ids = np.concatenate([doc[i], holders[0]])
        rest = (np.concatenate(x) for x in ((tag[i], holders[1]), (pos[i], none), (pos[last] + length, none)))
        return pa.RecordBatch.from_arrays([pa.array([named[k] for k in ids.tolist()], kind[0]), *map(pa.array, rest)], ["doc_id", "tag", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, docs, los, texts, total = [], [], [], [], 0
        for batch in batches:
            kind.append(batch.schema.field("doc_id").type)
            cols = [batch[c].to_pylist() for c in ("fp", "doc_id", "lo", "segment")]
            for fp, d, lo, x in zip(*cols):
                if total >= budget and fp != fps[-1]:
                    if (out := solve(fps, docs, los, texts)) is not None:
                        yield out
                    fps, docs, los, texts, total = [], [], [], [], 0
                fps.append(fp)
                docs.append(d)
                los.append(lo)
                texts.append(x)
                total += length
        if fps and (out := solve(fps, docs, los, texts)) is not None:
            yield out

    return run


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and 20 bits of the text, which keep rows of one doc_id and different texts apart."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).bitwiseAND(F.lit((1 << 20) - 1)).alias("tag"))


def spans(narrow: DataFrame, length: int = LENGTH, hot_rows: int = HOT, sent: int = SENT) -> DataFrame:
    """(doc_id, tag, lo, hi) from rows (doc_id, text, tag): words lo to hi of the text repeat an earlier passage; 0 to 0 for
    the text that holds a first one."""
    if not 2 * GRAM <= length < 128:
        raise ValueError(f"length must be from {2 * GRAM} to 127")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {kind}, tag long, lo long, hi long"
    tag = F.col("at").bitwiseAND(F.lit((1 << 20) - 1)).alias("tag")
    itself = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))
    zero = F.lit(0).cast("long")
    holders = lambda df: df.filter(~itself).select("first.*").distinct().select("doc_id", tag, zero.alias("lo"), zero.alias("hi"))
    found = written(narrow.mapInArrow(_anchors(length), f"fp long, around long, doc_id {kind}, at long"), "anchors")
    hot = cut(found.groupBy("fp").count().filter(F.col("count") > hot_rows).select("fp"))
    n_hot = hot.count()
    parts = []
    # passages of hot anchors, by the hash of all their words, in as many passes as keep each list of anchors short
    for k in range(passes := -(-n_hot // sent)):
        mine = hot.filter(F.pmod(F.xxhash64("fp"), F.lit(passes)) == k).toPandas()["fp"].to_numpy(np.int64)
        same = narrow.mapInArrow(_windows(length, np.sort(mine)), f"fp long, key long, doc_id {kind}, at long")
        first = cut(same.groupBy("fp", "key").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
        again = same.join(first.hint("merge"), ["fp", "key"])
        start = F.shiftright("at", 20)
        parts += [again.filter(~itself).select("doc_id", tag, start.alias("lo"), (start + length).alias("hi")), holders(again)]
    if n_hot:
        found = found.join(F.broadcast(hot) if n_hot <= sent else hot.hint("merge"), "fp", "left_anti")
    by, same = Window.partitionBy("fp"), Window.partitionBy("fp", "around")
    flagged = (
        found.withColumn("n", F.count(F.lit(1)).over(by))
        .withColumn("lone", F.min("around").over(by) == F.max("around").over(by))
        .filter("n > 1")
        .withColumn("first", F.min(F.struct("doc_id", "at")).over(same))
    )
    pos, left, right = F.shiftright("at", 34), F.shiftright("at", 27).bitwiseAND(F.lit(127)), F.shiftright("at", 20).bitwiseAND(F.lit(127))
    exact = flagged.filter(left + right >= length)
    parts += [exact.filter(~itself).select("doc_id", tag, (pos - left).alias("lo"), (pos + right).alias("hi")), holders(exact)]
    wanted = flagged.filter(itself & ~F.col("lone")).groupBy(F.col("doc_id").alias("w_id"), tag.alias("w_tag")).agg(F.collect_list(F.struct("fp", "at")).alias("wanted"))
    texts = narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tag") == F.col("w_tag"))).select("doc_id", "text", "tag", "wanted")
    segments = texts.mapInArrow(_segments, f"fp long, doc_id {kind}, lo long, segment string")
    parts.append(segments.repartition("fp").sortWithinPartitions("fp").mapInArrow(_shard(length), out_schema))
    return reduce(DataFrame.unionByName, parts)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, kept, gone, shared = [], [], [], []
        todo = batch["spans"]
        for i, j, raw, offs in tv.chunks(batch["text"]):
            a, _, _, bounds = tv.words(raw, offs)
            edge = np.append(a, len(raw))
            for r, mine in enumerate(todo.slice(i, j - i).to_pylist()):
                w0, w1, e0, e1 = int(bounds[r]), int(bounds[r + 1]), int(offs[r]), int(offs[r + 1])
                own = [s for s in mine or () if s["hi"] <= w1 - w0]
                cover = np.zeros(w1 - w0 + 1, np.int64)
                for s in own:
                    cover[s["lo"]] += 1
                    cover[s["hi"]] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                shared.append(bool(own))
                kept.append(int(keep.sum()))
                gone.append(int((~keep).sum()))
                if not gone[-1]:
                    out.append(None)
                    continue
                cuts = np.minimum(edge[w0 : w1 + 1], e1)
                flips = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                text = b"".join(raw[cuts[x] : cuts[y]].tobytes() for x, y in zip(flips[::2].tolist(), flips[1::2].tolist()))
                out.append((raw[e0 : cuts[0]].tobytes() if len(flips) else b"") + text)
        clean = pa.array(out, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "spans"), clean, pa.array(kept, pa.int64()), pa.array(gone, pa.int64()), pa.array(shared)], [*(c for c in batch.schema.names if c != "spans"), "_clean", "_kept", "_gone", "_shared"])


def _joined(docs: DataFrame, length: int, how: str) -> DataFrame:
    cols = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    rest = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in cols.items()))
    text = F.col("text").cast("string")
    rest = rest.withColumn("text", text).withColumn("tag", F.xxhash64(text).bitwiseAND(F.lit((1 << 20) - 1)))
    found = spans(_narrow(docs), length).groupBy(F.col("doc_id").alias("_span_id"), F.col("tag").alias("_span_tag")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    both = rest.join(found, F.col("doc_id").eqNullSafe(F.col("_span_id")) & (F.col("tag") == F.col("_span_tag")), how).drop("_span_id", "_span_tag")
    more = T.StructType().add("_clean", "string").add("_kept", "long").add("_gone", "long").add("_shared", "boolean")
    return both.mapInArrow(_clean, T.StructType(rest.schema.fields + more.fields))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with a passage of ``length`` or more words that occurs more than once, there or elsewhere.

    Returns doc_id, text (without the passages that also stand earlier, in the order of doc_id and place), n_kept and
    n_removed (words; none are removed where all occurrences are first ones). A removed word takes the white space after
    it along. Texts that are null, empty or shorter than a passage have no row, nor has any for an empty table. Rows
    equal in doc_id and text count as one document and have equal results; rows of one doc_id and different texts are
    documents of their own; a null doc_id sorts first, and ids are of any type that has an order. Other columns, of any name, play no part. Texts of any length are
    read whole.
    """
    out = _joined(docs.select("doc_id", "text"), length, "inner")
    return out.filter("_shared").select("doc_id", F.coalesce("_clean", "text").alias("text"), F.col("_kept").alias("n_kept"), F.col("_gone").alias("n_removed"))


def dedup_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages removed from text (see repeated_passages) and n_chars, where there is such a column,
    set to the new length. A document of which nothing but white space stays is dropped; one that was empty before, or
    null, is kept as it was. All columns stay, in their order."""
    out = _joined(docs, length, "left").filter("_gone = 0 OR _kept > 0")
    text = F.coalesce("_clean", "text")
    cols = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    picked = []
    for c, kind in docs.dtypes:
        if c == "text":
            picked.append(text.alias(c))
        elif c == "doc_id":
            picked.append(F.col("doc_id"))
        elif c == "n_chars":
            picked.append(F.when(F.col("_gone") > 0, F.length(text)).otherwise(F.col(cols[c])).cast(kind).alias(c))
        else:
            picked.append(F.col(cols[c]).alias(c))
    return out.select(*picked)
