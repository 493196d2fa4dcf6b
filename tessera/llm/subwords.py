"""Sampled segmentations of texts into SentencePiece pieces, and back.

The lattice of a text holds every way to tile it with pieces of a public vocabulary (spaces are part of pieces; a
character without a piece of its own becomes its bytes; a piece with a space after another character, or with a new line,
would be left out). Texts are taken as they are, without normalisation, so that pieces spell them exactly. Vocabularies of merged pairs store merge ranks, not
probabilities, so a piece's weight is that of Zipf's law for its rank; the probability of a segmentation is the product
of its pieces' weights over the sum for all segmentations, by a backward pass over the lattice. ``SAMPLES`` distinct
segmentations a text are drawn without replacement by the Gumbel top-k principle: a best-first search pops the node of
greatest perturbed log probability, descends to a complete segmentation, and leaves behind the siblings on its way, whose
maxima are Gumbel variables truncated at their parent's. Randomness is a hash of the row's key, the node and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm import textvec as tv

SAMPLES, SEED = 2, 11
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_U = np.uint64
_BYTE0 = 3
#: A uniform of 52 bits makes -log(-log(u)) less than this.
_TOP = 37.5
_tries: dict[tuple, "Trie"] = {}


class Vocabulary:
    """Pieces as bytes, the space sign as a space; None for pieces that no text yields."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces: list[bytes | None] = []
        self.logs = np.full(sp.get_piece_size(), -np.inf)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.pieces.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.pieces.append(None)
            else:
                piece = sp.id_to_piece(i)
                self.pieces.append(piece.replace("▁", " ").encode())
                if "▁" not in piece.lstrip("▁") and "\n" not in piece:
                    self.logs[i] = -np.log(max(0.0, -sp.get_score(i)) + 10.0)
        self.bytes_at = sp.piece_to_id("<0x00>")
        self.normal = [i for i, x in enumerate(self.logs) if np.isfinite(x)]
        low = min(self.logs[self.normal], default=0.0)
        total = np.log(np.exp(self.logs[self.normal]).sum() + 256 * np.exp(low))
        self.logs -= total
        self.byte_log = float(low - total)
        self.flat = np.frombuffer(b"".join(p or b"" for p in self.pieces), np.uint8)
        self.lens = np.array([len(p or b"") for p in self.pieces])
        self.starts = np.cumsum(self.lens) - self.lens

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of some pieces, put together."""
        lens = self.lens[ids]
        ends = np.cumsum(lens)
        kind = np.int64 if len(ends) and ends[-1] + len(self.flat) >= 1 << 31 else np.int32
        at = np.repeat((self.starts[ids] - (ends - lens)).astype(kind), lens)
        at += np.arange(len(at), dtype=kind)
        return self.flat[at]


    def spell_out(self, flat: np.ndarray, ends: np.ndarray, raw: np.ndarray, offs: np.ndarray, text: np.ndarray) -> np.ndarray:
        """For lists of pieces that end at ends: whether each spells its text of raw byte for byte."""
        upto = np.append(0, np.cumsum(self.lens[flat]))[np.append(0, ends)]
        size, first = np.diff(upto), offs[text]
        good = size == offs[text + 1] - first
        spelt = self.spelt(flat)
        if good.all():
            there = [raw[a:b] for a, b in zip(first.tolist(), (first + size).tolist())]
            wrong = spelt != (np.concatenate(there) if there else spelt)
            if not wrong.any():
                return good
            wrong = np.append(0, np.cumsum(wrong))
            return wrong[upto[1:]] == wrong[upto[:-1]]
        return np.array([bool(g) and np.array_equal(spelt[a:b], raw[x : x + b - a]) for g, a, b, x in zip(good, upto[:-1], upto[1:], first)])


class Trie:
    def __init__(self, vocabulary: Vocabulary):
        ids: dict[bytes, int] = {}
        for i in vocabulary.normal:
            ids.setdefault(vocabulary.pieces[i], i)
        inner: dict[bytes, int] = {b"": 0}
        for p in ids:
            for k in range(1, len(p)):
                inner.setdefault(p[:k], len(inner))
        # child: 0 none; else 1 + 2 * node + ends, with nodes of no children last
        self.child = np.zeros((len(inner), 256), np.int32)
        self.piece: list[int] = []
        names = dict(inner)
        for p in ids:
            names.setdefault(p, len(names))
        self.inner = len(inner)
        self.ends = np.full(len(names), -1, np.int32)
        for p, n in names.items():
            if p:
                self.child[inner[p[:-1]], p[-1]] = n
                self.ends[n] = ids.get(p, -1)
        self.log = np.append(vocabulary.logs, vocabulary.byte_log)
        self.byte_log = vocabulary.byte_log

    @staticmethod
    def of(vocabulary: Vocabulary) -> Trie:
        key = (len(vocabulary.pieces), float(vocabulary.logs[vocabulary.normal].sum()), hash(tuple(vocabulary.pieces[:2000])))
        if key not in _tries:
            _tries.clear()
            _tries[key] = Trie(vocabulary)
        return _tries[key]


class Lattice:
    """Edges of several chunks of bytes, by place; cond is the log probability of an edge given its place, cdf its sum
    up to the edge. Piece -1 stands for the bytes of a character."""

    def __init__(self, trie: Trie, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(raw)
        end = np.repeat(ends.astype(np.int32), ends - starts)
        child = trie.child.reshape(-1)
        whole = (raw & 0xC0) != 0x80
        whole[starts] = True
        at = np.flatnonzero(whole).astype(np.int32)
        width = np.minimum(np.append(at[1:], n), end[at]) - at
        node, pos, here = np.zeros(len(at), np.int32), at, at
        places, sizes, pieces = [], [], []
        k = 0
        while len(pos):
            nxt = child.take((node << 8) + raw.take(here))
            ok = np.flatnonzero(nxt)
            node, pos = nxt.take(ok), pos.take(ok)
            here = pos + np.int32(k + 1)
            k += 1
            ids = trie.ends.take(node)
            hit = np.flatnonzero(ids >= 0)
            places.append(pos.take(hit))
            sizes.append(k)
            pieces.append(ids.take(hit))
            go = np.flatnonzero((node < trie.inner) & (here < end.take(pos)))
            node, pos, here = node.take(go), pos.take(go), here.take(go)
        wide = np.zeros(n, np.int32)
        wide[at] = width
        known, degree = np.zeros(n, bool), np.zeros(n, np.int32)
        for p, k in zip(places, sizes):
            known[p[wide[p] == k]] = True
            degree[p] += 1
        bare = at[~known[at]]
        degree[bare] += 1
        # edges lie by distance to their chunk's end, then by place, then the longer first
        away = (end - np.arange(n))[at]
        at = at[np.argsort(away.astype(np.uint16) if n < 1 << 16 or away.max() < 1 << 16 else away, kind="stable")]
        fill = np.zeros(n, np.int64)
        fill[at] = np.cumsum(degree[at]) - degree[at]
        total_edges = int(degree.sum())
        all_places, all_sizes, all_pieces = (np.empty(total_edges, np.int32) for _ in range(3))
        for p, k, x in [*zip(places[::-1], sizes[::-1], pieces[::-1]), (bare, None, None)]:
            to = fill[p]
            all_places[to] = p
            all_sizes[to] = wide[p] if k is None else k
            all_pieces[to] = -1 if x is None else x
            fill[p] += 1
        places, sizes, pieces = all_places, all_sizes, all_pieces
        far = end[places] - places
        log = trie.log[pieces]
        bare = np.flatnonzero(pieces < 0)
        log[bare] = trie.byte_log * sizes[bare]
        total = np.zeros(n + 1)
        target = places + sizes
        # the value at a chunk's end is 0, also where the next chunk begins
        last = target == end[places]
        new = np.ones(len(places), bool)
        new[1:] = places[1:] != places[:-1]
        heads = np.flatnonzero(new)
        cuts = np.append(np.flatnonzero(np.append(True, far[heads][1:] != far[heads][:-1])), len(heads)) if len(heads) else np.zeros(1, np.int64)
        cond = np.empty(len(places))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e0, e1 = heads[a], heads[b] if b < len(heads) else len(places)
            v = log[e0:e1] + np.where(last[e0:e1], 0.0, total[target[e0:e1]])
            h = heads[a:b] - e0
            top = np.maximum.reduceat(v, h)
            size = np.diff(np.append(h, e1 - e0))
            here = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), h))
            total[places[heads[a:b]]] = here
            np.subtract(v, np.repeat(here, size), out=cond[e0:e1])
        self.cond = cond
        p = np.exp(cond)
        run = np.cumsum(p)
        before = np.repeat(run[heads] - p[heads], np.diff(np.append(heads, len(places)))) if len(heads) else run
        self.cdf = run - before
        self.prob, self.piece, self.size, self.target, self.place = p, pieces, sizes, np.where(last, -1, target), places
        self.first = np.zeros(n + 1, np.int64)
        self.count = np.zeros(n + 1, np.int64)
        self.first[places[heads]] = heads
        self.count[places[heads]] = np.diff(np.append(heads, len(places)))

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log of what the other edges at the places of some have together."""
        with np.errstate(divide="ignore"):
            # the only edge at a place has cond 0, so prob is exactly 1
            return np.log(np.maximum(1 - self.prob[edges], 0))

    def descend(self, at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sampled path from each place at (-1: none): (edges, lane by lane; edges of each lane)."""
        lanes = np.flatnonzero(at >= 0)
        pos, mine = at[lanes], key[lanes]
        steps = np.zeros(len(at), np.int64)
        who, taken, k = [], [], 0
        while len(lanes):
            edge = self.first[pos].copy()
            tail = edge + self.count[pos] - 1
            free = np.flatnonzero(tail > edge)
            if len(free):
                u = tv.unit(tv.mix(mine[free] + _U((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)))
                now, most = edge.take(free), tail.take(free)
                while len(free):
                    more = np.flatnonzero((u > self.cdf.take(now)) & (now < most))
                    free, u, now, most = free.take(more), u.take(more), now.take(more) + 1, most.take(more)
                    edge[free] = now
            who.append(lanes)
            taken.append(edge)
            k += 1
            pos = self.target[edge]
            go = pos >= 0
            lanes, pos, mine = lanes[go], pos[go], mine[go]
        for w in who:
            steps[w] += 1
        begin = np.append(0, np.cumsum(steps))
        out = np.empty(int(begin[-1]), np.int64)
        for k, (w, e) in enumerate(zip(who, taken)):
            out[begin[w] + k] = e
        return out, steps


def _spaced(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each; an empty text stays empty."""
    some = np.diff(offs) > 0
    return np.insert(raw, offs[:-1][some], 32), offs + np.append(0, np.cumsum(some))


def _gumbels(phi: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Maxima of nodes of log mass phi, given that they are less than top."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - phi)


class _Search:
    """The search of one text: complete segmentations so far, and the nodes left behind."""

    def __init__(self, lattice: Lattice, key: int, pops: int):
        self.l, self.key, self.pops = lattice, key, pops
        self.paths: list[tuple[np.ndarray, float, float]] = []
        self.open: list[list] = []

    def add(self, path: np.ndarray, top: float, branch: int, taken: list[int]) -> None:
        """A new segmentation: the siblings of its steps from branch on are left behind, without the edges taken there."""
        cond = self.l.cond[path]
        n = len(self.paths)
        self.paths.append((path, float(cond.sum()), top))
        line, most, before, i = -np.inf, np.zeros(0), float(cond[:branch].sum()), branch
        if taken:
            self._leave(n, i, before, top, [*taken, int(path[i])])
            before += float(cond[i])
            i += 1
        while i < len(path):
            if before + _TOP < line:
                break  # no later node will ever be popped: the nodes' masses fall, and a uniform has finitely many values
            j = min(len(path), i + 1024)
            upto = np.empty(j - i + 1)
            upto[0] = before
            np.cumsum(cond[i:j], out=upto[1:])
            upto[1:] += before
            g = _gumbels(upto[:-1] + self.l.rest(path[i:j]), top, self._uniform(n, np.arange(i, j)))
            self.open.append([g, n, i])
            before, i = float(upto[-1]), j
            if i < len(path):
                most = np.append(most, g if len(g) <= self.pops else np.partition(g, -self.pops)[-self.pops :])
                line = np.partition(most, -self.pops)[-self.pops] if len(most) >= self.pops else -np.inf

    def _uniform(self, path: int, step: np.ndarray) -> np.ndarray:
        x = (self.key + (path + 1) * 0xA24BAED4963EE407) & (1 << 64) - 1
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & (1 << 64) - 1
        return tv.unit(tv.mix(step.astype(_U) * _U(0x9FB21C651E98DF25) + _U(x ^ x >> 31)))

    def _leave(self, n: int, i: int, before: float, top: float, taken: list[int]) -> None:
        place = self.l.place[taken[0]]
        rest = 1 - float(self.l.prob[taken].sum())
        if self.l.count[place] > len(taken) and rest > 0:
            u = self._uniform(n, np.array([i + (1 << 40)]))
            self.open.append([_gumbels(np.array([before + np.log(rest)]), top, u), n, i, taken])

    def pop(self) -> tuple[float, int, int, list[int]] | None:
        """The greatest node left: its value, its path, step and the edges taken there; None if all are exhausted."""
        best = None
        for entry in self.open:
            k = int(entry[0].argmax())
            if best is None or entry[0][k] > best[0]:
                best = (float(entry[0][k]), k, entry)
        if best is None or best[0] == -np.inf:
            return None
        g, k, entry = best
        entry[0][k] = -np.inf
        step = entry[2] + k
        return g, entry[1], step, entry[3] if len(entry) > 3 else [int(self.paths[entry[1]][0][step])]

    def other(self, step: int, path: int, taken: list[int]) -> int:
        """An edge at the place of those taken, other than they, by its probability."""
        place = self.l.place[taken[0]]
        edges = np.arange(self.l.first[place], self.l.first[place] + self.l.count[place])
        p = self.l.prob[edges].copy()
        p[np.array(taken) - edges[0]] = 0.0
        u = float(self._uniform(len(self.paths), np.array([step + (1 << 41) + path]))[0])
        return int(edges[min(int(np.searchsorted(np.cumsum(p), u * p.sum(), "right")), int(np.flatnonzero(p)[-1]))])


def sample(trie: Trie, bytes_at: int, raw: np.ndarray, offs: np.ndarray, keys: np.ndarray, samples: int):
    """For each text a list of (pieces, log probability, perturbed value), and the value of the best node left."""
    raw, offs = _spaced(raw, offs)
    texts = len(offs) - 1
    split = raw == 10
    begin = (raw == 32) | split
    begin[1:] &= ~((raw[1:] == 32) & (raw[:-1] == 32))
    begin[1:] |= split[:-1]
    begin[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(raw))
    total = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * tv.powers(0x9E3779B97F4A7C15, len(raw)), out=total[1:])
    h = (total[ends] - total[starts]) * tv.powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), max(len(raw), 1))[starts]
    _, pick, which = np.unique(h, return_index=True, return_inverse=True)
    size = ends[pick] - starts[pick]
    u_ends = np.cumsum(size)
    u_starts = u_ends - size
    source = np.repeat(starts[pick] - u_starts, size) + np.arange(int(size.sum()))
    own_bytes = raw[source]
    lattice = Lattice(trie, own_bytes, u_starts, u_ends)
    chunk_of = np.searchsorted(starts, offs)
    owner = np.repeat(np.arange(texts), np.diff(chunk_of))
    index = np.arange(len(starts)) - chunk_of[owner]
    base = u_starts[which]

    def pieces(path: np.ndarray) -> np.ndarray:
        p = lattice.piece[path]
        bare = np.flatnonzero(p < 0)
        if not len(bare):
            return p
        reps = np.ones(len(p), np.int64)
        reps[bare] = lattice.size[path[bare]]
        out = np.repeat(p, reps)
        at = np.cumsum(reps) - reps
        place = lattice.place[path[bare]]
        out[at[bare]] = own_bytes[place].astype(np.int64) + bytes_at
        for k in range(1, int(reps[bare].max())):
            more = reps[bare] > k
            out[at[bare[more]] + k] = own_bytes[place[more] + k].astype(np.int64) + bytes_at
        return out

    searches = [_Search(lattice, int(k), samples + 1) for k in keys]
    todo: list[tuple | None] = []
    for s in searches:
        g = -float(np.log(-np.log(s._uniform(-1, np.array([0]))[0])))
        todo.append((np.zeros(0, np.int64), g, 0, [], 0, -1))
    for n in range(samples):
        lane_from = np.full(texts, len(starts))
        at = base.copy()
        for d, t in enumerate(todo):
            if t is None:
                at[chunk_of[d] : chunk_of[d + 1]] = -1
            else:
                c = chunk_of[d] + t[4]
                at[chunk_of[d] : c] = -1
                if t[5] != -1 and c < chunk_of[d + 1]:
                    at[c] = t[5] if t[5] >= 0 else -1
                lane_from[d] = c
        key = tv.mix(tv.mix(index.astype(_U) + _U((n * 0xD6E8FEB86659FD93 + 1) & (1 << 64) - 1)) + keys[owner])
        edges, steps = lattice.descend(at, key)
        bounds = np.append(0, np.cumsum(steps))[chunk_of]
        for d, t in enumerate(todo):
            if t is None:
                continue
            path = np.concatenate([t[0], edges[bounds[d] : bounds[d + 1]]])
            s = searches[d]
            s.add(path, t[1], t[2], t[3])
            if n + 1 == samples:
                continue
            found = s.pop()
            if found is None:
                todo[d] = None
                continue
            g, p, step, taken = found
            edge = s.other(step, p, taken)
            before = s.paths[p][0][:step]
            # the chunk in which the branch lies: as many chunks as end before it
            chunk = int((lattice.target[before] < 0).sum())
            target = int(lattice.target[edge])
            todo[d] = (np.append(before, edge), g, step, taken, chunk, target if target >= 0 else -2)
    out = []
    for s in searches:
        left = s.pop()
        out.append(([(pieces(p), lp, g) for p, lp, g in s.paths], -np.inf if left is None else left[0]))
    return out


def _inclusion(log_p: float, line: float) -> float:
    """Log of the probability that a segmentation is among those drawn, given the value of the best one left."""
    x = log_p - line
    return 0.0 if x > 4 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


def _sampler(vocabulary: Vocabulary, samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie.of(vocabulary)
        for batch in batches:
            seeds = tv.key_hash(batch["_key"].to_numpy(zero_copy_only=False), SEED)
            for i, j, raw, offs in tv.chunks(batch["text"]):
                row, nth, logs, values, inclusion, ids = [], [], [], [], [], []
                spaced, edge = _spaced(raw, offs)
                for d, (found, line) in enumerate(sample(trie, vocabulary.bytes_at, raw, offs, seeds[i:j], samples)):
                    for n, (pieces, lp, g) in enumerate(found):
                        row.append(i + d)
                        nth.append(n)
                        logs.append(lp)
                        values.append(g)
                        inclusion.append(_inclusion(lp, line) if line > -np.inf else 0.0)
                        ids.append(pieces)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
                same = vocabulary.spell_out(flat, ends, spaced, edge, np.array(row, np.int64) - i)
                lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), pa.array(flat.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), pa.array(logs, pa.float64()), pa.array(values, pa.float64()), pa.array(inclusion, pa.float64()), lists, pa.array(same, pa.bool_())], ["doc_id", "sample", "log_prob", "perturbed", "log_inclusion", "pieces", "decodes"])

    return run


def sampled(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, sample, log_prob, perturbed, log_inclusion, pieces, decodes): up to ``samples`` distinct segmentations a row.

    sample counts from 0 in falling order of perturbed, the Gumbel-perturbed log probability. log_inclusion is the log
    of the probability to be drawn, for weighting. decodes is true where the pieces, decoded again, spell the text byte for
    byte, null counting as empty. Equal perturbed values, which would take equal hashes, are ordered by place. A text with fewer segmentations has them all, with log_inclusion 0. A
    null or empty text has one segmentation, without pieces. Equal doc_ids and texts, repeated rows too, have equal
    results wherever they are; a null doc_id is a key of its own. Texts are whole, of any length, and other columns play
    no part.
    """
    vocabulary = Vocabulary(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    mine = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("_key"))
    return mine.mapInArrow(_sampler(vocabulary, samples), f"doc_id {kind}, sample int, log_prob double, perturbed double, log_inclusion double, pieces array<int>, decodes boolean")


def decoded(rows: DataFrame, model: str = MODEL, column: str = "pieces") -> DataFrame:
    """rows with a column text, what the pieces spell. Ids outside the vocabulary or of control pieces spell nothing;
    bytes that aren't UTF-8 become replacement characters; null stays null. A column text that rows had is replaced."""
    pieces = Vocabulary(model).pieces
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids in batch[names[column]].to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                joined = b"".join(pieces[i] or b"" for i in ids if i is not None and 0 <= i < len(pieces))
                out.append(joined[joined[:1] == b" " :].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "spelt"])

    plain = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + ", spelt string"
    out = plain.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in names.items() if c != "text"), F.col("spelt").alias("text"))
