"""Array kernels over Arrow string columns: words, hashes and n-grams of a whole batch at once.

A word is a maximal run of bytes other than ASCII white space. Hashes have 64 bits and depend on nothing but the
bytes, so they agree between tasks, executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_R, _RI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}

#: Bytes of text that one pass of the kernels holds; a longer text is one pass of its own.
CHUNK = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1 << 16), base, U)
        a[0] = 1
        have = np.cumprod(a, dtype=U)
        if n <= 2 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def key_hash(ids: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(ids.astype(np.int64).view(U) + U(0x9E3779B97F4A7C15)) + U(seed * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from hashes."""
    return ((x >> U(12)).astype(np.float64) + 0.5) * 2.0**-52


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in raw, its hash, and where each text's words begin (one more than texts)."""
    if not len(raw):
        e = np.zeros(0, np.int64)
        return e, e, e.view(U), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(raw))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(_R, len(raw)), out=total[1:])
    return a, b, mix((total[b] - total[a]) * powers(_RI, len(raw))[a]), np.searchsorted(a, offs)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive items; runs may cross texts."""
    if len(h) < n:
        return np.zeros(0, U)
    if n == 1:
        return h
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(_R, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(_RI, len(h))[: len(h) - n + 1])


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each word, from words()' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
