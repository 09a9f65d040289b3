"""Vectorised words of many texts: NumPy over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from veldra.llm.shipping import ship

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
CHUNK_BYTES = 2 << 20
#: Setting for the bytes in an Arrow batch, so that long texts don't fill a Python worker.
BATCH_BYTES = str(8 << 20)

_RNG = np.random.Generator(np.random.PCG64(20240501))
_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = []


def bounded_batches(spark) -> None:
    """Before Arrow UDFs: ship this package and limit the bytes of Arrow batches, unless a smaller limit holds."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, BATCH_BYTES))
    if not now.isdigit() or int(now) > int(BATCH_BYTES):
        spark.conf.set(key, BATCH_BYTES)


def word_bytes(delimiters) -> np.ndarray:
    """Table byte -> lower-cased byte (A-Z only), 0 for delimiters. Bytes above 127 belong to words."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    lowered = t.copy()
    for b in range(256):
        if int(lowered[b]) in delimiters and b < 128:
            t[b] = 0
    t[0] = 0
    return t


#: Delimiters: space and \x09-\x0D.
SPACED = word_bytes({0x20, *range(0x09, 0x0E)})
#: Delimiters: all of ASCII but 0-9 and a-z (after lower-casing).
ALNUM = word_bytes({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})


#: ASCII white space, letters, and the rest of ASCII.
SPACE = np.zeros(256, bool)
SPACE[[*range(0x09, 0x0E), 0x20]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
SIGN = ~SPACE & ~LETTER & (np.arange(256) < 128)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, dtype=np.uint64)))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets start at 0."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges whose texts have at most ``most`` bytes together, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word and the index of each text's first word (one more entry than texts).

    A word is a run of bytes that ``kinds`` maps to other than 0, within one text. Equal lower-cased words have equal
    64-bit hashes in every process.
    """
    low = kinds[data]
    n = len(low)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), start, stop, at
    power, inverse = _power_tables(n)
    values = _VALUES[low] * power[:n]
    values[~inside] = 0
    h = np.add.reduceat(values, start) * inverse[start]
    return mix(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start, stop, at


_SHINGLE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole sequence if it is shorter; empty for no word."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(k, n)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out = mix(out + hashes[j : n - width + 1 + j] * _SHINGLE[j])
    return mix(out + np.uint64(width))


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingles(hashes, k))


def minwise(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key the least keyed hash of ``values``, folded to 32 bits."""
    best = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 4096):
        part = (values[a : a + 4096, None] ^ keys[None, :]) * np.uint64(0x9FB21C651E98DF25)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(best, part.min(axis=0), out=best)
    return (best >> np.uint64(16)).astype(np.uint32).view(np.int32)


def keys(n: int, seed: int = 1) -> np.ndarray:
    """``n`` fixed 64-bit keys."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64)


def piece_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; the ranges follow each other without gaps and none is empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = int(stop[-1])
    power, inverse = _power_tables(n)
    h = np.add.reduceat(_VALUES[data[:n]] * power[:n], start) * inverse[start]
    return mix(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class PieceCache:
    """Results of short byte strings by hash: arrays of integers in one pool. Starts anew beyond ``most`` strings."""

    def __init__(self, most: int = 1 << 19, dtype=np.int32):
        self.most, self.dtype = most, dtype
        self._reset()

    def _reset(self) -> None:
        self.hash, self.pool = np.zeros(0, np.uint64), np.zeros(0, self.dtype)
        self.at, self.size, self.serial = (np.zeros(0, np.int64) for _ in range(3))

    def lookup(self, hashes: np.ndarray, compute) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) in ``pool`` for each hash, and in ``found`` its number in the order in which hashes were first seen.

        ``compute(indices)`` returns the results of unseen ones: a list of arrays, or (all of them flat, starts, sizes).
        """
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hash) > self.most:
            self._reset()
        where = np.searchsorted(self.hash, distinct)
        seen = np.zeros(len(distinct), bool)
        inside = where < len(self.hash)
        seen[inside] = self.hash[where[inside]] == distinct[inside]
        if not seen.all():
            new = compute(first[~seen])
            if isinstance(new, list):
                size = np.fromiter(map(len, new), np.int64, len(new))
                new = np.concatenate([np.zeros(0, self.dtype), *[np.asarray(x, self.dtype) for x in new]]), np.cumsum(size) - size, size
            flat, at, size = new
            at = at + len(self.pool)
            self.pool = np.concatenate((self.pool, flat.astype(self.dtype, copy=False)))
            serial = len(self.hash) + np.arange(len(size))
            h = np.concatenate((self.hash, distinct[~seen]))
            order = np.argsort(h)
            self.hash, self.at, self.size, self.serial = h[order], *(np.concatenate(x)[order] for x in ((self.at, at), (self.size, size), (self.serial, serial)))
            where = np.searchsorted(self.hash, distinct)
        self.found = self.serial[where][inverse]
        return self.at[where][inverse], self.size[where][inverse]


def gathered(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` one after another."""
    total = np.cumsum(size)
    return pool[np.repeat(at - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
