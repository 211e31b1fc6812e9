"""Vectorised text primitives: whole Arrow batches of UTF-8 in, numpy arrays of hashes out.

Texts are laid end to end in one byte buffer with offsets, words are found with a byte table,
and hashed by differences of a wrapping polynomial prefix sum, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 2000
#: Bytes that are hashed at a time, and the longest table of powers that a worker keeps for them.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(1, 2**64, 256, dtype=U64)
_COEF = _rng.integers(1, 2**64, 64, dtype=U64) | U64(1)
_OTHER = _rng.integers(1, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words [^\x20\x09-\x0D]+ and, of lower-cased text, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ . Bytes from 0x80 belong to words in both.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tidy() -> None:
    """Give a worker's free memory back: workers outlive tasks, and the next stage's need theirs too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """run for mapInArrow, followed by tidy()."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return both


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def mix1(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], U64))[0])


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(n, U64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def chunks(off: np.ndarray, max_bytes: int = CHUNK_BYTES, max_docs: int = CHUNK_DOCS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about max_bytes; a longer document is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1
        b = min(max(b, a + 1), a + max_docs, n)
        yield a, b
        a = b


class Words:
    """Words of the documents of one chunk: byte starts and ends, first[i]:first[i+1] are those of document i.

    Bytes are looked at in blocks, so that a very long text needs little beside itself and the places of its words.
    """

    __slots__ = ("buf", "starts", "ends", "first", "n_docs")

    def __init__(self, buf: np.ndarray, off: np.ndarray, lut: np.ndarray = NOT_SPACE, lower: bool = True):
        if lower:
            buf = _LOWER[buf]
        edge = off[1:-1]
        edge = edge[(edge > 0) & (edge < len(buf))]
        starts, ends = [], []
        for a in range(0, len(buf), BLOCK):
            b = min(len(buf), a + BLOCK)
            x, y = max(0, a - 1), min(len(buf), b + 1)
            m = lut[buf[x:y]]
            here = m[a - x : a - x + b - a]
            prev, nxt = np.zeros(b - a, bool), np.zeros(b - a, bool)
            prev[(a == 0) :] = m[: b - a - (a == 0)] if a == 0 else m[: b - a]
            nxt[: y - a - 1] = m[a - x + 1 : a - x + 1 + y - a - 1]
            lo, hi = np.searchsorted(edge, (a, b + 1))
            cut = edge[lo:hi]
            prev[cut[cut < b] - a] = False
            nxt[cut[cut > a] - 1 - a] = False
            starts.append(np.flatnonzero(here & ~prev) + a)
            ends.append(np.flatnonzero(here & ~nxt) + a + 1)
        none = np.zeros(0, np.int64)
        self.buf = buf
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.first = np.searchsorted(self.starts, off)
        self.n_docs = len(off) - 1

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, other: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, found in blocks of whole words; other gives another, independent one."""
        table = _OTHER if other else _BYTE
        out = np.empty(len(self), U64)
        j = 0
        while j < len(self):
            a = int(self.starts[j])
            k = max(j + 1, int(np.searchsorted(self.ends, a + BLOCK, "right")))
            b = int(self.ends[k - 1])
            if b - a > BLOCK:  # one word, longer than a block
                out[j] = _long_hash(self.buf[a:b], table)
            else:
                up, down = _pows(b - a + 1)
                s = np.zeros(b - a + 1, U64)
                np.cumsum(table[self.buf[a:b]] * up[: b - a], out=s[1:])
                out[j:k] = (s[self.ends[j:k] - a] - s[self.starts[j:k] - a]) * down[self.starts[j:k] - a]
            j = k
        return mix(out ^ (self.ends - self.starts).astype(U64))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())


def _long_hash(word: np.ndarray, table: np.ndarray) -> np.uint64:
    up, total = _pows(BLOCK + 1)[0], 0
    for a in range(0, len(word), BLOCK):
        part = word[a : a + BLOCK]
        total += int(np.sum(table[part] * up[: len(part)], dtype=U64)) * pow(_BASE, a, 2**64)
    return U64(total % 2**64)


def shingles(wh: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word shingles (with fewer words the whole sequence is one; without words none) and their offsets."""
    nw = np.diff(first)
    ns = np.where(nw >= k, nw - k + 1, (nw > 0).astype(nw.dtype))
    out = np.zeros(len(ns) + 1, np.int64)
    np.cumsum(ns, out=out[1:])
    n = len(wh)
    acc = np.zeros(n, U64)
    for j in range(min(k, n)):
        acc[: n - j] += wh[j:] * _COEF[j]
    keep = np.ones(n, bool)
    short = (nw > 0) & (nw < k)
    # the last k-1 starts of a document of k words or more are no shingle; of a shorter one only the first is
    for j in range(1, k):
        at = first[1:] - j
        ok = (nw >= k) & (at >= 0)
        keep[at[ok]] = False
        ok = short & (nw - j >= 1)
        keep[at[ok]] = False
    if short.any():
        for d in np.flatnonzero(short):
            w = wh[first[d] : first[d + 1]]
            acc[first[d]] = np.sum(np.append(w * _COEF[: len(w)], _COEF[40 + len(w)]), dtype=U64)
    return mix(acc[keep]), out


def distinct_sets(sh: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(off[:-1], off[1:], strict=True):
        yield np.unique(sh[a:b])
