"""Word and shingle hashing over Arrow text buffers.

Texts are handled as the UTF-8 bytes that Arrow already holds: no Python string is made per word.
A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Word hashes are 64-bit polynomial
hashes got from one running sum over the bytes, so the cost is a few passes over the text whatever
the number of words. Sequences of words are hashed the same way from the running sum over word hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INV = U(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text that are hashed at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 21
#: Words of more bytes are hashed one by one.
LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_pow = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n."""
    if len(_pow[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(max(n, BLOCK_BYTES + 1), base, U)
            p[0] = 1
            _pow[k] = np.cumprod(p, dtype=U)
    return _pow[0][:n], _pow[1][:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], independent of where the span lies."""
    p, inv = _powers(len(values) + 1)
    run = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[:-1], dtype=U, out=run[1:])
    h = (run[ends] - run[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """The words of a block of documents, one after the other."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """data: bytes of the block; bounds: where each document starts, and the end."""
        self.data = data
        word = ~_SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        self.ends = np.flatnonzero(word & (~after | first[1:])) + 1
        #: self.at[d] is the first word of document d; self.at[-1] the number of words.
        self.at = np.searchsorted(self.starts, bounds)

    def hashes(self, lower: bool = False) -> np.ndarray:
        h = _spans((_BYTE_LOWER if lower else _BYTE)[self.data], self.starts, self.ends)
        # equal polynomial hashes modulo 2**64 can be constructed for long strings
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD):
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
        return h


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word sequence hashes[start:end]."""
    return _spans(hashes, starts, ends)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the bounds of each document's; a document of fewer words,
    but one at least, has its whole sequence as the one shingle."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    bounds = np.concatenate([[0], np.cumsum(count)])
    starts = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - at[:-1], count)
    return spans(hashes, starts, np.minimum(starts + k, np.repeat(at[1:], count))), bounds


def blocks(column: pa.Array, most: int = BLOCK_BYTES):
    """(first row, Words, is null) for runs of rows of at most `most` bytes (one row at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    null = np.asarray(column.is_null())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), null[i:j]
        i = j


def rolling_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
