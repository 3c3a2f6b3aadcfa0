"""Hashes of words and word shingles of many texts at once, as NumPy arrays (runs inside tasks)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of an Arrow batch that are in Python objects at a time.
ROWS_AT_ONCE = 500
#: Bytes of text that are hashed together; one longer text is a piece of its own.
PIECE = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Odd factors for the places of a shingle.
_PLACES = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches; what a finished batch used goes back to the system."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(a, ROWS_AT_ONCE)
        release()


def release() -> None:
    """Give freed memory back: workers live long, and their heaps count against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers = {1: (np.ones(1, np.uint64), np.ones(1, np.uint64))}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, mod 2^64."""
    have = max(_powers)
    if have < n:
        n2 = 1 << (n - 1).bit_length()
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(n2, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers.clear()
        _powers[n2] = (out[0], out[1])
        have = n2
    return _powers[have]


def letters(lower: bool) -> np.ndarray:
    """64-bit value of each byte; A-Z as a-z on request."""
    t = _LETTER.copy()
    if lower:
        t[65:91] = t[97:123]
    return t


SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of other letters.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """(from, to) runs of texts of about PIECE bytes."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def word_hashes(texts: list[bytes], gaps: np.ndarray = SPACES, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offset of each text's first word [+1], start and end of each word in the joined bytes).

    Texts are joined by a blank, so offsets in the joined bytes are those in the text plus the text's own start.
    """
    joined = b" ".join(texts) + b" "
    b = np.frombuffer(joined, np.uint8)
    n = len(b)
    gap = gaps[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(letters(lower)[b] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    lengths = np.array([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    return h, first, start, end


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of k words, offset of each text's first shingle [+1]); a text of fewer words is one shingle."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    at = np.concatenate([[0], np.cumsum(count)])
    m = int(at[-1])
    if not m:
        return np.empty(0, np.uint64), at
    owner = np.repeat(np.arange(len(n)), count)
    pos = np.arange(m) - at[owner] + first[owner]
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    h = np.zeros(m, np.uint64)
    short = n[owner] < k
    for i in range(k):
        w = padded[pos + i]
        if short.any():
            w = np.where(short & (i >= n[owner]), np.uint64(i + 1), w)
        h += w * np.uint64(_PLACES[i % len(_PLACES)] + 2 * (i // len(_PLACES)))
    return mix(h), at


def planes(a: np.ndarray) -> bytes:
    """Numbers as byte planes, so that equal high bytes compress to nothing."""
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()
