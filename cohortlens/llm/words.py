"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  In UTF-8 those
six code points are single bytes that occur in no longer sequence, so the byte
scan finds the same words as a scan of code points.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text worked on at once; a longer text is one chunk by itself.
CHUNK_BYTES = 2 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


@contextlib.contextmanager
def tidy_worker() -> Iterator[None]:
    """For the body of a task: what it has freed goes back to the system at its
    end.  Spark keeps Python workers for later tasks, of other stages too, and
    allocators keep what they were once given."""
    try:
        yield
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


class Hasher:
    """64-bit hashes of byte ranges, by a polynomial over one array of bytes.

    One object serves a task: it holds the powers of the base, and of its
    inverse modulo 2**64, for the longest array so far.
    """

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.powers) <= n:
            both = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                p = np.full(n + 1 + n // 8, base, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.powers, self.inverse = both
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data] * self.powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    """``starts``/``ends``: byte range of each word in ``data``; ``doc``: the
    index of its text; ``first``: index of each text's first word (one more
    entry at the end); ``begin``: byte at which each text begins."""
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def hashes(self, hasher: Hasher) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hasher.ranges(self.data, self.starts, self.ends)


def scan(texts: list[bytes], lower: bool = False) -> Words:
    """Words of ``texts``; ``lower`` maps A-Z to a-z first."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _IS_SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.ones(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=begin[1:])
    begin[1:] += 1
    first = np.searchsorted(starts, begin)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, starts, ends, doc, first, begin)


def chunks(texts: Iterable[bytes], limit: int = CHUNK_BYTES, most: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together, ``most`` of them at
    most, with the index of the first; every text is in exactly one chunk, whole."""
    part: list[bytes] = []
    at = size = 0
    for i, t in enumerate(texts):
        if part and (size + len(t) > limit or len(part) == most):
            yield at, part
            part, at, size = [], i, 0
        part.append(t)
        size += len(t)
    if part:
        yield at, part


def shingles(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``k`` words of one text; a text of
    1 to k-1 words gives its whole sequence as one shingle."""
    n = len(hashes)
    mult = np.uint64(0x9E3779B97F4A7C15)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        runs = runs * mult + hashes[j:j + len(runs)]
    counts = np.diff(words.first)
    whole = words.doc[:len(runs)] == words.doc[k - 1:] if len(runs) else np.zeros(0, bool)
    h, d = [mix(runs[whole])], [words.doc[:len(runs)][whole]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        x = np.array([counts[i]], np.uint64)
        for j in range(words.first[i], words.first[i + 1]):
            x = x * mult + hashes[j:j + 1]
        h.append(mix(x ^ np.uint64(0xD6E8FEB86659FD93)))
        d.append(np.array([i]))
    return np.concatenate(h), np.concatenate(d)
