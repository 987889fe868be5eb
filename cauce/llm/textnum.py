"""Vectorised text statistics over blocks of documents (numpy on UTF-8 bytes).

A block is a run of documents joined by ``\\n``; words, lines and n-grams of
all its documents are found with a handful of array passes, and no word or
line crosses a document.  Memory is bounded by the block size (or the longest
single document).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

# Odd multiplier of the polynomial rolling hash and its inverse mod 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93  # of word sequences

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only
_BYTE_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[int, np.ndarray] = {}


def _pow_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * BLOCK_BYTES:  # a table for an exceptionally long text is not kept
            _powers[base] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising 64-bit mixer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges holding at most ``limit`` bytes (or one document)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and idles beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def parts_of(batch, rows: int = 512) -> Iterator:
    """An Arrow batch in slices of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def utf8(column) -> list[bytes]:
    """The values of an Arrow string or binary column as bytes; null counts as empty."""
    return [b"" if v is None else v for v in column.cast("binary").to_pylist()]


class Block:
    """Documents joined by a newline, as bytes; ``lo[i]:hi[i]`` are the bytes of document i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.hi = np.cumsum(size + 1) - 1
        self.lo = self.hi - size
        self.n = len(texts)
        self._prefix: np.ndarray | None = None

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte 0/1 array over each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.hi] - total[self.lo]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the first word index of each document (n + 1 values)."""
        ws = _WS[self.data]
        edge = np.flatnonzero(ws[1:] != ws[:-1]) + 1
        if len(ws) and not ws[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[::2], edge[1::2]
        first = np.append(np.searchsorted(start, self.lo), len(start))
        return start, end, first

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * _pow_table(_P, len(self.data)), out=self._prefix[1:])
        raw = (self._prefix[end] - self._prefix[start]) * _pow_table(_P_INV, len(self.data) + 1)[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(_Q))


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document index of every word, from the first word index of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sequence_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (len - k + 1 values)."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(_Q) + word[j:n + j]
    return mix64(out)


def windows_inside(first: np.ndarray, k: int) -> np.ndarray:
    """Flags, for each position that sequence_hashes covers, whether its k words lie in one document."""
    total = int(first[-1])
    n = max(0, total - k + 1)
    left = np.repeat(first[1:], np.diff(first))[:n]  # end of the document of each word
    return np.arange(n) + k <= left


def keyed(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One 64-bit key for (document, value)."""
    return mix64(value + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(_P))
