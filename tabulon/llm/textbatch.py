"""Vectorised text primitives over a batch of documents, for use inside Arrow map functions.

A batch is one byte buffer holding the documents in order, each followed by a line feed. Words, lines and windows
are index ranges into it, and substrings are fingerprinted in O(1) from prefix sums, so that the work per byte is a
few numpy passes, whatever the length of a document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Substrings are fingerprinted as polynomials over the integers modulo a Mersenne prime, at one random base: two
#: strings of at most n bytes agree at no more than n of the 2^61 - 1 bases, whatever they look like.
_PRIME = U64((1 << 61) - 1)
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
_BASE = 1_486_902_314_071_852_737
_INVERSE = pow(_BASE, -1, (1 << 61) - 1)
_POWERS: dict[int, np.ndarray] = {}
_BLOCK = 1 << 15  # bytes at a time: they stay in the cache, and their products sum up without overflow
#: Odd factors of the places in a window of words.
FACTOR = np.array([pow(0xC2B2AE3D27D4EB4F, k, 2**64) for k in range(17)], U64)

_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _PRIME) + (x >> U64(61))
    return x - _PRIME * (x >= _PRIME)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 and 30 bits, as 2^61 is one."""
    a0, a1, b0, b1 = a & _LOW31, a >> U64(31), b & _LOW31, b >> U64(31)
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U64(1)) + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of the base, or more."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, U64)
        while len(have) < max(n, 1 << 16):
            have = np.concatenate((have, _times(have, np.full(1, pow(base, len(have), (1 << 61) - 1), U64))))
        if len(have) <= 1 << 21:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Batch:
    """Documents as one buffer. ``start[i]:end[i]`` is document i."""

    def __init__(self, texts: list[bytes | None]):
        texts = [t or b"" for t in texts]
        self.n = len(texts)
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, self.n)
        self.size = sizes
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self._prefix = None

    # -- hashing ---------------------------------------------------------------------------------------------
    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit scrambled fingerprints of buf[start:end], equal for equal bytes."""
        if self._prefix is None:
            n = len(self.buf)
            prefix = np.zeros(n + 1, U64)
            power, done = _powers(_BASE, n), U64(0)
            for at in range(0, n, _BLOCK):
                byte, p = self.buf[at : at + _BLOCK].astype(U64) + U64(1), power[at : min(at + _BLOCK, n)]
                low, high = np.cumsum(byte * (p & _LOW31)), _reduced(np.cumsum(byte * (p >> U64(31))))
                part = _reduced(_reduced(low) + (high >> U64(30)) + ((high & _LOW30) << U64(31)) + done)
                prefix[at + 1 : at + 1 + len(part)] = part
                done = part[-1]
            self._prefix = prefix
        inverse, out = _powers(_INVERSE, len(self.buf) + 1), np.empty(len(start), U64)
        for at in range(0, len(start), _BLOCK):
            a, b = start[at : at + _BLOCK], end[at : at + _BLOCK]
            out[at : at + _BLOCK] = mix(_times(_reduced(self._prefix[b] + _PRIME - self._prefix[a]), inverse[a]))
        return out

    # -- words and lines -------------------------------------------------------------------------------------
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and for each document the index of its first word (n + 1 entries)."""
        space = _WS[self.buf]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        starts, ends = edge[0::2], edge[1::2]
        first = np.searchsorted(starts, np.append(self.start, len(self.buf)))
        return starts, ends, first

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines (line feeds excluded), and the index of each document's first line."""
        ends = np.flatnonzero(self.buf == 10)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        first = np.searchsorted(starts, np.append(self.start, len(self.buf)))
        return starts, ends, first

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Prefix counts of a byte mask, one entry more than bytes."""
        out = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out


def shingles(batch: Batch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word-window hashes: (document index, hash), sorted by both.

    A document with fewer words than a window gives its whole word sequence as one; one without words gives none.
    """
    starts, ends, first = batch.words()
    count = np.diff(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    word = batch.hashes(starts, ends)
    total = len(word)
    value = np.zeros(total, U64)
    window = np.minimum(count, size)
    factor = FACTOR[0]
    of = np.repeat(np.arange(batch.n), count)
    width = window[of]
    for k in range(size):
        part = np.zeros(total, U64)
        part[: total - k] = mix(word[k:] + U64(k)) * factor
        value += np.where(k < width, part, U64(0))
        factor = FACTOR[k + 1]
    at = np.arange(total) - first[of]
    keep = at <= (count - window)[of]
    doc, value = of[keep], mix(value[keep])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def trim() -> None:
    """Give freed memory back, so that a worker that is kept for other stages doesn't hold this one's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", target: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Arrow batches cut into pieces of about ``target`` text bytes (one document at least), with the texts as bytes."""
    for whole in batches:
        i = whole.schema.get_field_index(text)
        size = pc.fill_null(pc.binary_length(whole.column(i)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // target
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                piece = whole.slice(a, b - a)
                yield piece, piece.column(i).cast(pa.large_binary()).to_pylist()
    trim()
