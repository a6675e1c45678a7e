"""Words of whole texts as arrays: one pass over the bytes of an Arrow column.

A word is a longest run of bytes other than blank and the controls 9 to 13, which
in UTF-8 are always characters of their own. Only A-Z are lower-cased, on request.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
#: Bytes of text that are worked on at a time.
BLOCK = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_KEY = mix(np.arange(256, dtype=np.uint64))


@dataclass
class Words:
    """Word i is data[start[i]:end[i]]; document d has the words ptr[d]:ptr[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for equal words anywhere."""
        out = np.empty(len(self.start), np.uint64)
        if not len(out):
            return out
        span = np.append(self.start[1:], self.end[-1])  # up to the next word
        at = 0
        while at < len(out):
            upto = max(at + 1, int(np.searchsorted(span, self.start[at] + BLOCK, "right")))
            lo, hi = self.start[at], self.end[upto - 1]
            first = self.start[at:upto] - lo
            piece = self.data[lo:hi]
            key = _BYTE_KEY[piece]
            key[_SPACE[piece]] = 0
            place = np.arange(hi - lo) - np.repeat(first, np.diff(np.append(first, hi - lo)))
            key *= mix(np.arange(int(place.max()) + 1, dtype=np.uint64))[place] | np.uint64(1)
            out[at:upto] = np.add.reduceat(key, first)
            at = upto
        return mix(out + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def documents(self) -> np.ndarray:
        """Number of the document of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def split(texts: pa.Array, lower: bool) -> Words:
    """The words of a column of texts; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[lo:hi] if hi > lo else np.empty(0, np.uint8)
    offsets = offsets - lo
    inside = ~_SPACE[data]
    joined = np.zeros(len(data) + 1, bool)  # joined[i]: byte i continues the word of byte i - 1
    joined[1:-1] = inside[1:] & inside[:-1]
    joined[offsets] = False
    start = np.flatnonzero(inside & ~joined[:-1])
    end = np.flatnonzero(inside & ~joined[1:]) + 1
    return Words(_LOWER[data] if lower else data, start, end, np.searchsorted(start, offsets))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text; a longer text is alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // size
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), batch.num_rows)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts (or sums of weights)."""
    if weights is None:
        found, counts = np.unique(keys, return_counts=True)
        return found, counts.astype(np.int64)
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, weights, len(found)).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
