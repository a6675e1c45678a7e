"""Words of digits, letters and all other signs beyond ASCII, and CRC-32 of their runs."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from .words import Words, split

# A-Z become a-z; every other ASCII sign that is no digit or letter becomes a blank.
_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[65:91] += 32
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _SIGN[_first : _last + 1] = 0x20

#: Bytes that a step of a checksum advances at most.
STEP = 64


def _table() -> np.ndarray:
    """Remainders of single bytes by the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = _table()


def _zeros() -> np.ndarray:
    """[zeros, k, b]: what byte b at place k of a checksum becomes after that many zero bytes."""
    out = np.empty((STEP + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for i in range(STEP):
        out[i + 1] = _TABLE[out[i] & 255] ^ (out[i] >> 8)
    return out


_ZEROS = _zeros()


def words(texts: pa.Array) -> Words:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts lower-cased in A-Z; null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if data is not None:
        data = pa.py_buffer(_SIGN[np.frombuffer(data, np.uint8)])
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, data], offset=texts.offset)
    return split(plain, lower=False)


def _advanced(sums: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Checksums of A followed by that many bytes B, but for the checksum of B."""
    sums, zeros = sums.copy(), zeros.copy()
    at = np.arange(len(sums))
    while len(at):
        step, old = np.minimum(zeros[at], STEP), sums[at]
        new = _ZEROS[step, 0, old & 255]
        for k in range(1, 4):
            new ^= _ZEROS[step, k, (old >> np.uint32(8 * k)) & 255]
        sums[at] = new
        zeros[at] -= step
        at = at[zeros[at] > 0]
    return sums


def _own(found: Words, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word."""
    sums = np.full(len(size), 0xFFFFFFFF, np.uint32)
    short = np.minimum(size, STEP + 1)  # words over STEP bytes are alike here and stand first
    order = np.argsort(-short.astype(np.int8), kind="stable")
    order = order[int(np.count_nonzero(size > STEP)) :]
    start, size_of = found.start[order], size[order]
    held = np.searchsorted(-size_of, -np.arange(1, STEP + 1), "right")  # words of j bytes or more
    own = sums[order]
    for j, n in enumerate(held):
        if not n:
            break
        own[:n] = _TABLE[(own[:n] ^ found.data[start[:n] + j]) & 255] ^ (own[:n] >> np.uint32(8))
    sums[order] = own ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > STEP):
        sums[i] = zlib.crc32(found.data[found.start[i] : found.end[i]])
    return sums


def run_checksums(found: Words, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(document, CRC-32) of all runs of 1 to ``longest`` words of a document, joined by a blank."""
    size = found.end - found.start
    documents = found.documents()
    own = _own(found, size)
    after_blank = _advanced(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ own
    place = np.arange(len(size)) - found.ptr[:-1][documents]
    sums, at = [own], [documents]
    run = own
    for n in range(1, longest):
        ends = np.flatnonzero(place >= n)
        following = np.zeros(len(size), np.uint32)
        following[ends] = _advanced(run[ends - 1], size[ends] + 1) ^ after_blank[ends]
        run = following
        sums.append(run[ends])
        at.append(documents[ends])
    return np.concatenate(at), np.concatenate(sums)
