"""Character n-grams of whole texts as arrays of numbers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import mix

#: Code of everything between words.
EDGE = 1


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def spelled(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters; what lies between words is one EDGE."""
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes[~letter] = EDGE
    codes = np.concatenate([[EDGE], codes, [EDGE]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != EDGE) | (codes[:-1] != EDGE)
    return codes[keep]


def packed(codes: np.ndarray, n: int) -> np.ndarray:
    """n-grams (n up to 3) as exact numbers of n x 21 bits, a lone EDGE left out."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.int64)
    out = codes[:count].copy()
    for i in range(1, n):
        out <<= 21
        out |= codes[i : i + count]
    return out[out != EDGE] if n == 1 else out


def buckets(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of the n-grams of all ``sizes``: hashes of ``bits`` bits."""
    found = []
    for n in sizes:
        count = len(codes) - n + 1
        if count > 0:
            h = np.full(count, n, np.uint64)
            for i in range(n):
                h = (h + codes[i : i + count].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            found.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)
