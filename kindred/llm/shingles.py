"""Sets of word shingles as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: a public 64-bit mixer's


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * M1
    x = (x ^ (x >> np.uint64(33))) * M2
    return x ^ (x >> np.uint64(33))


def odd(seed: str, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(xxhash.xxh3_64_intdigest(seed))) | np.uint64(1)


PLACE = odd("place", 64)


def word_hashes(text: str | None) -> np.ndarray:
    """Words between ASCII white space, A-Z lower-cased."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, (text or "").encode().lower().split())), ">u8").astype(np.uint64)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes; with fewer words the whole sequence is one shingle; none without words."""
    w = word_hashes(text)
    if len(w) < size:
        return mix((w * PLACE[8 : 8 + len(w)]).sum(dtype=np.uint64, keepdims=True)) if len(w) else w
    s = w[: len(w) - size + 1] * PLACE[0]
    for k in range(1, size):
        s = s + w[k : len(w) - size + 1 + k] * PLACE[k]
    return np.unique(mix(s))


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of the smallest of each permutation's values."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        v = shingles[None, i : i + 1024] * factors[:, None]
        v ^= v >> np.uint64(29)
        low = np.minimum(low, v.min(axis=1))
    return (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
