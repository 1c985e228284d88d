"""Character n-grams of many words at once, hashed to buckets."""

from __future__ import annotations

import numpy as np

_ODD = np.random.default_rng(20240101).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_buckets(words: list[str], sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word between marks of its ends, and of the word itself; and whose each is."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    cp = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    owner, place = np.repeat(np.arange(len(words)), lengths), np.arange(len(cp))
    room = np.repeat(ends, lengths) - place
    flat, whose = [], []
    for n in sizes:
        m = len(cp) - n + 1
        if m < 1:
            continue
        h = cp[:m] * _ODD[0]
        for j in range(1, n):
            h += cp[j : m + j] * _ODD[j]
        ok = room[:m] >= n
        flat.append(h[ok] + _ODD[40 + n])
        whose.append(owner[:m][ok])
    inside = place - np.repeat(ends - lengths, lengths)
    flat.append(np.add.reduceat((cp + np.uint64(1)) * _ODD[inside % 40] * (inside // 40 * 2 + 1).astype(np.uint64), ends - lengths))
    whose.append(np.arange(len(words)))
    h = np.concatenate(flat)
    h = (h ^ (h >> np.uint64(32))) * _ODD[63]
    return (h >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(whose)


def sums(table: np.ndarray, flat: np.ndarray, whose: np.ndarray, n: int) -> np.ndarray:
    """Sum of the table's rows over each word's buckets."""
    out = np.empty((n, table.shape[1]), np.float32)
    for k in range(table.shape[1]):
        out[:, k] = np.bincount(whose, table[flat, k], n)
    return out
