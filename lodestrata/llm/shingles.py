"""Hashed word shingles of whole batches of texts, in array operations."""

from __future__ import annotations

import numpy as np

_A = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words, number of words per text); A-Z count as a-z.

    A word's hash adds its bytes, each times a pseudo-random number of its place.
    """
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    inside = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    first, last = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(first, bounds), prepend=0)
    if not len(first):
        return np.zeros(0, dtype=np.uint64), counts
    length = last - first
    places = mixed((np.arange(int(length.max()), dtype=np.uint64) + np.uint64(1)) * _A) | np.uint64(1)
    used = np.flatnonzero(inside)
    place = np.arange(len(used)) - np.repeat(np.cumsum(length) - length, length)
    weighted = (data[used].astype(np.uint64) + np.uint64(1)) * places[place]
    return mixed(np.add.reduceat(weighted, np.cumsum(length) - length) + length.astype(np.uint64) * _A), counts


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word ``size``-grams.

    A text with fewer words has its whole sequence as one; without words: none.
    """
    words, counts = word_hashes(texts)
    out, at = [], 0
    grams = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        grams = mixed(grams * _A + words[k : k + len(grams)])
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[at : at + n]:
                h = mixed(np.array([h], dtype=np.uint64) * _A + w)[0]
            out.append(np.array([h], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out
