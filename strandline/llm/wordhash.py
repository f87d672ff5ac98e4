"""64-bit hashes of words and of runs of words, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import xxhash

#: Entries that a worker's cache of word hashes holds before it starts afresh.
CACHE = 200_000


class _Words(dict):
    """Word to hash; each distinct word is hashed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_seen = _Words()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text); words end at ASCII white space."""
    if len(_seen) > CACHE:
        _seen.clear()
    cuts = [t.split() for t in texts]
    counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
    return np.fromiter(map(_seen.__getitem__, chain.from_iterable(cuts)), np.uint64, int(counts.sum())), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hash of each run of ``n`` consecutive entries of ``h`` (fewer by n - 1), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, step, power = None, 0, h, base
    size, keep = 1, n
    # Binary digits of n from the lowest: each adds a run of that length in front of what is done.
    while keep:
        if keep & 1:
            if out is None:
                out, done, scale = step, size, power
            else:
                out = step[: len(h) - size - done + 1] * np.uint64(scale) + out[size : len(h) - done + 1]
                done, scale = done + size, scale * power % 2**64
        keep >>= 1
        if keep:
            step = step[:-size] * np.uint64(power) + step[size:]
            power = power * power % 2**64
            size *= 2
    return out


def lowest(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive entries."""
    size, keep = 1, x
    while size * 2 <= n:
        keep = np.minimum(keep[:-size], keep[size:])
        size *= 2
    return np.minimum(keep[: len(x) - n + 1], keep[n - size :])


def pieces(sizes: list[int], most: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of at most ``most`` bytes in all, or of one larger row."""
    start = held = 0
    for i, s in enumerate(sizes):
        if held and held + s > most:
            yield start, i
            start, held = i, 0
        held += s + 1
    if start < len(sizes):
        yield start, len(sizes)
