"""Word shingles as 64-bit hashes, and Fast Similarity Sketching of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words kept with their hashes in one process.
CACHE_WORDS = 200_000
_U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_hashes = _WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (two xor-shift multiplications)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased and nothing else."""
    return text.encode().lower().split()


def word_hashes(text: str) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of `size` words; a shorter text is one shingle, no words none."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = mixed(total + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit id of a set of shingles; equal sets have equal ids."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def sketch(hashes: np.ndarray, bins: int = 128) -> np.ndarray:
    """A Fast Similarity Sketch (Dahlgaard, Knudsen and Thorup, 2017).

    In each of the first `bins` rounds every element is thrown into one bin, and a bin takes the smallest value
    of the first round that reaches it; the second `bins` rounds throw all elements into bin 0, 1, 2 and so on,
    which fills every coordinate surely. Most sets are done after a few rounds. Coordinates of two sets agree with
    a probability near the sets' resemblance, with concentration as for independent coordinates.
    `bins` is a power of two; `hashes` isn't empty.
    """
    top = _U(64 - bins.bit_length() + 1)
    out, empty = np.zeros(bins, np.uint64), np.ones(bins, bool)
    for i in range(2 * bins):
        v = mixed(hashes + _U((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))
        if i < bins:
            v.sort()
            at = v >> top
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            b, m = at[first].astype(np.int64), v[first]
            fresh = empty[b]
            out[b[fresh]] = m[fresh]
            empty[b] = False
        elif empty[i - bins]:
            out[i - bins], empty[i - bins] = v.min(), False
        if not empty.any():
            break
    return out
