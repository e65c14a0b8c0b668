"""The levels of an n-gram model as flat arrays that are mapped from a file and searched in place.

`Words` is the level of single words: an Elias-Fano sequence of word hashes with a count each. `Trie` has the levels of
pairs: an Elias-Fano sequence of the contexts' numbers; monotone pointers, in Elias-Fano form as well, from each context
to where its successors begin; the successors of all contexts, made one rising sequence by adding to each context's own
what the sequence before it ended with; and a quantised probability for each pair. A pair is found by its context's rank,
the two pointers there, and a search for the successor relative to the context within that range.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64
#: Quantisation steps per power of ten.
STEPS = 25


def quantised(log10p: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of log10 probabilities, in steps of 1 / STEPS; 0 is kept for what isn't there."""
    return np.clip(np.rint(-log10p * STEPS) + 1, 1, 255).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    return (1.0 - codes.astype(np.float64)) / STEPS


class EliasFano:
    """A rising sequence of numbers below `universe`; each has its low bits packed and its high bits in a unary bit vector."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs = n, low_bits, lows, highs
        ones = np.bitwise_count(highs).astype(np.int64)
        self.before = [np.concatenate([[0], np.cumsum(64 - ones)]), np.concatenate([[0], np.cumsum(ones)])]  # zeros and ones before each word

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = min(63, max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1))
        high = (values >> _U(low_bits)).astype(np.int64)
        size = n + (int(universe - 1) >> low_bits) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").view(_U)
        lows = np.zeros(n * low_bits // 64 + 2, _U)
        if low_bits:
            low = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.bitwise_or.at(lows, word, low << shift)
            over = np.flatnonzero(shift + _U(low_bits) > _U(64))
            np.bitwise_or.at(lows, word[over] + 1, low[over] >> (_U(64) - shift[over]))
        return cls(n, low_bits, lows, highs)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        rest = (self.lows[word + 1] << ((_U(64) - shift) & _U(63))) * (shift > _U(0))
        return ((self.lows[word] >> shift) | rest) & _U((1 << self.low_bits) - 1)

    def _select(self, bit: int, k: np.ndarray) -> np.ndarray:
        """The place of the k-th bit of that kind (from 0) in the unary bits."""
        before = self.before[bit]
        word = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for s in range(0, len(k), 1 << 14):
            w = word[s : s + (1 << 14)]
            bits = np.unpackbits(self.highs[w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            nth = np.cumsum(bits == bit, axis=1, dtype=np.uint8)
            out[s : s + (1 << 14)] = w * 64 + (nth == (k[s : s + (1 << 14)] - before[w] + 1)[:, None]).argmax(axis=1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        if not len(i):
            return np.zeros(0, _U)
        return ((self._select(1, i) - i).astype(_U) << _U(self.low_bits)) | self._low(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found): for each x below the universe the place of its successor (the first value of x or more, or n), and whether that is x."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = (x >> _U(self.low_bits)).astype(np.int64)
        begin = np.where(high > 0, self._select(0, np.maximum(high - 1, 0)) - high + 1, 0)
        end = self._select(0, high) - high
        last, want = end.copy(), x & _U((1 << self.low_bits) - 1)
        while len(live := np.flatnonzero(begin < end)):  # binary search among the values with that high part
            mid = (begin[live] + end[live]) >> 1
            less = self._low(mid) < want[live]
            begin[live[less]], end[live[~less]] = mid[less] + 1, mid[~less]
        found = begin < last
        found[found] = self._low(begin[found]) == want[found]
        return begin, found


class _Levels:
    """Named flat arrays, to and from bytes; as read they are views of the buffer."""

    KINDS: dict[str, type] = {}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    def _sequence(self, name: str) -> EliasFano:
        n, low_bits = self.arrays[f"{name}_shape"].tolist()
        return EliasFano(n, low_bits, self.arrays[f"{name}_low"], self.arrays[f"{name}_high"])

    @staticmethod
    def _parts(name: str, sequence: EliasFano) -> dict[str, np.ndarray]:
        return {f"{name}_shape": np.array([sequence.n, sequence.low_bits], np.int64), f"{name}_low": sequence.lows, f"{name}_high": sequence.highs}

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(self.arrays[f], k) for f, k in self.KINDS.items()]
        sizes = np.array([p.nbytes for p in parts], np.int64)
        return b"".join([sizes.tobytes(), *(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)])

    @classmethod
    def of_buffer(cls, buffer):
        sizes = np.frombuffer(buffer, np.int64, len(cls.KINDS))
        arrays, at = {}, sizes.nbytes
        for (f, kind), n in zip(cls.KINDS.items(), sizes.tolist(), strict=True):
            arrays[f] = np.frombuffer(buffer, kind, n // np.dtype(kind).itemsize, at)
            at += n + -n % 8
        return cls(arrays)

    @classmethod
    def mapped(cls, body: bytes):
        """The levels in a file of this process that is mapped and goes with it: a copy of what the shared folder holds."""
        with tempfile.TemporaryFile() as f:
            f.write(body)
            f.flush()
            return cls.of_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Words(_Levels):
    """Word hashes below `universe` and the count of each; a word's number is its rank."""

    KINDS = {"words_shape": np.int64, "words_low": _U, "words_high": _U, "counts": np.int64}

    def __init__(self, arrays: dict[str, np.ndarray]):
        super().__init__(arrays)
        self.words, self.counts = self._sequence("words"), arrays["counts"]

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray, universe: int) -> Words:
        """From sorted distinct hashes."""
        return cls(cls._parts("words", EliasFano.build(hashes, universe)) | {"counts": counts})

    def search(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, count) of each word; -1 and 0 where the level doesn't have it."""
        at, found = self.words.find(hashes)
        count = np.zeros(len(hashes), np.int64)
        count[found] = self.counts[at[found]]
        return np.where(found, at, -1), count


class Trie(_Levels):
    """Contexts, pointers to the successors of each, successors, and a code per pair."""

    KINDS = {f"{s}_{p}": k for s in ("contexts", "pointers", "successors") for p, k in (("shape", np.int64), ("low", _U), ("high", _U))} | {"codes": np.uint8}

    def __init__(self, arrays: dict[str, np.ndarray]):
        super().__init__(arrays)
        self.contexts, self.pointers, self.successors = (self._sequence(s) for s in ("contexts", "pointers", "successors"))
        self.codes = arrays["codes"]

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, codes: np.ndarray) -> Trie:
        """From numbers of contexts and successors, sorted, without duplicates."""
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        own = context[heads].astype(_U)
        rising = np.cumsum(rises(successor.astype(np.int64), heads)).astype(_U)
        top = lambda x: int(x[-1]) + 1 if len(x) else 1
        parts = cls._parts("contexts", EliasFano.build(own, top(own))) | cls._parts("successors", EliasFano.build(rising, top(rising)))
        parts |= cls._parts("pointers", EliasFano.build(np.append(heads, len(context)).astype(_U), len(context) + 1))
        return cls(parts | {"codes": codes})

    def search(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 where the trie doesn't have it."""
        out = np.zeros(len(context), np.uint8)
        if not self.successors.n:
            return out
        asked, own = np.unique(context, return_inverse=True)
        inside = asked < self.contexts.get(np.array([self.contexts.n - 1]))[0] + _U(1)
        rank, known = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        rank[inside], known[inside] = self.contexts.find(asked[inside].astype(_U))
        begin, end, base = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros(len(asked), _U)
        begin[known] = self.pointers.get(rank[known]).astype(np.int64)
        end[known] = self.pointers.get(rank[known] + 1).astype(np.int64)
        later = known & (begin > 0)
        base[later] = self.successors.get(begin[later] - 1)
        top = np.zeros(len(asked), _U)
        top[known] = self.successors.get(end[known] - 1)
        wanted = base[own] + successor.astype(_U) + _U(1)
        ok = np.flatnonzero(known[own] & (wanted <= top[own]))  # what lies beyond the context's last successor isn't its own
        at, found = self.successors.find(wanted[ok])
        out[ok[found]] = self.codes[at[found]]
        return out


def rises(successor: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The steps of the rising sequence of successors (sorted within runs that begin at `heads`): at a head its number and one, else the distance to the one before."""
    out = np.diff(successor, prepend=0)
    out[heads] = successor[heads] + 1
    return out


def of_rises(steps: np.ndarray, heads: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The successors that `rises` made steps of; `runs` are the lengths of the runs."""
    total = np.cumsum(steps)
    return total - np.repeat(total[heads] - steps[heads], runs) - 1
