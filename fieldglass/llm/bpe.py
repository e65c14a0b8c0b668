"""Byte-level BPE with contiguous rank arrays, equal to the public library's results for the same vocabulary file.

A short word is held as a row of part ids with the rank of each adjacent pair beside it. The row is scanned
for its smallest rank, the boundary there is deleted, and the two neighbouring ranks are looked up again,
until no pair has a rank. Words of one length class are rows of one matrix, so the scan runs over thousands
of words at once. Words over LONG bytes keep linked parts and a heap instead, as scanning would be quadratic.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

#: Longest word, in bytes, that is merged by scanning its rank row.
LONG = 96
_CLASSES = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, LONG)
_NONE = np.int32(2**31 - 1)
_SHIFT = 20
#: Words kept with their ids in one process; beyond this the table is emptied.
CACHE_WORDS = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _ranges(wanted: str, top: int) -> str:
    """The code points up to `top` whose general category starts with `wanted`, as the inside of a character class."""
    out, first, last = [], None, None
    for c in range(top + 1):
        if unicodedata.category(chr(c)).startswith(wanted):
            if last is not None and c == last + 1:
                last = c
                continue
            if first is not None:
                out.append((first, last))
            first = last = c
    out.append((first, last))
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in out)


def _pattern(letter: str, number: str, space: str) -> re.Pattern:
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


#: White space as Unicode's White_Space property has it (fixed values).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=2)
def splitter(latin: bool) -> re.Pattern:
    """Splits text into words before merging; the form for Latin-1 texts has small classes and is several times faster."""
    top = 0xFF if latin else sys.maxunicode
    return _pattern(_ranges("L", top), _ranges("N", top), _SPACE[:6] if latin else _SPACE)


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    return re.compile("[" + _ranges("Cn", sys.maxunicode) + "]")


def split_words(text: str) -> list[str]:
    """The words of a text. Characters newer than this Python's Unicode tables are classed by the library's own splitter."""
    try:
        text.encode("latin-1")
        return splitter(True).findall(text)
    except UnicodeEncodeError:
        pass
    if _unassigned().search(text):
        from tokenizers import pre_tokenizers

        cut = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in cut]
    return splitter(False).findall(text)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size], one after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(starts - (ends - sizes), sizes)
    return flat[np.arange(len(shift)) + shift]


class _Numbered(dict):
    """Numbers words as they are first looked up; `fresh` holds those not merged yet."""

    def __init__(self, known: list[str]):
        super().__init__((w, i) for i, w in enumerate(known))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class RankedBpe:
    """One byte-level BPE vocabulary; `encode` gives ids, `decode` text, `count` only the number of ids."""

    def __init__(self, spec: bytes):
        d = json.loads(spec)
        if d["model"]["type"] != "BPE" or (d.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or d.get("normalizer"):
            raise ValueError("not a byte-level BPE vocabulary")
        vocab: dict[str, int] = d["model"]["vocab"]
        symbol = byte_symbols()
        back = {s: b for b, s in symbol.items()}
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.token: dict[int, bytes] = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        self.token.update({i: s.encode() for s, i in self.special.items()})
        self.first = np.array([vocab[symbol[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in d["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = (left << _SHIFT) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        top = max(self.token) + 1
        self.token_size = np.zeros(top, np.int64)
        for i, t in self.token.items():
            self.token_size[i] = len(t)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(top)), np.uint8)
        self._forget()
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of part ids, or _NONE."""
        wanted = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (right >= 0), self.ranks[at], _NONE)

    def _merge_rows(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row of part ids (padded with -1) as far as ranks go; returns rows and their part counts."""
        done, n = ids.copy(), sizes.copy()
        rows = np.flatnonzero(sizes > 1)
        ids = ids[rows]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        column = np.arange(ids.shape[1] - 1)[None, :]
        while len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            live = best != _NONE
            if not live.all():
                done[rows[~live]] = ids[~live]
                rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
                if not len(rows):
                    break
            each, cut = np.arange(len(rows)), at[:, None]
            shifted = np.take_along_axis(ids, np.where(column > cut, column + 1, column), axis=1)
            shifted[each, at] = self.made[best]
            ids = np.concatenate([shifted, np.full((len(rows), 1), -1)], axis=1)
            kept = np.take_along_axis(ranks, np.minimum(np.where(column >= cut, column + 1, column), ranks.shape[1] - 1), axis=1)
            kept[:, -1] = _NONE
            inner = np.flatnonzero(at + 1 < ids.shape[1])
            kept[inner, np.minimum(at[inner], kept.shape[1] - 1)] = self.rank_of(ids[inner, at[inner]], ids[inner, at[inner] + 1])
            inner = np.flatnonzero(at > 0)
            kept[inner, at[inner] - 1] = self.rank_of(ids[inner, at[inner] - 1], ids[inner, at[inner]])
            ranks = kept
            n[rows] -= 1
        return done, n

    def _merge_long(self, word: bytes) -> tuple[int, ...]:
        """The same merges with linked parts and a heap of (rank, place)."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        size = len(ids)
        before, after = list(range(-1, size - 1)), [*range(1, size), -1]
        arr = np.array(ids)
        initial = self.rank_of(arr[:-1], arr[1:])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(initial.tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -2
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    rank = int(self.rank_of(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if rank != _NONE:
                        heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return tuple(x for x in ids if x != -2)

    def merge_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, words being outputs of `splitter`."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[tuple[int, ...]] = [()] * len(raw)
        low = 0
        for high in _CLASSES:
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in np.array_split(group, len(group) // 4_000 + 1) if len(group) else ():
                n = sizes[part]
                flat = self.first[np.frombuffer(b"".join(raw[i] for i in part.tolist()), np.uint8)]
                ids = np.full((len(part), max(high, 2)), -1, dtype=np.int64)
                ids[np.arange(ids.shape[1])[None, :] < n[:, None]] = flat
                merged, left = self._merge_rows(ids, n)
                for i, row, k in zip(part.tolist(), merged.tolist(), left.tolist(), strict=True):
                    out[i] = tuple(row[:k])
        for i in np.flatnonzero(sizes > LONG).tolist():
            out[i] = self._merge_long(raw[i])
        return out

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; special tokens stand alone."""
        find = split_words
        if not self.cut:
            return [find(t) for t in texts]
        return [find(t) if not any(s in t for s in self.special) else list(chain.from_iterable([p] if p in self.special else find(p) for p in self.cut.split(t))) for t in texts]

    def _forget(self) -> None:
        ids = list(self.special.values())
        self.words = _Numbered(list(self.special))
        self.ids, self.starts, self.sizes = np.array(ids, np.int32), np.arange(len(ids)), np.ones(len(ids), np.int64)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word of all texts, and the number of words of each text."""
        if len(self.words) > CACHE_WORDS:
            self._forget()
        parts = self.pieces(texts)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, int(n.sum()))
        if fresh := self.words.fresh:
            self.words.fresh = []
            merged = self.merge_words(fresh)
            sizes = np.fromiter(map(len, merged), np.int64, len(merged))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(merged), np.int32, int(sizes.sum()))])
        return numbers, n

    def _per_text(self, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offset of each text's first (one more at the end)."""
        numbers, n = self._numbers(texts)
        sizes = self.sizes[numbers]
        return gathered(self.ids, self.starts[numbers], sizes), np.concatenate([[0], np.cumsum(self._per_text(sizes, n))])

    def encode(self, text: str) -> list[int]:
        return self.encode_flat([text])[0].tolist()

    def count_each(self, texts: list[str]) -> np.ndarray:
        numbers, n = self._numbers(texts)
        return self._per_text(self.sizes[numbers], n)

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """A text for each run of ids. Bytes that are not UTF-8 become U+FFFD; unknown ids are left out."""
        ids = np.where((ids >= 0) & (ids < len(self.token_size)), ids, len(self.token_size))
        size, start = np.append(self.token_size, 0)[ids], np.append(self.token_start, 0)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])[offsets]
        raw = gathered(self.token_bytes, start, size).tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_flat(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


_loaded: dict[str, RankedBpe] = {}


def version_of(spec: bytes) -> str:
    """The digest that names a tokenizer's version: SHA-256 of its file."""
    return hashlib.sha256(spec).hexdigest()


def loaded(version: str, spec: bytes) -> RankedBpe:
    """The vocabulary of a file's bytes, parsed once per process."""
    if version not in _loaded:
        _loaded[version] = RankedBpe(spec)
    return _loaded[version]
