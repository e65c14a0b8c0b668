"""An inverted index of test items with BM25 impacts, searched by block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np

K1, B = 1.2, 0.75
#: Postings in a block of a term's list, and groups of items with bounds of their own for whole passages.
BLOCK, GROUPS = 8, 32
#: Words of an item that are searched as one; longer items are cut into pieces.
PIECE = 256
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def term(word: str) -> str:
    """A word as a term: lower-cased, without punctuation around it."""
    return _EDGES.sub("", word.lower())


def terms(text: str) -> list[str]:
    return [t for w in text.split() if (t := term(w))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The terms of an item's question and answer: the answer is its last sentence; an item of one sentence is both."""
    parts = [p for p in (terms(s) for s in _SENTENCE.split(text)) if p]
    if len(parts) < 2:
        return (parts[0] if parts else []), (parts[0] if parts else [])
    return [t for p in parts[:-1] for t in p], parts[-1]


def overlap(wanted: list[str], have: list[str], size: int = 3) -> float:
    """The share of `wanted`'s distinct runs of `size` terms (fewer if it is shorter) found in `have`."""
    n = min(size, len(wanted))
    if not n:
        return 0.0
    runs = {tuple(wanted[i : i + n]) for i in range(len(wanted) - n + 1)}
    return len(runs & {tuple(have[i : i + n]) for i in range(len(have) - n + 1)}) / len(runs)


class ItemIndex:
    """Pieces of items by number with postings (piece, impact) per term; a piece's impacts sum to 1 over its own terms.

    An item of up to PIECE words is one piece, a longer one several of about equal length. A passage's score for a piece
    is its BM25 score over the score of the piece's own text, so one threshold serves items of every length. `pieces` has
    each piece's item, and how many of the item's words are before and after it. `texts` are texts by id, or (id, text)
    pairs where ids may be null or repeated. `document_frequency`, `items` and `mean_length` are of the whole item table.
    """

    def __init__(self, texts: dict | list[tuple], document_frequency: dict[str, int] | None = None, items: int | None = None, mean_length: float | None = None):
        given = sorted(texts.items() if isinstance(texts, dict) else texts, key=lambda p: (p[0] is None, *p))
        self.ids = [i for i, _ in given]
        tokens = [terms(t) for _, t in given]
        self.parts = [question_and_answer(t) for _, t in given]
        df = document_frequency or Counter(t for ts in tokens for t in set(ts))
        n = items or max(1, len(tokens))
        mean = mean_length or sum(map(len, tokens)) / n or 1.0
        self.vocabulary: dict[str, int] = {}
        lists: list[list[tuple[int, float]]] = []
        self.pieces: list[tuple[int, int, int]] = []
        self.longest, own = 0, []
        for item, ((_, text), ts) in enumerate(zip(given, tokens, strict=True)):
            words = text.split()
            count = -(-len(words) // PIECE)
            if count <= 1:
                self.pieces.append((item, 0, 0))
                own.append(ts)
                self.longest = max(self.longest, len(ts))
                continue
            cuts = [len(words) * k // count for k in range(count + 1)]
            for a, b in zip(cuts, cuts[1:]):
                self.pieces.append((item, a, len(words) - b))
                own.append([t for w in words[a:b] if (t := term(w))])
                self.longest = max(self.longest, b - a)
        for i, ts in enumerate(own):
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ts) / mean)) for t, f in Counter(ts).items()}
            total = sum(impact.values())
            for t, v in impact.items():
                at = self.vocabulary.setdefault(t, len(self.vocabulary))
                if at == len(lists):
                    lists.append([])
                lists[at].append((i, v / total))
        self.items = [[i for i, _ in p] for p in lists]
        self.impacts = [[v for _, v in p] for p in lists]
        self.block_last = [[p[min(k + BLOCK, len(p)) - 1] for k in range(0, len(p), BLOCK)] for p in self.items]
        self.block_max = [[max(p[k : k + BLOCK]) for k in range(0, len(p), BLOCK)] for p in self.impacts]
        self.most = np.array([max(p) for p in self.impacts] + [0.0], np.float64)  # the last entry is for unknown terms
        self.group_most = np.zeros((len(lists) + 1, GROUPS), np.float32)
        for t, (items_of, impacts_of) in enumerate(zip(self.items, self.impacts, strict=True)):
            for i, v in zip(items_of, impacts_of, strict=True):
                g = i * GROUPS // len(self.pieces)
                self.group_most[t, g] = max(self.group_most[t, g], v)
        self.known: dict[str, int] = {}

    def number(self, word: str) -> int:
        """The term number of a raw word; unknown terms share the last."""
        return self.vocabulary.get(term(word), len(self.items))

    def search(self, passage: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (piece, score) with a score of at least `threshold` for a passage's distinct known terms, by block-max WAND."""
        cursors = [[self.items[t][0], 0, t] for t in passage]  # current item, place in the list, term
        end, found = len(self.pieces), []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, skip_to = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for c in cursors[: pivot + 1]:
                b = bisect_left(self.block_last[c[2]], item)
                if b < len(self.block_last[c[2]]):
                    bound += self.block_max[c[2]][b]
                    skip_to = min(skip_to, self.block_last[c[2]][b] + 1)
            if bound < threshold:
                target = max(skip_to, item + 1)  # no item before the nearest block end can reach the threshold
            elif cursors[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    c[1] = bisect_left(self.items[c[2]], target, c[1])
                    c[0] = self.items[c[2]][c[1]] if c[1] < len(self.items[c[2]]) else end
            cursors = [c for c in cursors if c[0] < end]
        return found
