"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss model.

Features are hashed n-gram indicators in a fixed number of buckets. The log-count ratio of a bucket compares how many
documents of each class have it; indicators times ratios feed a linear model fitted by dual coordinate descent. Its
weights are taken as they are, not interpolated with their mean magnitude. Margins become probabilities by a logistic
curve fitted on margins of rows that the curve's own model did not see, weighted to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import xxhash

from fieldglass.llm.shingles import mixed

_U = np.uint64
BITS = 18
#: Words kept with their hashes in one process.
CACHE_WORDS = 200_000


#: Characters of a text whose n-grams are held at once.
SEGMENT = 1 << 16


def _distinct(parts: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """The sorted distinct buckets of hashes."""
    h = np.concatenate([p >> _U(64 - bits) for p in parts]) if parts else np.zeros(0, _U)
    if len(h) > 1 << (bits - 6):
        seen = np.zeros(1 << bits, bool)
        seen[h.astype(np.int64)] = True
        return np.flatnonzero(seen).astype(np.int32)
    return np.unique(h).astype(np.int32)


class _Words(dict):
    """Numbers words; keeps for each a hash of its lower-cased letters and one of its shape."""

    def __init__(self) -> None:
        super().__init__()
        self.core: list[int] = []
        self.shape: list[int] = []
        self.done = [np.zeros(0, _U), np.zeros(0, _U)]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        letters = "".join(c for c in word if c.isalnum())
        case = "U" if letters.isupper() and len(letters) > 1 else "T" if letters[:1].isupper() else "l"
        marks = "".join("0" if c.isdigit() else c for c in word if not c.isalpha())
        self.core.append(xxhash.xxh64_intdigest(letters.lower(), 1))
        self.shape.append(xxhash.xxh64_intdigest(f"{case if letters else ''}{marks[:6]}", 2))
        return n

    def arrays(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.core:
            self.done = [np.concatenate([d, np.array(n, _U)]) for d, n in zip(self.done, (self.core, self.shape), strict=True)]
            self.core, self.shape = [], []
        return self.done[0][numbers], self.done[1][numbers]


_words = _Words()


def word_features(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """Buckets of words, word pairs, word shapes and shape pairs of each text; pairs of one word twice are one feature."""
    global _words
    if len(_words) > CACHE_WORDS:
        _words = _Words()
    parts = [t.split() for t in texts]
    sizes = [len(p) for p in parts]
    core, shape = _words.arrays(np.fromiter(map(_words.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes)))
    out, at = [], 0
    for n in sizes:
        c, s = core[at : at + n], shape[at : at + n]
        at += n
        pair = mixed(c[:-1] * _U(3) + c[1:])
        pair[c[:-1] == c[1:]] = _U(0x5851F42D4C957F2D)
        out.append(_distinct([mixed(c), pair, mixed(s + _U(17)), mixed(s[:-1] * _U(5) + s[1:])], bits))
    return out


def char_features(texts: list[str], bits: int = BITS, orders: Sequence[int] = (3, 4, 5)) -> list[np.ndarray]:
    """Buckets of the character n-grams of each lower-cased text, with a space before and after it; a long text is taken segment by segment."""
    out = []
    for t in texts:
        codes = np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32)
        found: list[np.ndarray] = []
        for begin in range(0, len(codes), SEGMENT):
            x = codes[begin : begin + SEGMENT + max(orders) - 1].astype(_U)  # n-grams at the end belong to the next segment as well
            h, parts = x, []
            for n in range(2, max(orders) + 1):
                h = h[:-1] * _U(0x100000001B3) + x[n - 1 :]
                if n in orders and len(h):
                    parts.append((h + _U(n)) * _U(0x9E3779B97F4A7C15))
            found = [_distinct(parts, bits)] if not found else [np.union1d(found[0], _distinct(parts, bits))]
        out.append(found[0])
    return out


#: Rows whose buckets are counted at once.
COUNTED = 64


def ratios(rows: Sequence[np.ndarray], labels: np.ndarray, bits: int = BITS, prior: float = 20.0) -> np.ndarray:
    """The log-count ratio of each bucket between the classes; `prior` counts are added in the classes' proportion, so that rare buckets stay near 0."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    pos, neg = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for i in range(0, len(rows), COUNTED):  # all rows at once would be held three times, as 64-bit numbers too
        for total, ones in ((pos, True), (neg, False)):
            if part := [r for r, y in zip(rows[i : i + COUNTED], labels[i : i + COUNTED], strict=True) if (y > 0) == ones]:
                total += np.bincount(np.concatenate(part), minlength=len(total))
    return np.log(((pos + prior * n1 / (n1 + n0)) / n1) / ((neg + prior * n0 / (n1 + n0)) / n0))


#: A row is divided by its squared length to this power: less than unit scaling, so that few strong n-grams still tell in a long text.
POWER = 0.25


def norm(values: np.ndarray) -> float:
    """What a row is divided by."""
    return max(1e-9, float(np.square(values, dtype=np.float64).sum()) ** POWER)


def dual_descent(rows: Sequence[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float, epochs: int = 8, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model by dual coordinate descent; rows are divided by `norm`."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(scale)), 0.0
    scale = scale.astype(np.float32)
    divisor = np.array([norm(scale[r]) for r in rows])  # rows themselves are scaled anew at each visit: kept, they would be most of the memory
    square = np.array([np.square(scale[r]).sum() for r in rows]) / divisor**2 + 1.0
    upper = cost * np.where(labels > 0, 0.5 * len(labels) / max(1, (labels > 0).sum()), 0.5 * len(labels) / max(1, (labels <= 0).sum()))
    alpha = np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, y = rows[i], labels[i]
            v = scale[r] / divisor[i]
            grad = y * ((w[r] * v).sum() + b) - 1.0
            new = min(max(alpha[i] - grad / square[i], 0.0), upper[i])
            if new != alpha[i]:
                d = (new - alpha[i]) * y
                w[r] += d * v
                b += d
                alpha[i] = new
    return w, b


@dataclass
class Model:
    """A fitted model: `weights` by bucket (already times ratios), ratios for the row norm, bias and logistic curve."""

    weights: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(dtype=np.float64) / norm(self.ratio[r]) for r in rows]) + self.bias

    def probabilities(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -500, 500)))


def _logistic(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve through margins (Newton steps, lightly regularised)."""
    x = np.stack([margins, np.ones_like(margins)])
    y, theta = (labels > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        g = x @ (weights * (p - y)) + 1e-3 * theta
        h = (x * (weights * p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, share: float, bits: int = BITS, cost: float = 1.0, folds: int = 4) -> Model:
    """Fits a model to rows of buckets and labels of +1 and -1; `share` is the true share of +1."""

    def one(rows: Sequence[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        ratio = ratios(rows, labels, bits)
        w, b = dual_descent(rows, labels, ratio, cost)
        return (w * ratio).astype(np.float32), ratio.astype(np.float32), b

    labels = np.asarray(labels)
    if len(set(np.sign(labels).tolist())) < 2:  # one class or no rows: its share for every text
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << bits, np.float32), np.ones(1 << bits, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    fold, margins = np.arange(len(rows)) % folds, np.zeros(len(rows))
    for f in range(folds):
        train = np.flatnonzero(fold != f)
        if len(set(np.sign(labels[train]).tolist())) == 2:
            m = Model(*one([rows[i] for i in train], labels[train]), 1.0, 0.0)
            test = np.flatnonzero(fold == f)
            margins[test] = m.margins([rows[i] for i in test])
    n1 = max(1, (labels > 0).sum())
    weights = np.where(labels > 0, share / n1, (1 - share) / max(1, len(labels) - n1)) * len(labels)
    slope, shift = _logistic(margins, labels, weights)
    return Model(*one(rows, labels), slope, shift)


Features = Callable[[list[str]], list[np.ndarray]]
