"""Suffix order, longest previous factors, and anchors that equal byte strings share."""

from __future__ import annotations

import numpy as np

from fieldglass.llm.shingles import mixed

_U = np.uint64
#: Bytes of a gram whose hash can be an anchor, and bits that hold a place.
GRAM, PLACE = 64, 24
SEGMENT = 1 << 22


def _ranked(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)
    ordered = key[order]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(np.concatenate([[False], ordered[1:] != ordered[:-1]]), dtype=np.int32)
    return out


def prefix_ranks(data: np.ndarray, width: int) -> list[tuple[int, np.ndarray]]:
    """(length, the rank of each suffix of `data` by its first `length` bytes) for 8, 16, 32, ... and at last `width` bytes.

    Prefix doubling: ranks by 8 bytes come from big-endian words, ranks by twice the length from pairs of ranks.
    Places nearer to the end than the length are ranked as if zero bytes followed.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(n, _U)
    for i in range(8):
        word <<= _U(8)
        word |= padded[i : i + n]
    rank, have = _ranked(word), 8
    del word
    out = [(have, rank)]
    while have < width:
        step = min(have, width - have)
        pair = rank * np.int64(n + 1)
        if step < n:
            pair[: n - step] += rank[step:]
        rank = _ranked(pair)
        have += step
        out.append((have, rank))
    return out


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place of `values` (all different) the nearest place before it with a smaller value, or -1; all places look at once, each through what others have found."""
    found = np.arange(-1, len(values) - 1)
    live = np.flatnonzero(found >= 0)
    while len(live):
        live = live[values[found[live]] > values[live]]
        found[live] = found[found[live]]
        live = live[found[live] >= 0]
    return found


def _common(levels: list[tuple[int, np.ndarray]], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The common prefix of the suffixes at `one` and at `two`, up to the last level's length; under that in steps of 8 bytes."""
    width, whole = levels[-1]
    equal = whole[one] == whole[two]
    out = np.where(equal, width, 0)
    rest = np.flatnonzero(~equal)
    one, two = one[rest], two[rest]
    have = np.zeros(len(rest), np.int64)
    for length, rank in reversed(levels[:-1]):
        last = len(rank) - 1
        a, b = one + have, two + have
        have += np.where((np.maximum(a, b) <= last) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)]) & (have + length < width), length, 0)
    out[rest] = have
    return out


def previous_factors(data: np.ndarray, starts: np.ndarray, width: int, both: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(LPF, LNF, all 0 without `both`) for each place in `starts` (ascending): the longest prefix of its suffix that also starts at an earlier, or later, place in `starts`, up to `width`.

    In suffix order the longest match before a place begins at the previous or at the next smaller place (Crochemore and
    Ilie, 2008), and the longest match after it at the previous or next greater one. Suffixes equal in `width` bytes are
    in the order of their places, so the smaller neighbour of one is before it and the greater one after it. Lengths
    under `width` are in steps of 8 bytes.
    """
    levels = prefix_ranks(data, width)
    m = len(starts)
    order = np.argsort(levels[-1][1][starts].astype(np.int64) * m + np.arange(m))
    out = [np.zeros(m, np.int64), np.zeros(m, np.int64)]
    for best, place in zip(out, (order, m - 1 - order) if both else (order,)):  # by place, and by place from the end
        for before in (True, False):
            near = previous_smaller(place if before else place[::-1])
            has = np.flatnonzero(near >= 0)
            i, j = (has, near[has]) if before else (m - 1 - has, m - 1 - near[has])
            best[order[i]] = np.maximum(best[order[i]], _common(levels, starts[order[i]], starts[order[j]]))
    return out[0], out[1]


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchors of a text's windows of `width` bytes.

    A window's anchor is the gram in it with the smallest hash, the leftmost of equals, so equal windows have equal
    anchors at equal places. Runs of windows first..last share one; there is about one anchor in 170 bytes.
    """
    found = []
    for begin in range(0, max(1, len(data) - width + 1), SEGMENT):
        part = data[begin : begin + SEGMENT + width - 1]
        if len(part) < width:
            break
        h = mixed(part.astype(_U) + _U(0x9E3779B97F4A7C15))
        m = 1
        while m < GRAM:
            h = h[:-m] * _U(0xD6E8FEB86659FD93) + h[m:]
            h ^= h >> _U(29)
            m *= 2
        h = mixed(h)
        w, n = width - GRAM + 1, len(part) - width + 1
        mask = _U((1 << PLACE) - 1)
        v = (h & ~mask) | np.arange(len(h), dtype=_U)
        padded = np.full(-(-len(v) // w) * w, ~_U(0))
        padded[: len(v)] = v
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        place = (least & mask).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        place = place[first]
        found.append((h[place].view(np.int64), place + begin, first + begin, last + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
