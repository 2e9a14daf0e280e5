"""A compressed FM-index in numpy: the BWT in a wavelet matrix of packed bits, searched backwards for many at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text sorted by their first `depth` symbols, by doubling; equal ones stay in order of position."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    length = 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        second = np.zeros(n, np.int64)
        second[: n - length] = rank[length:] + 1 if length < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if len(new) and new[-1] == n - 1:
            break
        length *= 2
    return order


class Bits:
    """A bit vector with rank: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.r_[bits, np.zeros(-n % 64 + 64, bool)].astype(np.uint8), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = n - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Of a text of symbols 0..sigma-1, each position of which counts `weight` times.

    Searches are exact for patterns of up to `depth` symbols. The order of the suffixes is only needed to build: what is
    kept is the transformed text, in a wavelet matrix, and the running sums of weights by rank.
    """

    def __init__(self, text: np.ndarray, sigma: int, weight: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        self.weight = np.concatenate(([0], np.cumsum(weight[order])))
        bwt = text[order - 1]
        del order
        self.levels: list[Bits] = []
        for level in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        # Where each symbol's stretch begins at the foot of the matrix.
        self.foot = self._descend(np.zeros(sigma, np.int64), np.arange(sigma))

    def _descend(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for k, bits in enumerate(self.levels):
            one = (symbols >> (top - k) & 1).astype(bool)
            rank = bits.rank(at)
            at = np.where(one, bits.zeros + rank, at - rank)
        return at

    def step(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with symbol + pattern, from those, low <= rank < high, that begin with pattern."""
        both = self._descend(np.concatenate((low, high)), np.concatenate((symbols, symbols)))
        shift = self.below[symbols] - self.foot[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift


def matches(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int, depth: int, probe: int = 4) -> list[list[int]]:
    """Of each pattern text[begin:end], runs (first window, count, ...) of the windows of `span` that occur twice or more.

    From an end e the search goes back while what it has read
    occurs twice, which gives the matching statistic of e, and every window inside is found. Where it fails at symbol i,
    a short probe from i + probe shows, most often, that windows over that stretch are alone, and the search goes on
    before it. All patterns step at once.
    """
    n = len(begin)
    out: list[list[int]] = [[] for _ in range(n)]
    e = end.copy()
    which = np.flatnonzero(e - begin >= span)
    goal = np.full(n, -1)  # of a probe: the symbol that it must not pass
    after = np.zeros(n, np.int64)  # where to go on if it does
    i = e.copy()
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    while len(which):
        going = (i[which] > np.maximum(begin[which], goal[which])) & (e[which] - i[which] < depth)
        more = which[going]
        stop = which[~going]
        failed = np.empty(0, np.int64)
        if len(more):
            a, b = index.step(low[more], high[more], text[i[more] - 1])
            alive = index.weight[b] - index.weight[a] >= 2
            ok = more[alive]
            low[ok], high[ok] = a[alive], b[alive]
            i[ok] -= 1
            failed = more[~alive]
        if len(failed):
            probing = goal[failed] >= 0
            alone = failed[probing & (i[failed] - 1 >= goal[failed])]
            passed = failed[probing & (i[failed] - 1 < goal[failed])]
            plain = failed[~probing]
            _found(out, plain, i, e, begin, span)
            # The symbol before i spoils what ends at e; probe from just after it.
            at, matched = i[plain], e[plain] - i[plain]
            onward = np.where(matched >= span, at + span - 1, e[plain] - 1)
            near = np.minimum(at - 1 + probe, onward)
            shorter = near < onward
            goal[plain] = np.where(shorter, at - 1, -1)
            after[plain] = onward
            e[plain] = near
            # What the probe read is alone, so no window over it repeats: go on with those that end before.
            e[alone] -= 1
            goal[alone] = -1
            e[passed] = after[passed]
            goal[passed] = -1
            _reset(failed, i, e, low, high, len(text))
        if len(stop):
            probing = goal[stop] >= 0
            back = stop[probing]
            e[back] = after[back]
            goal[back] = -1
            plain = stop[~probing]
            _found(out, plain, i, e, begin, span)
            e[plain] = np.where(i[plain] > begin[plain], i[plain] + span - 1, begin[plain])
            _reset(stop, i, e, low, high, len(text))
        which = which[(e[which] - begin[which] >= span) | (goal[which] >= 0)]
    return out


def _found(out: list[list[int]], which: np.ndarray, i: np.ndarray, e: np.ndarray, begin: np.ndarray, span: int) -> None:
    long = which[e[which] - i[which] >= span]
    for k, first, count in zip(long.tolist(), (i[long] - begin[long]).tolist(), (e[long] - i[long] - span + 1).tolist(), strict=True):
        out[k] += [first, count]


def _reset(which: np.ndarray, i: np.ndarray, e: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> None:
    i[which] = e[which]
    low[which], high[which] = 0, n
