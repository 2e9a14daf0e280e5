"""Vectorised words and window hashes over Arrow batches of texts.

Every word class used here splits UTF-8 text at ASCII bytes only, so words are found on the raw bytes and no text is
decoded. Work goes on in slices of about SLICE bytes whatever the size of an Arrow batch; a single longer text makes a
slice of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 56
_SIP = (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)
_LEFT, _RIGHT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Everything but space and \t..\r.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[tuple, np.ndarray] = {}


def powers(base: int, n: int, kind: type = np.uint64) -> np.ndarray:
    """base**0 .. base**n modulo the range of the kind; those of short texts are kept."""
    have = _powers.get((base, kind))
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 1 << 18), base, kind)
        out[0] = 1
        have = np.cumprod(out, dtype=kind)
        if len(have) <= 1 << 21:
            _powers[base, kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Prefix:
    """Hashes of any run values[s:e], from prefix sums of a polynomial."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        self.inverse = powers(pow(base, -1, 1 << 64), n)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * powers(base, n)[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def windows(self, n: int) -> np.ndarray:
        """Of each window of n values, by its start."""
        count = max(0, len(self.sums) - n)
        return mix((self.sums[n:] - self.sums[:count]) * self.inverse[:count])


def lean(run: Callable) -> Callable:
    """run, for mapInArrow; what it has freed goes back to the system at the end of each partition.

    Workers are kept for later tasks, beside a JVM that may by then need all of its own memory.
    """

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about limit bytes together."""
    if batch.num_rows == 0:
        return
    _, at = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """The words of a column of texts.

    raw: bytes, at: offsets of texts in raw, start/end: offsets of words in raw, first: index of each text's first word
    and, last, the number of words.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray = NONSPACE, lower: bool = False):
        self.raw, self.at = text_bytes(column)
        if lower:
            self.raw = LOWER[self.raw]
        word = inside[self.raw]
        n = len(word)
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        begins, ends = word.copy(), word.copy()
        if n:
            begins[1:] &= ~word[:-1] | edge[1:n]
            ends[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, block: int = 1 << 15) -> np.ndarray:
        """A 64-bit hash of each word: SipHash-1-3, so no pattern of bytes makes terms cancel out as in a polynomial."""
        eight = lanes(self.raw)
        out = np.empty(len(self.start), np.uint64)
        for a in range(0, len(out), block):
            out[a : a + block] = _sip(eight, self.start[a : a + block], self.end[a : a + block] - self.start[a : a + block])
        for k in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            out[k] = int.from_bytes(digest(self.raw[self.start[k] : self.end[k]].tobytes())[:8], "little")
        return out

    def numbers(self) -> np.ndarray:
        """A number for each distinct word, told apart by its bytes."""
        size = self.end - self.start
        at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        data = self.raw[ranges(self.start, size)]
        words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(data)])
        return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def glue(self, which: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the words `which`, a space after each, and where each group of them begins; groups: offsets in which."""
        size = self.end[which] - self.start[which] + 1
        at = np.concatenate(([0], np.cumsum(size)))
        data = np.append(self.raw, np.uint8(32))[ranges(self.start[which], size)]
        data[at[1:] - 1] = 32
        return data, at[groups]

    def joined(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The words start..end of each run, joined by spaces."""
        data, at = self.glue(ranges(start, end - start), np.concatenate(([0], np.cumsum(end - start))))
        whole = data.tobytes()
        return [whole[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def room(self) -> np.ndarray:
        """How many words each word's text has from it on."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; zeros follow the last."""
    padded = np.append(raw, np.zeros(8, np.uint8))
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    high = x << np.uint64(n)
    high |= x >> np.uint64(64 - n)
    return high


def _round(v0, v1, v2, v3):
    v0 = v0 + v1
    v1 = _turn(v1, 13) ^ v0
    v0 = _turn(v0, 32)
    v2 = v2 + v3
    v3 = _turn(v3, 16) ^ v2
    v0 += v3
    v3 = _turn(v3, 21) ^ v0
    v2 += v1
    v1 = _turn(v1, 17) ^ v2
    return v0, v1, _turn(v2, 32), v3


def _sip(lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SipHash with one round a block of eight bytes and three at the end, under a fixed key; LONG_WORD bytes at most."""
    state = [np.full(len(start), x, np.uint64) for x in _SIP]
    size = np.minimum(size, LONG_WORD)
    for k in range(int(size.max()) // 8 + 1 if len(size) else 0):
        every = k == 0
        which = slice(None) if every else np.flatnonzero(size >= 8 * k)
        left = (size[which] - 8 * k).astype(np.uint64)
        block = lanes[start[which] + 8 * k]
        # The last block holds what is left, and the size in its highest byte.
        last = left < 8
        bits = np.where(last, left, 0) << np.uint64(3)
        short = (block & ((np.uint64(1) << bits) - np.uint64(1))) | (size[which].astype(np.uint64) << np.uint64(56))
        block = np.where(last, short, block)
        v0, v1, v2, v3 = (x if every else x[which] for x in state)
        v0, v1, v2, v3 = _round(v0, v1, v2, v3 ^ block)
        v0 ^= block
        if every:
            state = [v0, v1, v2, v3]
        else:
            for x, new in zip(state, (v0, v1, v2, v3), strict=True):
                x[which] = new
    v0, v1, v2, v3 = state
    v2 = v2 ^ np.uint64(255)
    for _ in range(3):
        v0, v1, v2, v3 = _round(v0, v1, v2, v3)
    return v0 ^ v1 ^ v2 ^ v3


def digest(content: bytes) -> bytes:
    """128 bits of BLAKE2b: what names content that is not compared byte by byte."""
    return blake2b(content, digest_size=16).digest()


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes, by start; runs over the ends of texts too, which the caller masks.

    The hash of a run is made of those of two shorter runs, which may overlap, in log2(n) passes. Each pass mixes what it
    joins, so unlike with sums of powers no pattern of words makes terms cancel out.
    """
    out, width = words, 1
    while width < n:
        step = min(width, n - width)
        if len(out) <= step:
            return out[:0]
        joined = out[: len(out) - step] * _LEFT
        joined += out[step:] * _RIGHT
        out = mix(joined + np.uint64(width))
        width += step
    return mix(out) if n == 1 else out


def sliding(values: np.ndarray, n: int, least: bool = True) -> np.ndarray:
    """The least (or largest) of values[i:i+n] for each i, in log2(n) passes."""
    pick = np.minimum if least else np.maximum
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = pick(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out


def winnow(keys: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Marks each key that is the least of some window of w keys; windows that touch an invalid key don't count.

    A key is chosen when the largest of the minima of its windows equals it: no window's minimum can exceed it.
    """
    n = len(keys)
    if n < w:
        return np.zeros(n, bool)
    whole = sliding(valid, w)
    lows = np.where(whole, sliding(keys, w), np.uint64(0))
    padded = np.zeros(n + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(lows)] = lows
    tops = sliding(padded, w, least=False)
    any_window = np.zeros(n + w - 1, bool)
    any_window[w - 1 : w - 1 + len(whole)] = whole
    return (tops == keys) & sliding(any_window, w, least=False) & valid


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each start, count numbers each, one after another."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return out + np.arange(total)
