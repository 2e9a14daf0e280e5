"""Suffix-array dedup by linear grouping.

The suffixes of each minimizer's segments are sorted as lyndon.py describes, and equal windows of SPAN bytes stand next
to each other, where they are compared byte by byte. All of them but the earliest are removed. Equal segments have been
made one, so what is sorted differs.

Many near copies make many segments of one minimizer, which differ where the copies do. Groups are cut
again by the minimizers of another hash, and equal pieces are made one; a group beyond GROUP bytes until it is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lyndon import suffix_arrays
from .repeats import identified
from .segments import SLICE, Units, cover, covered, searched
from .textbatch import lanes, lean, mix, powers, ranges, slices, text_bytes

SPAN = 100
GRAM = 36
GROUP = 2 << 10
LEVELS = 12
#: So many more minimizers cut every group, as cutting costs a tenth of sorting and most of what it parts is then alone.
ALWAYS = 4
#: Bytes of distinct segments in a shard, about.
SHARD = 768 << 10
_ONE = np.uint64(1)


def _byte_units(raw: np.ndarray, at: np.ndarray, gram: int, level: int = 0) -> Units:
    """Bytes, whose k-grams are put in order by a polynomial of 32 bits, of another base at each level."""
    base = int(mix(np.array([0x1234567 + level], np.uint64))[0]) & 0xFFFFFFFF | 1
    power, inverse = powers(base, len(raw), np.uint32), powers(pow(base, -1, 1 << 32), len(raw), np.uint32)
    sums = np.zeros(len(raw) + 1, np.uint32)
    np.cumsum(raw * power[: len(raw)], dtype=np.uint32, out=sums[1:])
    count = max(0, len(raw) - gram + 1)
    order = sums[gram:] - sums[:count]
    order *= inverse[:count]
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        order ^= order >> np.uint32(shift)
        order *= np.uint32(factor)
    eight = lanes(raw)

    def names(at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), gram, np.uint64)
        for k in [*range(0, gram - 7, 8), gram - 8]:
            h = mix(h ^ eight[at + k])
        return h

    def bodies(start: np.ndarray, end: np.ndarray) -> list[bytes]:
        whole = raw.tobytes()
        return [whole[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    return Units(order, gram, at, names, bodies)


def _blocks(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of set flags within one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
    heads = np.flatnonzero(new)
    return at[heads], np.diff(np.r_[heads, len(at)])


class Pieces:
    """Byte strings with what they are grouped by (key), and where they stand (order)."""

    def __init__(self, key, data, at, order):
        self.key, self.data, self.at, self.order = key, data, at, order
        self.size = np.diff(at)

    def take(self, which: np.ndarray) -> Pieces:
        size = self.size[which]
        return Pieces(self.key[which], self.data[ranges(self.at[which], size)], np.concatenate(([0], np.cumsum(size))), self.order[which])


def later_windows(x: Pieces, span: int, gram: int, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, first window and count of the runs of windows that occur earlier in a piece of the same key."""
    none = np.empty(0, np.int64)
    if not len(x.key):
        return none, none, none
    # Pieces are numbered by their bytes.
    whole = pa.Array.from_buffers(pa.large_binary(), len(x.key), [None, pa.py_buffer(x.at.astype(np.int64)), pa.py_buffer(x.data)])
    number = whole.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.lexsort((x.order, number, x.key))
    first = np.ones(len(by), bool)
    first[1:] = (x.key[by][1:] != x.key[by][:-1]) | (number[by][1:] != number[by][:-1])
    copies, single = by[~first], by[first]
    out = [(copies, np.zeros(len(copies), np.int64), x.size[copies] - span + 1)]

    # A piece alone repeats nothing.
    new = np.r_[True, x.key[single][1:] != x.key[single][:-1]]
    heads = np.flatnonzero(new)
    number = np.diff(np.r_[heads, len(single)])
    busy = np.repeat(number > 1, number)
    single, group = single[busy], (np.cumsum(new) - 1)[busy]
    total = np.bincount(group, x.size[single], len(heads))
    large = ((level < ALWAYS) | (total > GROUP)) & (level < LEVELS)
    for which, work in ((~large, _sorted), (large, _recut)):
        mine = single[which[group]]
        if len(mine):
            piece, start, count = work(x.take(mine), span, gram, level)
            out.append((mine[piece], start, count))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _sorted(x: Pieces, span: int, gram: int, level: int):
    """later_windows, by the suffix array of each key's pieces."""
    n = len(x.key)
    last = np.r_[x.key[1:] != x.key[:-1], True]
    # Each piece ends in 1, and each key's text in 0; bytes begin at 2.
    begin = x.at[:-1] + np.arange(n) + np.concatenate(([0], np.cumsum(last)[:-1]))
    text = np.ones(int(x.at[-1]) + n + int(last.sum()), np.uint16)
    body = ranges(begin, x.size)
    text[body] = x.data.astype(np.uint16) + 2
    finish = (begin + x.size + 1)[last]
    text[finish] = 0
    order = suffix_arrays(text, np.concatenate(([0], finish + 1)))
    piece = np.full(len(text), -1, np.int32)
    piece[body] = np.repeat(np.arange(n), x.size)
    room = np.zeros(len(text), np.int32)
    room[body] = np.repeat(begin + x.size, x.size) - body
    del body
    order = order[room[order] >= span]
    # Neighbours are compared eight bytes at a time, as long as they agree.
    inside = order - begin[piece[order]] + x.at[piece[order]]
    eight, key = lanes(x.data), x.key[piece[order]]
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    for k in [*range(0, span - 7, 8), span - 8]:
        same = same[eight[inside[same] + k] == eight[inside[same - 1] + k]]
    new = np.ones(len(order), bool)
    new[same] = False
    where = x.order[piece[order]] + order - begin[piece[order]]
    heads = np.flatnonzero(new)
    earliest = np.repeat(np.minimum.reduceat(where, heads), np.diff(np.r_[heads, len(order)])) if len(heads) else where
    flags = np.zeros(len(text), bool)
    flags[order[where > earliest]] = True
    start, count = _blocks(flags, piece)
    return piece[start], start - begin[piece[start]], count


def _recut(x: Pieces, span: int, gram: int, level: int):
    """later_windows, by pieces cut by one more minimizer."""
    units = _byte_units(x.data, x.at, gram, level + 1)
    start, windows, least = units.segments(span - gram + 1)
    parent, size = units.owner(start), windows + span - 1
    data, at = x.data[ranges(start, size)], np.concatenate(([0], np.cumsum(size)))
    inner = Pieces(mix(x.key[parent] ^ mix(units.names(least) + np.uint64(level))), data, at, x.order[parent] + start - x.at[parent])
    piece, first, count = later_windows(inner, span, gram, level + 1)
    return parent[piece], start[piece] - x.at[parent[piece]] + first, count


def _search(span: int, gram: int):
    def search(table: pa.Table) -> list[list[int]]:
        place = table.select(["id", "tie", "start"]).combine_chunks()
        by = pc.sort_indices(place, sort_keys=[("id", "ascending"), ("tie", "ascending")], null_placement="at_start").to_numpy()
        ids, ties = place["id"].combine_chunks().take(pa.array(by)), place["tie"].to_numpy()[by]
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        differs = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
        new = np.r_[False, differs | (known[1:] != known[:-1]) | (ties[1:] != ties[:-1])]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new)
        if not len(by):
            return []
        data, at = text_bytes(table.column("content").combine_chunks())
        least = table.column("minimizer").to_numpy().view(np.uint64)
        x = Pieces(least, data, at, (rank << 40) + place["start"].to_numpy())
        out: list[list[int]] = [[] for _ in range(table.num_rows)]
        for piece, start, count in zip(*(c.tolist() for c in later_windows(x, span, gram)), strict=True):
            out[piece] += [start, count]
        return out

    return search


def _strip(carry: list[str], span: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                raw, at = text_bytes(part.column("text"))
                gone = cover(part.column("spans"), at, span)
                size = np.diff(at)
                start, _ = _blocks(gone, np.repeat(np.arange(len(size)), size))
                spans = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=len(size)) if len(start) else np.zeros(len(size), np.int64)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[at])
                left = np.concatenate(([0], np.cumsum(size - removed)))
                kept = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(raw[~gone])]).cast(pa.binary())
                columns = [*[part.column(f"c_{c}") for c in carry], pa.array(size), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), kept]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), n_bytes, n_removed, n_spans and kept.

    A byte is removed if it lies in a string of `span` bytes, within one text, that also starts earlier: in a document of
    a lesser id (null is least, then the text of the lesser hash), or before in the same. kept, the bytes left, may split
    characters, so it is binary; n_spans counts maximal removed runs. A null text is empty; rows that repeat id and text
    are one document, and get one result. Columns of docs that clash with the results' names are replaced; an empty table
    gives no rows. A text is held whole, in some 60 bytes a byte.
    """
    mine = ["n_bytes", "n_removed", "n_spans", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in mine]
    named = identified(docs, id_col, text_col, carry)
    slim = named.select("id", "tie", "text", F.xxhash64("id", "tie").alias("key"))
    found, runs = searched(slim, lambda column: _byte_units(*text_bytes(column), gram), span, gram, _search(span, gram), SHARD, "suffixes", alone=False)
    spans = covered(found, runs, later=True)
    joined = named.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").drop("_id", "_tie")
    fields = [docs.schema[c] for c in carry] + [T.StructField(x, T.LongType()) for x in mine[:3]] + [T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(lean(_strip(carry, span)), T.StructType(fields))
