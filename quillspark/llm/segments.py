"""Sends equal windows of a corpus to one shard.

A window of `span` units (words or bytes) is named by its minimizer, the leftmost of its k-grams of the least hash.
Consecutive windows with their minimizer at one place form a segment, and equal windows have equal minimizers at the same
distance, wherever they stand, so shards by minimizer can be searched on their own, and no two windows of one segment are
equal. Minimizers that the corpus holds once name no repeated window; only segments of the others travel, and equal
segments are one row, with a count, before they are shuffled. A text that repeats itself holds runs of equal segments,
one after another; such a run is one row from the start. Segments are named by 128 bits of BLAKE2b of their content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep
from .repeats import Wanted, repeated_hashes, second_pass
from .textbatch import digest, mix, ranges, release, slices, sliding

#: Bytes of text worked on at once.
SLICE = 256 << 10
PLACED = ["minimizer", "c1", "c2", "id", "tie", "start"]


class Units:
    """What texts are cut into: words or bytes.

    order: 32 bits of a hash of the k-gram at each unit, k: units of a k-gram, first: index of each text's first unit
    and, last, their number, names: 64 bits of hash of the k-grams at the given units, bodies: the bytes of runs (start,
    end) of units.
    """

    def __init__(self, order: np.ndarray, k: int, first: np.ndarray, names: Callable, bodies: Callable):
        self.order, self.k, self.first, self.names, self.bodies = order, k, first, names, bodies

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The text of each unit."""
        return np.searchsorted(self.first, at, "right") - 1

    def segments(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window, number of windows and place of the minimizer of each segment, for windows of w k-grams."""
        n = len(self.order)
        if n < w:
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        least = sliding(self.order.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64), w)
        whole = np.zeros(len(least) + 1, np.int8)
        long = np.flatnonzero(np.diff(self.first) >= w + self.k - 1)
        whole[self.first[long]] = 1
        # After the last window of a text come at least two units that begin none, or the end.
        whole[self.first[long + 1] - (w + self.k - 2)] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8).view(bool)
        edge = np.ones(len(least) + 1, bool)
        edge[1:-1] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
        at = np.flatnonzero(edge)
        start, end = at[:-1], at[1:]
        good = whole[start]
        start, end = start[good], end[good]
        return start, end - start, (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchors(units_of: Callable[[pa.Array], Units], w: int, by_document: bool):
    """The minimizers of a batch's documents; or, by_document, hashes of each with its document's key."""

    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begin = 0
        for part in slices(batch, "text", SLICE):
            units = units_of(part.column("text"))
            _, _, at = units.segments(w)
            values, rows = units.names(at), units.owner(at)
            if by_document:
                values = _with_key(values, part, rows)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(rows + begin)], ["hash", "row"])
            begin += part.num_rows

    return emit


def _with_key(minimizers: np.ndarray, batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    return mix(minimizers ^ mix(batch.column("key").to_numpy().view(np.uint64)[rows]))


def _heads(start: np.ndarray, windows: np.ndarray, names: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """Which segments are not equal to one that ends where they begin."""
    again = np.zeros(len(start), bool)
    again[1:] = (start[1:] == start[:-1] + windows[:-1]) & (windows[1:] == windows[:-1]) & (names[1:] == names[:-1])
    for i in np.flatnonzero(again).tolist():
        again[i] = bodies[i] == bodies[i - 1]
    return np.flatnonzero(~again)


def _emit(units_of: Callable[[pa.Array], Units], span: int, k: int, content: bool):
    """Segments whose minimizer is wanted, without their content; or with it, if wanted for their document."""

    def emit(batch: pa.RecordBatch, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        begin = 0
        for part in slices(batch, "text", SLICE):
            units = units_of(part.column("text"))
            start, windows, at = units.segments(span - k + 1)
            names, owner = units.names(at), units.owner(at)
            good = wanted(_with_key(names, part, owner) if content else names, owner + begin)
            begin += part.num_rows
            start, windows, names, owner = start[good], windows[good], names[good], owner[good]
            rows = pa.array(owner)
            columns = [pa.array(names.view(np.int64)), part.column("id").take(rows), part.column("tie").take(rows), pa.array(start - units.first[owner])]
            bodies = units.bodies(start, start + windows + span - 1)
            if content:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(bodies, pa.binary())], ["minimizer", "id", "tie", "start", "content"])
            else:
                heads = _heads(start, windows, names, bodies)
                c = np.frombuffer(b"".join([digest(bodies[i]) for i in heads.tolist()]), np.int64).reshape(-1, 2)
                keys = _with_key(names, part, owner).view(np.int64)
                times = np.diff(np.append(heads, len(start)))
                columns = [x.take(pa.array(heads)) for x in [*columns, pa.array(windows), pa.array(keys)]]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array(c[:, 0]), pa.array(c[:, 1]), *columns[1:5], pa.array(times), columns[5]], [*PLACED, "windows", "times", "hash"])

    return emit


def searched(slim: DataFrame, units_of: Callable[[pa.Array], Units], span: int, k: int, search: Callable, shard_units: int, name: str, alone: bool = True) -> tuple[DataFrame, DataFrame]:
    """Every repeated segment (PLACED, windows, times: how many stand in a row), and by c1, c2 the first place and the
    runs that `search` finds.

    slim: id, tie, text and key, a hash of id and tie. search takes an Arrow table of a shard's distinct segments
    (minimizer, c1, c2, n, id, tie, start: of the first, content), in a fixed order, and returns a list of runs (first
    window, count, ...) for each. With alone=False, a segment whose minimizer has no other content is not searched but
    has no runs: it holds no two equal windows, nor does another. A shard holds about shard_units of them. The content
    only travels from where it first occurs, straight to its shard.
    """
    w = span - k + 1
    long = lambda x: T.StructField(x, T.LongType())
    place = [slim.schema["id"], slim.schema["tie"], long("start")]
    repeated = repeated_hashes(slim, _anchors(units_of, w, False), f"{name}-minimizers")
    found = second_pass(slim, repeated, _anchors(units_of, w, False), _emit(units_of, span, k, False), T.StructType([long("minimizer"), long("c1"), long("c2"), *place, long("windows"), long("times"), long("hash")]))
    found = keep(found, f"{name}-segments")

    first = F.min(F.struct("id", "tie", "start", "hash", "windows")).alias("f")
    every = keep(found.groupBy("minimizer", "c1", "c2").agg(F.sum("times").alias("n"), first).select("minimizer", "c1", "c2", "n", "f.*"), f"{name}-distinct")
    distinct = every
    if not alone:
        several = every.groupBy("minimizer").agg(F.count("*").alias("contents")).where("contents > 1").select("minimizer")
        distinct = keep(every.join(several, "minimizer", "left_semi"), f"{name}-searched")
    size = distinct.agg(F.sum(F.col("windows") + span)).first()[0] or 0
    shards = max(1, -(-size // shard_units))
    shard = F.pmod(F.xxhash64("minimizer"), F.lit(shards)).alias("shard")
    wanted = keep(distinct.select("hash").distinct(), f"{name}-places")
    bodies = second_pass(slim, wanted, _anchors(units_of, w, True), _emit(units_of, span, k, True), T.StructType([long("minimizer"), *place, T.StructField("content", T.BinaryType())]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _joined(left, right)
        found = search(table)
        release()
        return pa.table({"c1": table["c1"], "c2": table["c2"], "f_id": table["id"], "f_tie": table["tie"], "f_start": table["start"], "runs": pa.array(found, pa.list_(pa.int64()))})

    schema = T.StructType([long("c1"), long("c2"), T.StructField("f_id", slim.schema["id"].dataType), long("f_tie"), long("f_start"), T.StructField("runs", T.ArrayType(T.LongType()))])
    by = distinct.select(shard, "minimizer", "c1", "c2", "n", "id", "tie", "start").groupBy("shard").cogroup(bodies.select(shard, "tie", "start", "content").groupBy("shard"))
    runs = keep(by.applyInArrow(run, schema), f"{name}-runs")
    if not alone:
        none = F.array().cast("array<bigint>")
        rest = every.join(several, "minimizer", "left_anti")
        runs = runs.union(rest.select("c1", "c2", F.col("id").alias("f_id"), F.col("tie").alias("f_tie"), F.col("start").alias("f_start"), none.alias("runs")))
    return found, runs


def _joined(distinct: pa.Table, bodies: pa.Table) -> pa.Table:
    """distinct in order of minimizer and content, with the content of each, from where it first occurs.

    Contents are matched by tie and start, and are what they are named by, or the content is missing.
    """
    distinct = distinct.sort_by([("minimizer", "ascending"), ("c1", "ascending"), ("c2", "ascending")])
    want, have = (mix(mix(t["tie"].to_numpy().view(np.uint64)) + t["start"].to_numpy().view(np.uint64)) for t in (distinct, bodies))
    content = bodies["content"].combine_chunks()
    names = np.stack([distinct[c].to_numpy() for c in ("c1", "c2")], 1)
    by = np.argsort(have, kind="stable")
    low, high = np.searchsorted(have[by], want, "left"), np.searchsorted(have[by], want, "right")
    at = np.full(len(want), -1, np.int64)
    # Documents of one text share tie and start, so several bodies may answer; any of the right content will do.
    for step in range(int((high - low).max()) if len(want) else 0):
        open_ = np.flatnonzero((at < 0) & (low + step < high))
        if not len(open_):
            break
        found = by[low[open_] + step]
        c = np.frombuffer(b"".join([digest(x.as_buffer()) for x in content.take(pa.array(found))]), np.int64).reshape(-1, 2)
        same = (c == names[open_]).all(1)
        at[open_[same]] = found[same]
    if (at < 0).any():
        raise RuntimeError("a segment's content is missing")
    return distinct.append_column("content", content.take(pa.array(at)) if len(content) else pa.array([], pa.binary()))


def covered(found: DataFrame, runs: DataFrame, later: bool = False) -> DataFrame:
    """_id, _tie and spans, an array of (unit, windows), of every occurrence of the runs.

    With later, the runs are those of a segment's first occurrence, and of all others every window counts. Without, a
    segment that stands several times in a row occurs more than once, so its runs are all of its windows.
    """
    runs = runs.withColumn("first", F.struct(F.col("f_id").alias("id"), F.col("f_tie").alias("tie"), F.col("f_start").alias("start"))).drop("f_id", "f_tie", "f_start")

    def span(at: Column, count: Column) -> Column:
        return F.struct(at.alias("at"), count.alias("count"))

    none, row = F.array().cast("array<struct<at:bigint,count:bigint>>"), F.col("windows") * F.col("times")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("runs") / 2).cast("int") - 1), lambda i: span(F.col("start") + F.get("runs", 2 * i), F.get("runs", 2 * i + 1)))
    pairs = F.when(F.size("runs") > 0, pairs).otherwise(none)
    columns = ["c1", "c2", "id", "tie", "start", "windows", "times"]
    if later:
        joined = found.select(*columns).join(runs, ["c1", "c2"])
        again = ~F.struct("id", "tie", "start").eqNullSafe(F.col("first"))
        rest = F.when(F.col("times") > 1, F.array(span(F.col("start") + F.col("windows"), row - F.col("windows")))).otherwise(none)
        pairs = F.when(again, F.array(span(F.col("start"), row))).otherwise(F.concat(pairs, rest))
    else:
        joined = found.select(*columns).join(runs.where(F.size("runs") > 0).drop("first"), ["c1", "c2"])
        pairs = F.when(F.col("times") > 1, F.array(span(F.col("start"), row))).otherwise(pairs)
    hit = joined.select("id", "tie", pairs.alias("spans")).where(F.size("spans") > 0)
    return hit.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cover(spans: pa.Array, first: np.ndarray, span: int) -> np.ndarray:
    """Which units, of all texts of a batch, the windows cover; spans as made by covered(), first: each text's first unit."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    lists = spans.combine_chunks() if isinstance(spans, pa.ChunkedArray) else spans
    flat = lists.flatten()
    if len(flat):
        count = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lists)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), count, 0))
        at = first[row] + flat.field("at").to_numpy()
        np.add.at(change, at, 1)
        np.add.at(change, at + flat.field("count").to_numpy() + span - 1, -1)
    return np.cumsum(change[:-1]) > 0
