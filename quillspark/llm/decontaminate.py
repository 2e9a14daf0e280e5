"""Benchmark decontamination by winnowing.

A window is `span` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. Both sides
keep the least k-gram hash of each run of w k-grams, where k + w - 1 is the length of a window, so every window that
occurs in a document shares at least one kept fingerprint with it. Fingerprints of documents are joined to those of the
benchmark, and each hit is extended to the windows around it, which are told apart by 128 bits of BLAKE2b of their words.

A benchmark of at most BLOCK_BYTES of text is broadcast, and documents are only mapped: no shuffle, no sort. A larger one
stays a table: its fingerprints, and then its windows, are joined to those of the documents, so nothing that grows with
it is held by the driver or a task. Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches
from .repeats import Wanted, among, identified, second_pass
from .textbatch import ALNUM, Words, digest, grams, lean, mix, ranges, slices, winnow

BLOCK_BYTES = 8 << 20
#: What an item counts besides its text, so that rows without text are bounded too.
ITEM_BYTES = 64
SPAN = 13
GRAM = 5


def _prints(w: Words, hashes: np.ndarray, length: int, gram: int, which: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where fingerprints for windows of `length` words stand, and what they are; of the words `which`, if given."""
    k = min(gram, length)
    g, room = grams(hashes, k), w.room()
    valid = room[: len(g)] >= k
    if which is not None:
        valid &= which[: len(g)]
    at = np.flatnonzero(winnow(g, valid, length - k + 1))
    return at, mix(g[at] ^ np.uint64(length))


def _around(w: Words, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Starts of all windows of `length` words that hold a k-gram at one of the places."""
    low = np.maximum(at - (length - min(gram, length)), w.first[w.owner()[at]]) if len(at) else at
    start = np.unique(ranges(low, at - low + 1))
    return start[w.room()[start] >= length]


def _own_windows(w: Words, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of window that items have, where such windows start, and the words of such items."""
    size, room, owner = np.minimum(w.counts, span), w.room(), w.owner()
    for length in np.unique(size[size > 0]).tolist():
        here = (size == length)[owner]
        yield length, np.flatnonzero(here & (room >= length)), here


class Index:
    """Fingerprints and windows of items."""

    def __init__(self, ids: list[str], texts: list[str], span: int = SPAN, gram: int = GRAM):
        self.ids, self.gram, self.parts = ids, gram, []
        w = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
        hashes, owner = w.hashes(), w.owner()
        for length, at, here in _own_windows(w, span):
            _, prints = _prints(w, hashes, length, gram, here)
            members: dict[bytes, set[int]] = {}
            for window, item in zip(w.joined(at, at + length), owner[at].tolist(), strict=True):
                members.setdefault(digest(window), set()).add(item)
            self.parts.append((length, np.unique(prints), np.unique(grams(hashes, length)[at]), members))

    def find(self, w: Words) -> tuple[np.ndarray, list[set[int]]]:
        """Which words are hit, and the items, by position, of which each text holds a window."""
        hashes, owner = w.hashes(), w.owner()
        change = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[int]] = [set() for _ in w.counts]
        for length, prints, windows, members in self.parts:
            at, values = _prints(w, hashes, length, self.gram)
            start = _around(w, at[among(prints, values)], length, self.gram)
            start = start[among(windows, grams(hashes, length)[start])] if len(start) else start
            found = [members.get(digest(x)) for x in w.joined(start, start + length)]
            good = np.array([x is not None for x in found], bool)
            for text, mine in zip(owner[start].tolist(), found, strict=True):
                if mine is not None:
                    items[text] |= mine
            np.add.at(change, start[good], 1)
            np.add.at(change, start[good] + length, -1)
        return np.cumsum(change[:-1]) > 0, items


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _mapped(shared, text_col: str, carry: list[str]):
    """With a broadcast index: the carried columns, n_words, n_hit and items."""

    def run(batches):
        index = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                w = Words(part.column(text_col), ALNUM, lower=True)
                hit, items = index.find(w)
                sums = np.concatenate(([0], np.cumsum(hit)))
                lists = [sorted({index.ids[i] for i in x}) for x in items]
                columns = [pa.array(w.counts.astype(np.int64)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64()), pa.array(lists, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *columns], [*carry, "n_words", "n_hit", "items"])

    return run


def _of_items(span: int, gram: int):
    """Rows (print) and (window, length, item) of items."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, lower=True)
                hashes, owner = w.hashes(), w.owner()
                for length, at, here in _own_windows(w, span):
                    _, prints = _prints(w, hashes, length, gram, here)
                    n, m = len(prints), len(at)
                    names = pa.array([digest(x) for x in w.joined(at, at + length)], pa.binary())
                    item, long = part.column("item").take(pa.array(owner[at])), pa.array(np.full(m, length))
                    yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), *[pa.nulls(n, t) for t in (pa.binary(), pa.int64(), pa.string())]], ["print", "window", "length", "item"])
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), names, long, item], ["print", "window", "length", "item"])

    return run


def _all_prints(lengths: list[int], gram: int):
    def emit(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        begin = 0
        for part in slices(batch, "text"):
            w = Words(part.column("text"), ALNUM, lower=True)
            hashes, owner = w.hashes(), w.owner()
            for length in lengths:
                at, values = _prints(w, hashes, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(owner[at] + begin)], ["hash", "row"])
            begin += part.num_rows

    return emit


def _extended(lengths: list[int], gram: int):
    """Rows (id, tie, start, length, window) of the windows around the fingerprints that are wanted."""

    def emit(batch: pa.RecordBatch, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        begin = 0
        for part in slices(batch, "text"):
            w = Words(part.column("text"), ALNUM, lower=True)
            hashes, owner = w.hashes(), w.owner()
            for length in lengths:
                at, values = _prints(w, hashes, length, gram)
                start = _around(w, at[wanted(values, owner[at] + begin)], length, gram)
                rows, names = pa.array(owner[start]), [digest(x) for x in w.joined(start, start + length)]
                place = pa.array(start - w.first[owner[start]])
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("tie").take(rows), place, pa.array(np.full(len(start), length)), pa.array(names, pa.binary())], ["id", "tie", "start", "length", "window"])
            begin += part.num_rows

    return emit


def _counted(carry: list[str]):
    """The carried columns, n_words, n_hit and items, from a document's windows that items hold."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM, lower=True)
                change = np.zeros(len(w.start) + 1, np.int64)
                lists = part.column("spans")
                flat = lists.flatten()
                if len(flat):
                    rows = np.repeat(np.arange(len(lists)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0))
                    start = w.first[rows] + flat.field("start").to_numpy()
                    np.add.at(change, start, 1)
                    np.add.at(change, start + flat.field("length").to_numpy(), -1)
                sums = np.concatenate(([0], np.cumsum(np.cumsum(change[:-1]) > 0)))
                items = pa.array([sorted(x or []) for x in part.column("items").to_pylist()], pa.list_(pa.string()))
                columns = [pa.array(w.counts.astype(np.int64)), pa.array(sums[w.first[1:]] - sums[w.first[:-1]], pa.int64()), items]
                yield pa.RecordBatch.from_arrays([*[part.column(f"c_{c}") for c in carry], *columns], [*carry, "n_words", "n_hit", "items"])

    return run


def _joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, carry: list[str], span: int, gram: int, schema: T.StructType) -> DataFrame:
    """What _mapped gives, for a benchmark of any size."""
    long = lambda x: T.StructField(x, T.LongType())
    named = identified(docs, id_col, text_col, carry)
    slim = named.select("id", "tie", "text")
    own = keep(items.mapInArrow(lean(_of_items(span, gram)), "print long, window binary, length long, item string"), "items")
    prints = keep(own.where("print is not null").select(F.col("print").alias("hash")).distinct(), "prints")
    # One row a window, so that a window that many items hold does not multiply the documents that hold it.
    windows = own.where("window is not null").groupBy("window").agg(F.collect_set("item").alias("of"))
    lengths = sorted(r.length for r in own.where("window is not null").select("length").distinct().collect())
    schema_of = T.StructType([slim.schema["id"], slim.schema["tie"], long("start"), long("length"), T.StructField("window", T.BinaryType())])
    held = second_pass(slim, prints, _all_prints(lengths, gram), _extended(lengths, gram), schema_of).join(windows, "window")
    spans = held.groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set(F.struct("start", "length")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("of"))).alias("items"))
    joined = named.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").drop("_id", "_tie")
    return joined.mapInArrow(lean(_counted(carry)), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", carry: list[str] | None = None, span: int = SPAN, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), then n_words, n_hit, items, contaminated.

    items: ids, as strings in ascending order, of the items of which a window occurs. contaminated: some word is hit and
    hit words are a twentieth of all at least. A null or empty text has no words and no hits; an item without words has
    no window; a null item id is 'null'; items that repeat count once by id; repeated documents are each judged. Columns
    of docs that clash with the results' names are replaced. Either table may be empty. A text is held whole, in some 60
    bytes a word.
    """
    mine = ["n_words", "n_hit", "items", "contaminated"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in mine]
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
    items = _items(benchmark, item_col, item_text)
    if (items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ITEM_BYTES)).first()[0] or 0) <= block_bytes:
        # At most block_bytes of text and rows.
        rows = items.collect()
        shared = docs.sparkSession.sparkContext.broadcast(Index([r["item"] for r in rows], [r["text"] for r in rows], span, gram))
        out = docs.select(*dict.fromkeys([*carry, text_col])).mapInArrow(lean(_mapped(shared, text_col, carry)), schema)
    else:
        out = _joined(docs, items, id_col, text_col, carry, span, gram, schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
