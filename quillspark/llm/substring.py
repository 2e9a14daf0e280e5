"""Substring dedup by FM-indexes.

Each shard of segments is indexed by an FM-index over a wavelet matrix of packed bits, which is all that is kept of its
suffixes, and its segments are streamed through backward search: the matching statistic at an end is how far back the text still occurs elsewhere, and windows of SPAN words that
lie within are repeated. Words are numbered by their bytes. How segments come
to shards is described in segments.py.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fmindex import FMIndex, matches
from .repeats import identified
from .segments import Units, cover, covered, searched
from .textbatch import NONSPACE, Words, grams, lean, ranges, slices

SPAN = 35
GRAM = 8
#: Symbols by which suffixes are sorted, and how far back one search goes.
DEPTH = 64
#: Words of distinct segments in a shard, about.
SHARD = 400_000


def _units(gram: int):
    def of(column: pa.Array) -> Units:
        w = Words(column, NONSPACE)
        g = grams(w.hashes(), gram)
        return Units((g >> np.uint64(32)).astype(np.uint32), gram, w.first, lambda at: g[at], w.joined)

    return of


def _search(span: int, depth: int):
    def search(table: pa.Table) -> list[list[int]]:
        w = Words(table.column("content").combine_chunks(), NONSPACE)
        symbol, counts = w.numbers(), w.counts
        begin = w.first[:-1] + np.arange(len(counts))
        text = np.zeros(len(symbol) + len(counts), np.int64)
        text[ranges(begin, counts)] = symbol + 1
        index = FMIndex(text, int(symbol.max()) + 2 if len(symbol) else 1, np.repeat(table.column("n").to_numpy(), counts + 1), depth)
        return matches(index, text, begin, begin + counts, span, depth)

    return search


def _strip(carry: list[str], span: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), NONSPACE)
                gone = cover(part.column("spans"), w.first, span)
                left = np.flatnonzero(~gone)
                data, at = w.glue(left, np.searchsorted(left, w.first))
                texts = [data[a : max(a, b - 1)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first])
                columns = [*[part.column(f"c_{c}") for c in carry], pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*carry, "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), n_words, n_removed and kept.

    A word is removed if it lies in a window of `span` words that starts anywhere else too, in another row or the same;
    kept holds the words left, joined by spaces. Windows are judged on the input. A null text or one without words is
    empty; rows that repeat id and text are occurrences like any other, and get one result. Columns of docs that clash
    with the results' names are replaced; an empty table gives no rows. A text is held whole, in some 100 bytes a word and
    20 a byte.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_words", "n_removed", "kept")]
    named = identified(docs, id_col, text_col, carry)
    slim = named.select("id", "tie", "text", F.xxhash64("id", "tie").alias("key"))
    spans = covered(*searched(slim, _units(gram), span, gram, _search(span, max(DEPTH, span + 1)), SHARD, "substring"))
    joined = named.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").drop("_id", "_tie")
    fields = [docs.schema[c] for c in carry] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(lean(_strip(carry, span)), T.StructType(fields))
