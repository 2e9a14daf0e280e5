"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last ROLL lines, mixed, decides where a chunk ends: at a line where it is less than
at both neighbours. So the same run of lines is cut alike wherever it stands and however many lines come before it, no
chunk but a text's last has one line, and a line that repeats itself is not cut. Chunks of two lines or more that occur
again anywhere are removed, all but the first occurrence.

Chunks are first counted by hash alone. Only those whose hash repeats travel with their bytes, and chunks are the same
only if their bytes are: they are grouped by them, summed up before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep
from .repeats import Wanted, identified, repeated_hashes, second_pass
from .textbatch import lean

ROLL = 2
MULTIPLIER = 31
#: Bits of the rolling hash, and what mixes it: its high bits depend on all of it.
BITS, MIXER, LOW = 32, 2654435761, 16


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, end) of each chunk."""
    codes = [int.from_bytes(hashlib.md5(x).digest()[:4], "big") for x in lines]
    rolling = [sum(codes[i - k] * MULTIPLIER**k for k in range(min(ROLL, i + 1))) % (1 << BITS) * MIXER % (1 << BITS) >> LOW for i in range(len(codes))]
    ends = [i + 1 for i in range(1, len(lines) - 1) if rolling[i - 1] > rolling[i] < rolling[i + 1]]
    return list(zip([0, *ends], [*ends, len(lines)], strict=True))


def _several(text: str) -> Iterator[tuple[int, int, bytes]]:
    """Number, hash and bytes of each chunk of two lines or more."""
    if "\n" in text:
        lines = text.encode().split(b"\n")
        for n, (a, b) in enumerate(chunks(lines)):
            if b - a > 1:
                body = b"\n".join(lines[a:b])
                yield n, int.from_bytes(hashlib.md5(body).digest()[:8], "big", signed=True), body


def _hashes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    found = [(h, i) for i, text in enumerate(batch.column("text").to_pylist()) for _, h, _ in _several(text)]
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["hash", "row"])


def _occurrences(batch: pa.RecordBatch, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    found = [(i, n, h, body) for i, text in enumerate(batch.column("text").to_pylist()) for n, h, body in _several(text)]
    rows, numbers, hashes, bodies = ([x[k] for x in found] for k in range(4))
    which = np.flatnonzero(wanted(np.array(hashes, np.int64), np.array(rows, np.int64)))
    at = pa.array(np.array(rows, np.int64)[which])
    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("tie").take(at), pa.array(np.array(numbers, np.int32)[which]), pa.array([bodies[k] for k in which.tolist()], pa.binary())], ["id", "tie", "chunk", "body"])


def _strip(carry: list[str]):
    def run(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                lines, drop = text.encode().split(b"\n"), set(drop or ())
                parts = chunks(lines) if drop else []
                rest = [x for n, (a, b) in enumerate(parts) if n not in drop for x in lines[a:b]] if drop else lines
                total.append(len(lines))
                gone.append(len(lines) - len(rest))
                kept.append(b"\n".join(rest).decode())
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c_{c}") for c in carry], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*carry, "n_lines", "n_removed", "kept"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), n_lines, n_removed and kept, the text left.

    Of the occurrences of a repeated chunk, the one of the least id (null first), then of the text of the least hash,
    then the earliest, stays. Rows of one id and text are one document. A null text is an empty one, which is one empty
    line. Columns of docs that clash with the results' names are replaced; an empty table gives no rows.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_lines", "n_removed", "kept")]
    named = identified(docs, id_col, text_col, carry)
    slim = named.select("id", "tie", "text")
    repeated = repeated_hashes(slim, _hashes, "chunks")
    schema = T.StructType([slim.schema["id"], slim.schema["tie"], T.StructField("chunk", T.IntegerType()), T.StructField("body", T.BinaryType())])
    found = keep(second_pass(slim, repeated, _hashes, _occurrences, schema).select(F.struct("id", "tie", "chunk").alias("at"), "body"), "occurrences")
    first = found.groupBy("body").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("body", "first")
    later = found.join(first, "body").where(F.col("at") != F.col("first"))
    drops = later.groupBy(F.col("at.id").alias("_id"), F.col("at.tie").alias("_tie")).agg(F.collect_set("at.chunk").alias("drop"))
    joined = named.join(drops, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").drop("_id", "_tie")
    fields = [docs.schema[c] for c in carry] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(lean(_strip(carry)), T.StructType(fields))
