"""Which hashes occur more than once in a corpus, and a second pass over the documents that hold them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches
from .textbatch import lean, mix

#: So many hashes, of 8 bytes each, go to every worker at most; more are joined to the documents instead.
POOL = 4_000_000

#: (values, their rows) -> which of them repeat; rows count within the batch.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]


def among(pool: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a sorted pool holds. They are looked up in order, as neighbours then share what is in the cache."""
    out = np.zeros(len(values), bool)
    if len(pool):
        order = np.argsort(values)
        found = values[order]
        out[order] = pool[np.minimum(np.searchsorted(pool, found), len(pool) - 1)] == found
    return out


def identified(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """id, tie, text and the carried columns as c_...; id and tie name a document.

    Documents of one id differ by tie, a hash of the text. Rows of one id and text are one document that is stored more
    than once, and get one result.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry])


def repeated_hashes(docs: DataFrame, emit: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], name: str) -> DataFrame:
    """The hashes, emitted as long `hash` (and `row` of the batch) by batch of docs, of which there are two or more."""

    def run(batches):
        for batch in batches:
            for found in emit(batch):
                yield found.select(["hash"])

    return keep(docs.mapInArrow(lean(run), "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), name)


def second_pass(docs: DataFrame, repeated: DataFrame, first: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], emit: Callable[[pa.RecordBatch, Wanted], Iterator[pa.RecordBatch]], schema: T.StructType, pool: int | None = None) -> DataFrame:
    """What emit makes of each batch of docs (id, tie, text), given which of its hashes repeat.

    Up to `pool` repeated hashes (POOL, if not given) are broadcast, in about 8 MB a million. More than that are joined
    to the hashes of the documents, as `first` emits them with their row in the batch, and the documents are joined to
    the set of theirs, which is never larger than the document.
    """
    spark = docs.sparkSession
    if repeated.count() <= (POOL if pool is None else pool):
        rows = repeated.toArrow().column("hash").combine_chunks()
        shared = spark.sparkContext.broadcast(np.sort(rows.to_numpy(zero_copy_only=False).astype(np.int64)))

        def run(batches):
            for batch in batches:
                yield from emit(batch, lambda values, _: among(shared.value, values.view(np.int64)))

        return docs.mapInArrow(lean(run), schema)

    def name(batches):
        for batch in batches:
            for found in first(batch):
                row = found.column("row")
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("tie").take(row), found.column("hash")], ["id", "tie", "hash"])

    named = docs.mapInArrow(lean(name), T.StructType([docs.schema["id"], docs.schema["tie"], T.StructField("hash", T.LongType())]))
    mine = named.join(repeated, "hash", "left_semi").groupBy(F.col("id").alias("_id"), F.col("tie").alias("_tie")).agg(F.collect_set("hash").alias("pool"))
    joined = docs.join(mine, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie"))).drop("_id", "_tie")

    def run_joined(batches):
        for batch in batches:
            lists = batch.column("pool")
            n = np.diff(lists.offsets.to_numpy())
            keys = np.sort(_of_row(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(batch.num_rows), n)))
            yield from emit(batch.drop_columns(["pool"]), lambda values, rows, keys=keys: among(keys, _of_row(values.view(np.int64), rows)))

    return joined.mapInArrow(lean(run_joined), schema)


def _of_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return mix(values.view(np.uint64) + mix(rows.astype(np.uint64) + np.uint64(1)))
