"""Approximate search over cells: vectors lie in the folder of their nearest centroid, and a query opens few of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.files import scratch

from .dense import CELLS, Nearest, matrix, query_blocks, rounded, tiles, top_k, unit_rows

#: Centroids are fitted to so many vectors at most, those of the least hash of their id; every vector then gets a cell.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
MOST_CELLS, ROUNDS = 4096, 12
#: The share of cells that a query opens.
PROBES = 0.1


@dataclass
class CellIndex:
    """table: vid, vector and cell, a folder of it for each cell; centroids: unit rows by cell."""

    table: DataFrame
    centroids: np.ndarray
    vid: str
    vector: str


def cells_of(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the first of equals; CELLS scores are held at once."""
    step = max(1, CELLS // max(1, len(centroids)))
    found = [rounded(unit[a : a + step] @ centroids.T).argmax(1) for a in range(0, len(unit), step)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def centroids_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Spherical k-means: unit means of the vectors nearest to each; a cell without any keeps its place."""
    unit = unit_rows(sample)
    at = unit[np.random.default_rng(seed).permutation(len(unit))[:cells]].copy()
    for _ in range(rounds):
        nearest = cells_of(unit, at)
        sums = np.zeros_like(at)
        np.add.at(sums, nearest, unit)
        means = unit_rows(sums)
        at = np.where(np.abs(sums).sum(1, keepdims=True) > 0, means, at)
    return at


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None, vid: str = "vec_id", vector: str = "embedding") -> CellIndex:
    """The index of vectors, below path. Rows without a vector are left out; all others are assigned, whatever their number.

    There are as many cells as the root of the number of vectors, MOST_CELLS at most, unless stated. A cell that holds
    many vectors is written by many tasks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vid, vector).where(F.col(vector).isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    wanted = cells or min(MOST_CELLS, max(1, int(size.n**0.5)))
    few = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size.dim or 1)))
    order = F.xxhash64(F.col(vid).cast("string"))
    sample = rows.withColumn("_h", order).orderBy("_h", vid).limit(few).select(vector).toArrow().column(vector)
    at = centroids_of(matrix(sample.combine_chunks()), wanted) if size.n else np.empty((0, 1))
    shared = spark.sparkContext.broadcast(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = cells_of(unit_rows(matrix(batch.column(vector))), shared.value)
                yield batch.append_column("cell", pa.array(found.astype(np.int32)))

    placed = rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())]))
    path = path or scratch(spark, "cells")
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    named = [(j, [float(x) for x in row]) for j, row in enumerate(at)]
    spark.createDataFrame(named, "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path, vid, vector, rows.schema)


def load(spark: SparkSession, path: str, vid: str = "vec_id", vector: str = "embedding", schema: T.StructType | None = None) -> CellIndex:
    """The index below path."""
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema, T.StructField("cell", T.IntegerType())]))
    return CellIndex(reader.parquet(f"{path}/vectors"), np.array([r.centroid for r in rows], np.float64), vid, vector)


def probed(index: CellIndex, queries: np.ndarray, probes: float = PROBES) -> np.ndarray:
    """The cells that each query opens, nearest first: three at least, if there are as many."""
    n = min(len(index.centroids), max(3, int(np.ceil(probes * len(index.centroids)))))
    unit, step = unit_rows(queries), max(1, CELLS // max(1, len(index.centroids)))
    found = [np.argsort(-rounded(unit[a : a + step] @ index.centroids.T), axis=1, kind="stable")[:, :n].astype(np.int32) for a in range(0, len(unit), step)]
    return np.concatenate(found) if found else np.empty((0, n), np.int32)


def askers_of(cells: np.ndarray) -> dict[int, np.ndarray]:
    """Of each cell that any query opens, those queries in order; cells: as probed() gives them."""
    opened = cells.ravel()
    by = np.argsort(opened, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(opened[by]) != 0]) if len(by) else by
    return {int(opened[x[0]]): (x // cells.shape[1]).astype(np.int32) for x in np.split(by, heads[1:]) if len(x)}


def nearest(index: CellIndex, queries: DataFrame, k: int = 5, probes: float = PROBES, qid: str = "qid", vector: str = "embedding") -> DataFrame:
    """qid, vid, score and rank of the best k by cosine in the cells that each query opens; fewer where those hold fewer.

    Cells that no query of a block opens are not read. Within a batch each cell's vectors meet the queries that opened it,
    CELLS scores at a time, and a task passes on k rows a query at most.
    """
    spark, out, vid, own_vector = queries.sparkSession, None, index.vid, index.vector
    schema = T.StructType([T.StructField("qid", queries.schema[qid].dataType), index.table.schema[index.vid], T.StructField("score", T.DoubleType())])
    for ids, m in query_blocks(queries, qid, vector) if len(index.centroids) else ():
        askers = askers_of(probed(index, m, probes))
        shared = spark.sparkContext.broadcast((pa.array(ids), unit_rows(m), askers))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, askers = shared.value
            best = Nearest(len(q), k, vid)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, own = unit_rows(matrix(batch.column(own_vector))), batch.column("cell").to_numpy()
                for c in np.unique(own).tolist():
                    rows = np.flatnonzero(own == c)
                    for at, of in tiles(len(rows), len(askers[c])):
                        mine, some = askers[c][of], rows[at]
                        s = rounded(v[some] @ q[mine].T)
                        edge = best.least[mine]
                        if k < len(s):
                            edge = np.maximum(edge, np.partition(s, len(s) - k, axis=0)[len(s) - k])
                        row, col = np.nonzero(s >= edge)
                        if len(row):
                            best.add(mine[col].astype(np.int64), s[row, col], [batch.column(vid).take(pa.array(some[row]))], [vid])
            yield from best.found(names, schema.names)

        made = index.table.where(F.col("cell").isin(list(askers))).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return top_k(out if out is not None else spark.createDataFrame([], schema), k, index.vid)
