"""Vectors: scoring against a set of queries, exact top k, and approximate top k."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many bytes of query vectors go to every worker at once; more queries are scored block by block.
BLOCK = 32 << 20
PLACES = 9
#: Bits of a signature, and the share of vectors whose signatures are near enough for an exact score.
BITS, SHARE = 512, 0.08


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=m.copy(), where=norm > 0)


def rounded(s: np.ndarray) -> np.ndarray:
    """To PLACES, halves away from zero, as SQL rounds."""
    return np.sign(s) * np.floor(np.abs(s) * 10**PLACES + 0.5) / 10**PLACES + 0.0


def cosines(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Of each row with each query, to PLACES."""
    return rounded(unit_rows(vectors) @ unit_rows(queries).T)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a column of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def query_blocks(queries: DataFrame, qid: str, vector: str):
    """Queries in blocks of bounded size: ids and a matrix."""
    rows, size = [], 0
    for r in queries.select(qid, vector).toLocalIterator():
        rows.append(r)
        size += 8 * len(r[1])
        if size >= BLOCK:
            yield [x[0] for x in rows], np.array([x[1] for x in rows], np.float64)
            rows, size = [], 0
    if rows:
        yield [x[0] for x in rows], np.array([x[1] for x in rows], np.float64)


#: So many scores are held at once by a task, whatever the sizes of its batches and of a block of queries.
CELLS, ROWS = 1 << 18, 1024


def tiles(rows: int, queries: int) -> Iterator[tuple[slice, slice]]:
    """Stretches of rows and of queries that make CELLS scores at most; the queries' stretches are the same for all rows."""
    for at in range(0, rows, ROWS):
        for q in range(0, queries, CELLS // ROWS):
            yield slice(at, min(at + ROWS, rows)), slice(q, min(q + CELLS // ROWS, queries))


class Nearest:
    """Each query's k best rows so far, ties by vid: what a task has found, whatever the number of its batches.

    Rows are held by stretches of queries, so taking some up sorts no more than a stretch.
    """

    def __init__(self, queries: int, k: int, vid: str):
        self.k, self.vid = k, vid
        self.least = np.full(queries, -np.inf)
        self.held: dict[int, list[pa.Table]] = {}

    def candidates(self, s: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of scores, rounded or not, that may be among the best; column 0 is query `at`."""
        edge = self.least[at : at + s.shape[1]]
        if self.k < len(s) and np.isinf(edge).any():
            edge = np.maximum(edge, np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k])
        # What rounds to the same lies no farther apart.
        return np.divmod(np.flatnonzero(s >= edge - 1.01 / 10**PLACES), s.shape[1])

    def add(self, queries: np.ndarray, scores: np.ndarray, rows: list[pa.Array], names: list[str]) -> None:
        """Takes up rows (columns `names`, vid among them) of these queries; they are sorted in once they are twice what is kept."""
        parts = queries // (CELLS // ROWS)
        for part in np.unique(parts).tolist():
            mine = np.flatnonzero(parts == part)
            take = pa.array(mine)
            made = pa.table([pa.array(queries[mine]), pa.array(scores[mine]), *[x.take(take) for x in rows]], names=["_q", "score", *names])
            held = self.held.setdefault(part, [])
            held.append(made)
            if len(held) == 1 or sum(x.num_rows for x in held) > 2 * self.k * (CELLS // ROWS):
                self.held[part] = [self._best(pa.concat_tables(held))]

    def _best(self, rows: pa.Table) -> pa.Table:
        by = pc.sort_indices(rows, sort_keys=[("_q", "ascending"), ("score", "descending"), (self.vid, "ascending")], null_placement="at_start")
        rows = rows.take(by).combine_chunks()
        q = rows.column("_q").to_numpy()
        heads = np.flatnonzero(np.r_[True, np.diff(q) != 0])
        sizes = np.diff(np.append(heads, len(q)))
        place = np.arange(len(q)) - np.repeat(heads, sizes)
        full = heads[sizes >= self.k]
        self.least[q[full]] = rows.column("score").to_numpy()[full + self.k - 1]
        return rows.filter(pa.array(place < self.k))

    def found(self, ids: pa.Array, schema: list[str]) -> Iterator[pa.RecordBatch]:
        """The best rows; the first column of the schema names their query."""
        for held in self.held.values():
            rows = self._best(pa.concat_tables(held))
            columns = [ids.take(rows.column("_q").combine_chunks()), *[rows.column(c).combine_chunks() for c in schema[1:]]]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema)


def score(vectors: DataFrame, queries: DataFrame, k: int | None = None, vid: str = "vec_id", qid: str = "qid", vector: str = "embedding", normalise: bool = True, keep: list[str] = ()) -> DataFrame:
    """qid, vid, score (cosine, to PLACES) of all pairs, or of each query's best k in each task.

    A block of queries is broadcast, and each batch of vectors meets it in products of CELLS scores. Pairs leave a task as
    they are made; with k, a task passes on no more than k rows a query, so what is ranked afterwards does not grow with
    the pairs.
    """
    spark, out = vectors.sparkSession, None
    fields = [T.StructField("qid", queries.schema[qid].dataType), vectors.schema[vid], *[vectors.schema[c] for c in keep], T.StructField("score", T.DoubleType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    slim = vectors.select(vid, *keep, vector)
    for ids, m in query_blocks(queries, qid, vector):
        shared = spark.sparkContext.broadcast((pa.array(ids), unit_rows(m) if normalise else m))

        def run(batches, shared=shared):
            names, q = shared.value
            best = None if k is None else Nearest(len(q), k, vid)
            for batch in batches:
                v = matrix(batch.column(vector))
                v = unit_rows(v) if normalise else v
                for at, of in tiles(batch.num_rows, len(q)):
                    raw = v[at] @ q[of].T
                    row, col = np.divmod(np.arange(raw.size), raw.shape[1]) if best is None else best.candidates(raw, of.start)
                    if not len(row):
                        continue
                    # Only what may be among the best is rounded.
                    s = rounded(raw[row, col])
                    taken = [batch.column(c).take(pa.array(row + at.start)) for c in (vid, *keep)]
                    if best is None:
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(col + of.start)), *taken, pa.array(s)], schema.names)
                    else:
                        best.add(col + of.start, s, taken, [vid, *keep])
            if best is not None:
                yield from best.found(names, schema.names)

        made = slim.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out if out is not None else spark.createDataFrame([], schema)


def score_ranges(vectors: DataFrame, queries: DataFrame, qid: str = "qid", vector: str = "embedding") -> DataFrame:
    """qid, n, low, high: of each query, how many vectors it was compared with, and its least and highest cosine.

    Tasks sum up the scores of all pairs as they make them, and pass on a row a query.
    """
    spark, out = vectors.sparkSession, None
    schema = T.StructType([T.StructField("qid", queries.schema[qid].dataType), *T.StructType.fromDDL("n long, low double, high double")])
    for ids, m in query_blocks(queries, qid, vector):
        shared = spark.sparkContext.broadcast((pa.array(ids), unit_rows(m)))

        def run(batches, shared=shared):
            names, q = shared.value
            n, low, high = 0, np.full(len(q), np.inf), np.full(len(q), -np.inf)
            for batch in batches:
                n += batch.num_rows
                v = unit_rows(matrix(batch.column(vector)))
                for at, of in tiles(batch.num_rows, len(q)):
                    s = rounded(v[at] @ q[of].T)
                    low[of], high[of] = np.minimum(low[of], s.min(0)), np.maximum(high[of], s.max(0))
            if n:
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(q), n)), pa.array(low), pa.array(high)], schema.names)

        made = vectors.select(vector).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    out = out if out is not None else spark.createDataFrame([], schema)
    return out.groupBy("qid").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def top_k(scored: DataFrame, k: int, vid: str = "vec_id") -> DataFrame:
    """rank 1..k by score, ties by id; fewer where there are fewer."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), vid)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, **names) -> DataFrame:
    return top_k(score(vectors, queries, k, **names), k, names.get("vid", "vec_id"))


def planes(dim: int, bits: int = BITS, seed: int = 42) -> np.ndarray:
    """Random hyperplanes, orthogonal within each block of `dim`; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    blocks = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))]
    return np.concatenate(blocks, 1)[:, :bits]


def signatures(vectors: np.ndarray, bits: int = BITS) -> np.ndarray:
    """On which side of each hyperplane each vector lies, packed to longs."""
    side = (vectors @ planes(vectors.shape[1], bits) > 0).astype(np.uint8)
    return np.packbits(side, axis=1, bitorder="little").view(np.uint64)


def sign(vectors: DataFrame, vector: str = "embedding", out: str = "signature", bits: int = BITS) -> DataFrame:
    """Adds each vector's signature: the index of approximate_top_k. Every row gets one."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = signatures(matrix(batch.column(vector)), bits)
                yield batch.append_column(out, pa.FixedSizeListArray.from_arrays(pa.array(found.view(np.int64).ravel()), found.shape[1]).cast(pa.list_(pa.int64())))

    return vectors.mapInArrow(run, T.StructType([*vectors.schema, T.StructField(out, T.ArrayType(T.LongType()))]))


def best_in_batch(asked: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Which scores are among the k best of their query; ties at the edge all stay, as the final ranking settles them by id."""
    by = np.lexsort((-s, asked))
    heads = np.flatnonzero(np.r_[True, np.diff(asked[by]) != 0]) if len(by) else np.empty(0, np.int64)
    sizes = np.diff(np.append(heads, len(by)))
    edge = s[by[heads + np.minimum(k, sizes) - 1]] if len(by) else s
    return by[s[by] >= np.repeat(edge, sizes)]


#: So many signatures, those of the least hash of their id, tell how many bits the nearest share of all differ in.
SAMPLE = 4096


def approximate_top_k(indexed: DataFrame, queries: DataFrame, k: int = 5, share: float = SHARE, vid: str = "vec_id", qid: str = "qid", vector: str = "embedding", signature: str = "signature") -> DataFrame:
    """qid, vid, score, rank: the best k by cosine among those whose signatures are nearest.

    indexed: what sign() made. Each batch of it is compared by signature, in 64 bytes a vector. In how many bits the
    nearest `share` of the vectors differ from a query's is taken from a sample of SAMPLE; whatever differs in no more gets
    an exact score, CELLS comparisons at a time, and each task's best k go on. No vector is left out of the comparison, and how rows are batched
    changes nothing.
    """
    spark, out = indexed.sparkSession, None
    schema = T.StructType([T.StructField("qid", queries.schema[qid].dataType), indexed.schema[vid], T.StructField("score", T.DoubleType())])
    order = F.xxhash64(F.col(vid).cast("string"))
    sample = indexed.select(vid, signature).withColumn("_h", order).orderBy("_h", vid).limit(SAMPLE).select(signature).toArrow().column(signature).combine_chunks()
    known = sample.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(sample), -1) if len(sample) else np.empty((0, 1), np.uint64)
    few = min(len(known), max(k, int(np.ceil(share * len(known)))))
    for ids, m in query_blocks(queries, qid, vector):
        asked_bits = signatures(m, 64 * known.shape[1] if len(known) else BITS)
        limit = np.zeros(len(m), np.int64)
        for at in range(0, len(m) if few else 0, CELLS // SAMPLE):
            some = slice(at, at + CELLS // SAMPLE)
            limit[some] = np.partition(differing(asked_bits[some], known), few - 1, axis=1)[:, few - 1]
        shared = spark.sparkContext.broadcast((pa.array(ids), unit_rows(m), asked_bits, limit))

        def run(batches, shared=shared):
            names, q, q_bits, limit = shared.value
            best = Nearest(len(q), k, vid)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = unit_rows(matrix(batch.column(vector)))
                own = batch.column(signature).flatten().to_numpy().view(np.uint64).reshape(len(v), -1)
                for at, of in tiles(len(v), len(q)):
                    near, asked = np.nonzero(differing(own[at], q_bits[of]) <= limit[of])
                    s = rounded(np.einsum("nd,nd->n", q[of][asked], v[at][near]))
                    some = np.flatnonzero(s >= best.least[of][asked])
                    some = some[best_in_batch(asked[some], s[some], k)] if len(some) else some
                    if len(some):
                        best.add(asked[some] + of.start, s[some], [batch.column(vid).take(pa.array(near[some] + at.start))], [vid])
            yield from best.found(names, schema.names)

        made = indexed.select(vid, vector, signature).mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return top_k(out if out is not None else spark.createDataFrame([], schema), k, vid)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each signature of a differs from each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for lane in range(b.shape[1] if len(b) else 0):
        out += np.bitwise_count(a[:, lane, None] ^ b[None, :, lane])
    return out


def embed(texts: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "embedding") -> DataFrame:
    """Adds the unit vector of each text, by any callable; it is called batch by batch, once loaded by a worker."""

    def run(batches):
        for batch in batches:
            v = unit_rows(np.asarray(embedder([x or "" for x in batch.column(text).to_pylist()]), np.float64)) if batch.num_rows else np.empty((0, 1))
            yield batch.append_column(out, pa.array(list(v), pa.list_(pa.float64())))

    return texts.mapInArrow(run, T.StructType([*texts.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def timed_report(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray], clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """strategy, n_vectors, dim and embed_ms of each strategy's index, from the vectors made of embed_text.

    Vectors are made and counted where the chunks are; what leaves a task is a row a strategy and batch, and embed_ms is the
    time that tasks spent in the embedder, whatever else they did.
    """

    def run(batches):
        for batch in batches:
            for name in pc.unique(batch.column("strategy")).to_pylist():
                texts = batch.column("embed_text").filter(pc.equal(batch.column("strategy"), name)).to_pylist()
                begin = clock()
                made = unit_rows(np.asarray(embedder([x or "" for x in texts]), np.float64))
                spent = 1000 * (clock() - begin)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(made)]), pa.array([made.shape[1]], pa.int32()), pa.array([spent])], ["strategy", "n_vectors", "dim", "embed_ms"])

    made = chunks.select("strategy", "embed_text").mapInArrow(run, "strategy string, n_vectors long, dim int, embed_ms double")
    return made.groupBy("strategy").agg(F.sum("n_vectors").alias("n_vectors"), F.max("dim").alias("dim"), F.round(F.sum("embed_ms"), 3).alias("embed_ms"))


def build_report(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """n_vectors and dim of each strategy's index: timed_report() without its time."""
    return timed_report(chunks, embedder).drop("embed_ms")
