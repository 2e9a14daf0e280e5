"""An index in segments: each row holds some thousand documents, in order of their ids, with what scores them.

Documents are numbered by their place in the order of ids, whatever kind those are, so ties that the number settles are
settled by the id. A segment has its documents' ids, parents, lengths and vectors by position, and its postings by term,
cut into blocks of documents. Of each block the largest count and the least length bound every weight in it, so blocks
that cannot reach a score that is asked for are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as t
from quillspark.sources.files import kept

from .dense import PLACES, ROWS
from .lexical import K1, B

#: Documents of a segment (65,536 at most) and of a block; ranges of documents at most, each some segments long.
SEGMENT, BLOCK, MOST_RANGES = 1024, 64, 20_000
LEX_PLACES = 4
PAIRS = 1 << 20
#: Queries that meet a segment at once; a term that this share of their pairs have in common goes by a matrix product.
STRETCH, OFTEN = 256, 0.005
#: Rows of scores, and postings, that are worked on at once: what fits a processor's own memory.
NEAR, SOME = 16, 1 << 15
_INTS = ["dl", "term_at", "dfs", "block_no", "block_at", "max_tf", "min_dl"]
#: What is longest is kept as bytes of these kinds, which Spark passes on without looking at each number.
_PACKED = {"vectors": np.float64, "docs": np.uint16, "tfs": np.int32}


def hashed_dimensions(terms: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each term, its dimension and sign in the default embedding."""
    codes = np.array([int.from_bytes(hashlib.md5(x.encode()).digest()[:4], "big") for x in terms], np.int64)
    return codes % dim, np.where(codes // dim % 2 == 0, 1.0, -1.0)


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count numbers each."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _segment(rows: pa.Table, dim: int) -> dict[str, pa.Array]:
    """The columns of a segment but for its place."""
    lists = rows.column("toks").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n, sizes = len(lists), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, tfs = np.unique(codes * n + np.repeat(np.arange(n), sizes), return_counts=True)
    code, docs = keys // n, keys % n
    heads = np.flatnonzero(np.r_[True, np.diff(keys // BLOCK if n % BLOCK == 0 else code * (n // BLOCK + 1) + docs // BLOCK) != 0]) if len(keys) else np.empty(0, np.int64)
    dfs = np.bincount(code, minlength=len(terms))
    out = {
        "dl": sizes, "term_at": np.searchsorted(code[heads], np.arange(len(terms) + 1)), "dfs": dfs, "block_no": docs[heads] // BLOCK, "block_at": np.append(heads, len(keys)),
        "max_tf": np.maximum.reduceat(tfs, heads) if len(heads) else heads, "min_dl": np.minimum.reduceat(sizes[docs], heads) if len(heads) else heads,
    }
    if "embedding" in rows.column_names:
        vectors = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    else:
        at, sign = hashed_dimensions(terms.to_pylist(), dim)
        vectors = np.bincount(docs * dim + at[code], weights=sign[code] * tfs, minlength=n * dim)
    packed = {k: pa.array([v.astype(kind).tobytes()], pa.binary()) for (k, kind), v in zip(_PACKED.items(), (vectors, docs, tfs), strict=True)}
    return {"terms": terms, **{k: pa.array(v.astype(np.int32)) for k, v in out.items()}, **packed}


def build(docs: DataFrame, dim: int, segment: int = SEGMENT) -> DataFrame:
    """The segments of docs (doc_id, parent, text and, if they have it, embedding; else counts of terms by hash are embedded).

    Rows are dealt out by ranges of ids, so one shuffle puts them in order, and each task cuts its range into segments.
    Ranges are then counted, and `first` is the number of a segment's first document among all.
    """
    spark = docs.sparkSession
    columns = ["doc_id", "parent", "text", *[c for c in docs.columns if c == "embedding"]]
    parts = min(MOST_RANGES, max(1, -(-docs.count() // segment)))
    ranged = docs.select(columns).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    cut = ranged.select(F.spark_partition_id().alias("part"), "doc_id", "parent", t.tokens(F.coalesce("text", F.lit(""))).alias("toks"), *columns[3:])
    ints = [T.StructField(x, T.ArrayType(T.IntegerType())) for x in _INTS]
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("parents", T.ArrayType(docs.schema["parent"].dataType)), T.StructField("terms", T.ArrayType(T.StringType())), *ints, *[T.StructField(x, T.BinaryType()) for x in _PACKED],
    ])

    def one(values: pa.Array) -> pa.Array:
        values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, first, part = [], 0, 0, 0

        def made(rows: pa.Table) -> pa.RecordBatch:
            found = _segment(rows, dim) | {"ids": rows.column("doc_id"), "parents": rows.column("parent")}
            lists = [found[f.name] if f.name in _PACKED else one(found[f.name]) for f in schema.fields[3:]]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([rows.num_rows], pa.int32()), *lists], schema.names)

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                waiting.append(batch)
                held += batch.num_rows
            while held >= segment:
                rows = pa.Table.from_batches(waiting)
                yield made(rows.slice(0, segment).combine_chunks())
                waiting, held, first = rows.slice(segment).to_batches(), held - segment, first + segment
        if held:
            yield made(pa.Table.from_batches(waiting).combine_chunks())

    raw = kept(cut.mapInArrow(run, schema), "segments")
    before, offsets = 0, []
    for r in sorted(raw.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        offsets.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(offsets, "part int, before long")
    return raw.join(F.broadcast(starts), "part").withColumn("first", F.col("first") + F.col("before")).drop("part", "before")


def statistics(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df (term, df, idf) and stats (n, avgdl) of all segments; documents without a term count, avgdl is 1 where there are none."""
    total = F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)
    stats = segments.select(F.col("n").cast("long").alias("n"), total.alias("dl")).agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"), F.sum("dl").alias("dl"))
    stats = kept(stats.select("n", F.coalesce(F.try_divide("dl", "n"), F.lit(1.0)).alias("avgdl")), "stats")
    counts = segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    counts = counts.crossJoin(F.broadcast(stats.select("n")))
    df = counts.select("term", "df", F.log(1 + (F.col("n").cast("double") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return kept(df, "terms"), stats


@dataclass
class Asked:
    """A block of queries: names, vectors as columns of m, the distinct known terms, each query's (terms, weights), how many
    distinct terms each has, and the mean length of documents."""

    names: list
    m: np.ndarray
    terms: list[str]
    weights: list[tuple[np.ndarray, np.ndarray]]
    n_terms: list[int]
    avgdl: float

    def by_term(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term, where its queries begin among all, and the queries and weights."""
        sizes = [len(x[0]) for x in self.weights]
        term = np.concatenate([x[0] for x in self.weights]) if sizes else np.empty(0, np.int64)
        weight = np.concatenate([x[1] for x in self.weights]) if sizes else np.empty(0)
        by = np.argsort(term, kind="stable")
        return np.searchsorted(term[by], np.arange(len(self.terms) + 1)), np.repeat(np.arange(len(sizes)), sizes)[by], weight[by]

    def stretches(self) -> list[slice]:
        return [slice(a, min(a + STRETCH, len(self.names))) for a in range(0, len(self.names), STRETCH)]

    @cached_property
    def squares(self) -> np.ndarray:
        """Of each query's vector, the sum of squares; 1 where it is 0."""
        return _squares(self.m.T)

    @cached_property
    def narrow(self) -> np.ndarray | None:
        """The vectors in single precision, if they are whole numbers."""
        return self.m.astype(np.float32) if (self.m == np.rint(self.m)).all() else None

    @cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each query's terms begin among all, and the terms and weights."""
        sizes = [len(x[0]) for x in self.weights]
        term = np.concatenate([x[0] for x in self.weights]) if sizes else np.empty(0, np.int64)
        weight = np.concatenate([x[1] for x in self.weights]) if sizes else np.empty(0)
        return np.append(0, np.cumsum(sizes, dtype=np.int64)), term, weight

    def table(self) -> np.ndarray:
        """Weights as a matrix of queries and terms."""
        out = np.zeros((len(self.names), len(self.terms)))
        for row, (terms, weights) in zip(out, self.weights, strict=True):
            row[terms] = weights
        return out


def _squares(rows: np.ndarray) -> np.ndarray:
    found = (rows * rows).sum(1)
    return np.where(found > 0, found, 1.0)


def _lex_rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 10**LEX_PLACES + 0.5) / 10**LEX_PLACES


def whole(scaled: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Scores, times a power of ten, as whole numbers: halves away from zero, as SQL rounds."""
    out = np.copysign(0.5, scaled)
    out += scaled
    return out.astype(kind)


class Segment:
    """A segment as arrays, and the scores of its documents; k is its row in a batch."""

    def __init__(self, batch: pa.RecordBatch, k: int, asked: Asked):
        self.batch, self.k = batch, k
        self.first, self.n = batch.column("first")[k].as_py(), batch.column("n")[k].as_py()
        for name in _INTS:
            setattr(self, name, self._list(name).to_numpy(zero_copy_only=False))
        self.docs, self.tfs = self._packed("docs"), self._packed("tfs")
        self.nums = self.first + np.arange(self.n)
        self.vectors = self._packed("vectors").reshape(self.n, -1)
        self.asked = asked
        found = pc.index_in(pa.array(asked.terms, pa.string()), value_set=self._list("terms").cast(pa.string()))
        self.at = found.fill_null(-1).to_numpy(zero_copy_only=False)
        norm = K1 * (1 - B + B * self.dl / asked.avgdl)
        self.weight = self.tfs * (K1 + 1) / (self.tfs + norm[self.docs])
        self.most = self.max_tf * (K1 + 1) / (self.max_tf + K1 * (1 - B + B * self.min_dl / asked.avgdl))
        self.n_blocks = -(-self.n // BLOCK)

    def _list(self, name: str) -> pa.Array:
        return self.batch.column(name).slice(self.k, 1).flatten()

    def _packed(self, name: str) -> np.ndarray:
        return np.frombuffer(self.batch.column(name)[self.k].as_buffer(), _PACKED[name])

    def rows(self, name: str, which: np.ndarray) -> pa.Array:
        return self._list(name).take(pa.array(which))

    def cosines(self, part: slice = slice(None)) -> np.ndarray:
        """Of each document with each query of the part."""
        return whole(self.nearness(part)).T / 10**PLACES

    @cached_property
    def _columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries' vectors and the documents', as columns, and the documents' sums of squares.

        Products of whole numbers are exact in single precision as long as no sum of them reaches 2**24.
        """
        squares, q = _squares(self.vectors), self.asked.narrow
        if q is not None and (self.vectors == np.rint(self.vectors)).all() and squares.max(initial=0) * self.asked.squares.max(initial=0) < 2.0**48:
            return q, self.vectors.T.astype(np.float32), squares
        return self.asked.m, self.vectors.T.copy(), squares

    def nearness(self, part: slice) -> np.ndarray:
        """Cosines of each query of the part with each document, times 10**PLACES.

        Counts of terms are whole numbers, so only one root and one division round, and a cosine that lies halfway between two
        numbers of PLACES places is exactly that: what it is rounded to rests on no order of sums.
        """
        queries, docs, squares = self._columns
        products, own = queries[:, part].T @ docs, self.asked.squares[part]
        out = np.empty(products.shape)
        # Some queries at a time, so that what is worked on stays near the processor.
        for a in range(0, len(out), NEAR):
            some = slice(a, a + NEAR)
            scale = np.sqrt(own[some, None] * squares)
            np.multiply(products[some], 10.0**PLACES, out=out[some], dtype=np.float64)
            out[some] /= scale
        return out

    @cached_property
    def _often(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of the terms that go by a product (terms by documents), and each asked term's row of them or -1."""
        used = np.bincount(self.asked.flat[1], minlength=len(self.at)) * np.where(self.at >= 0, self.dfs[self.at] if len(self.dfs) else 0, 0)
        chosen = np.flatnonzero(used > OFTEN * self.n * len(self.asked.names))
        place = np.full(len(self.at), -1)
        place[chosen] = np.arange(len(chosen))
        first, last = self._postings(self.at[chosen])
        which, out = runs(first, last - first), np.zeros((len(chosen), self.n))
        out[np.repeat(np.arange(len(chosen)), last - first), self.docs[which]] = self.weight[which]
        return out, place

    @cached_property
    def _places(self) -> np.ndarray:
        return self.docs.astype(np.int64)

    def _postings(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.block_at[self.term_at[own]], self.block_at[self.term_at[own + 1]]

    def scores(self, part: slice) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and BM25 of each query of the part with each document, times the powers of ten they are rounded to.

        Terms that many queries and documents have are a matrix product; postings of the others are summed up, so few
        at a time that they stay near the processor.
        """
        (starts, terms, weights), (often, place) = self.asked.flat, self._often
        rows, mine = part.stop - part.start, slice(starts[part.start], starts[part.stop])
        q = np.repeat(np.arange(rows), np.diff(starts[part.start : part.stop + 1]))
        term, weight = terms[mine], weights[mine] * 10**LEX_PLACES
        asked, row = np.zeros((rows, len(often))), place[term]
        asked[q[row >= 0], row[row >= 0]] = weight[row >= 0]
        lex = asked @ often
        rare = np.flatnonzero((row < 0) & (self.at[term] >= 0))
        first, last = self._postings(self.at[term[rare]])
        sizes, at, flat = last - first, q[rare] * self.n, lex.reshape(-1)
        steps = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + SOME, SOME))
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            which = runs(first[a:b], sizes[a:b])
            key = np.repeat(at[a:b], sizes[a:b])
            key += self._places.take(which)
            value = self.weight.take(which)
            value *= np.repeat(weight[rare[a:b]], sizes[a:b])
            np.add.at(flat, key, value)
        return self.nearness(part), lex

    def bounds(self, table: np.ndarray) -> np.ndarray:
        """What no lexical score of each query in each block exceeds; table: the queries' weights."""
        known = np.flatnonzero(self.at >= 0)
        first, last = self.term_at[self.at[known]], self.term_at[self.at[known] + 1]
        which = runs(first, last - first)
        most = np.zeros((len(known), self.n_blocks))
        most[np.repeat(np.arange(len(known)), last - first), self.block_no[which]] = self.most[which]
        return table[:, known] @ most + 10.0**-LEX_PLACES

    def lexical_of(self, chosen: np.ndarray, by_term: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """BM25 of every query (rows) with some documents: each of their postings goes to all queries that ask for its term."""
        at, asked_by, weights = by_term
        place = np.full(self.n, -1)
        place[chosen] = np.arange(len(chosen))
        known = np.flatnonzero(self.at >= 0)
        first, last = self.block_at[self.term_at[self.at[known]]], self.block_at[self.term_at[self.at[known] + 1]]
        which, term = runs(first, last - first), np.repeat(known, last - first)
        mine = place[self.docs[which]] >= 0
        which, term = which[mine], term[mine]
        sizes = at[term + 1] - at[term]
        out = np.zeros(len(self.asked.names) * len(chosen))
        # So many postings at a time that some million sums are made at once.
        steps = np.searchsorted(np.cumsum(sizes), np.arange(0, int(sizes.sum()) + PAIRS, PAIRS))
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            q = runs(at[term[a:b]], sizes[a:b])
            key = asked_by[q] * len(chosen) + np.repeat(place[self.docs[which[a:b]]], sizes[a:b])
            out += np.bincount(key, weights[q] * np.repeat(self.weight[which[a:b]], sizes[a:b]), len(out))
        return _lex_rounded(out).reshape(len(self.asked.names), len(chosen))

    def lexical(self, q: int, alive: np.ndarray | None = None) -> np.ndarray:
        """BM25 of each document, to LEX_PLACES; with alive, only blocks that are get theirs, others 0."""
        out = np.zeros(self.n)
        for term, weight in zip(*self.asked.weights[q], strict=True):
            own = self.at[term]
            if own < 0:
                continue
            first, last = self.term_at[own], self.term_at[own + 1]
            if alive is None:
                which = slice(self.block_at[first], self.block_at[last])
            else:
                blocks = first + np.flatnonzero(alive[self.block_no[first:last]])
                which = runs(self.block_at[blocks], self.block_at[blocks + 1] - self.block_at[blocks])
            out[self.docs[which]] += weight * self.weight[which]
        return _lex_rounded(out)


class Best:
    """Each query's k best (score, number) so far; ties go to the lesser number."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * queries
        self.nums = [np.empty(0, np.int64)] * queries

    def least(self, q: int) -> tuple[float, float]:
        """What a document must beat: none is left out before k are found."""
        return (self.scores[q][-1], self.nums[q][-1]) if len(self.scores[q]) == self.k else (-np.inf, -1)

    def add(self, q: int, scores: np.ndarray, nums: np.ndarray) -> np.ndarray:
        """Which of these come among the best; those are taken up."""
        score, num = self.least(q)
        few = np.flatnonzero((scores > score) | ((scores == score) & (nums < num)))
        if len(few) > self.k:
            edge = np.partition(scores[few], len(few) - self.k)[len(few) - self.k]
            few = few[scores[few] >= edge]
            few = few[np.lexsort((nums[few], -scores[few]))[: self.k]]
        if len(few):
            s, m = np.concatenate((self.scores[q], scores[few])), np.concatenate((self.nums[q], nums[few]))
            by = np.lexsort((m, -s))[: self.k]
            self.scores[q], self.nums[q] = s[by], m[by]
        return few


class Leaders:
    """Of a stretch of queries, each one's k best documents so far: score, number and the other score, as whole numbers. Ties go
    to the lesser number. What comes up waits until it is twice as many rows as are kept, and is sorted in with them."""

    def __init__(self, queries: int, k: int):
        self.queries, self.k = queries, k
        self.least = np.full(queries, -np.inf)
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, scores: np.ndarray, others: np.ndarray, first: int) -> None:
        """Takes up what may be among the best of these documents (columns), numbered from `first` on."""
        if scores.shape[1] > self.k and np.isinf(self.least).any():
            # The k-th best of some documents is no better than that of all.
            self.least = np.maximum(self.least, whole(np.partition(scores, -self.k, axis=1)[:, -self.k]))
        q, doc = np.divmod(np.flatnonzero(scores >= self.least[:, None] - 1), scores.shape[1])
        self.take(q, whole(scores[q, doc]), first + doc, whole(others[q, doc]))

    def take(self, *rows: np.ndarray) -> None:
        """Takes up rows: query, score, number and other score."""
        if len(rows[0]):
            self.rows.append(rows)
            if sum(len(x[0]) for x in self.rows) > 2 * self.queries * self.k:
                self._narrow()
                if len(self.rows[0][0]) > 2 * self.queries * self.k:
                    self.settle()

    def _narrow(self) -> None:
        """Leaves out what is below a query's k-th best; nothing is sorted, and what ties with that stays."""
        rows = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
        sizes = np.bincount(rows[0], minlength=self.queries)
        if sizes.max() <= 8 * self.k:
            by = np.argsort(rows[0].astype(np.uint16), kind="stable")
            table = np.full((self.queries, max(self.k, sizes.max())), np.iinfo(np.int64).min)
            table[rows[0][by], np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows[1][by]
            edge = np.partition(table, -self.k, axis=1)[:, -self.k]
            self.least = np.where(sizes >= self.k, np.maximum(self.least, edge), self.least)
        good = np.flatnonzero(rows[1] >= self.least[rows[0]])
        self.rows = [tuple(x[good] for x in rows)]

    def settle(self) -> tuple[np.ndarray, ...]:
        """The best of each query: its number, score, document and other score."""
        if self.rows:
            rows = [np.concatenate(x) for x in zip(*self.rows, strict=True)]
            good = np.flatnonzero(rows[1] >= self.least[rows[0]])
            by = good[np.lexsort((rows[2][good], -rows[1][good], rows[0][good]))]
            q = rows[0][by]
            heads = np.flatnonzero(np.r_[True, np.diff(q) != 0]) if len(q) else np.empty(0, np.int64)
            sizes = np.diff(np.append(heads, len(q)))
            full = heads[sizes >= self.k]
            self.least[q[full]] = rows[1][by[full + self.k - 1]]
            by = by[np.arange(len(q)) - np.repeat(heads, sizes) < self.k]
            self.rows = [tuple(x[by] for x in rows)]
        return self.rows[0] if self.rows else tuple(np.empty(0, np.int64) for _ in range(4))


def _leading(asked: Asked, most: int, batches: Iterator[pa.RecordBatch], seen: Callable[[Segment], None]) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """Each stretch of queries and the query, number, cosine and lexical score of what is among the best `most` of either ranking
    of all these segments; a document may come twice."""
    parts = asked.stretches()
    leaders = [(Leaders(x.stop - x.start, most), Leaders(x.stop - x.start, most)) for x in parts]
    for batch in batches:
        for k in range(batch.num_rows):
            seg = Segment(batch, k, asked)
            seen(seg)
            for part, (near, words) in zip(parts, leaders, strict=True):
                dense, lex = seg.scores(part)
                near.add(dense, lex, seg.first)
                words.add(lex, dense, seg.first)
    for part, (near, words) in zip(parts, leaders, strict=True):
        a, b = near.settle(), words.settle()
        yield part, [np.concatenate(x) for x in ((a[0], b[0]), (a[2], b[2]), (a[1], b[3]), (a[3], b[1]))]


def first_of(asked: Asked, most: int) -> Callable:
    """For mapInArrow over segments: q, num, doc_id, parent, dense, lex of documents among the best `most` of either ranking
    in the task. They leave it at its end, so no more than 2 * most rows a query do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = []

        def seen(seg: Segment) -> None:
            names.append((seg.nums, *[seg.rows(x, np.arange(seg.n)) for x in ("ids", "parents")]))

        for part, (q, num, dense, lex) in _leading(asked, most, batches, seen):
            if not len(q):
                continue
            nums, ids, parents = np.concatenate([x[0] for x in names]), *[pa.concat_arrays([x[j] for x in names]) for j in (1, 2)]
            one = np.unique(num * STRETCH + q, return_index=True)[1]
            by = np.argsort(nums)
            place = pa.array(by[np.searchsorted(nums[by], num[one])])
            scores = [pa.array(x[one] / 10**places) for x, places in ((dense, PLACES), (lex, LEX_PLACES))]
            yield pa.RecordBatch.from_arrays([pa.array((q[one] + part.start).astype(np.int32)), pa.array(num[one]), ids.take(place), parents.take(place), *scores], ["q", "num", "doc_id", "parent", "dense", "lex"])

    return run


#: What leaves a task is a row for each stretch of queries, its columns packed: rows of single documents cost the JVM more than
#: it takes to make them.
LEADING, COUNTED = "part int, q binary, num binary, dense binary, lex binary", "part int, higher binary, above binary"
RANKED, PLACED = "q int, num long, dense double, lex double, rd int, rl int", "q int, num long, ahead long"


def _packed_row(part: slice, columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([part.start], pa.int32()), *[pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in columns]], names)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The first query of a stretch and the columns, for each row."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column("part")[k].as_py(), [np.frombuffer(x[k].as_buffer(), np.int64) for x in batch.columns[1:]]


def leading_of(asked: Asked, most: int) -> Callable:
    """For mapInArrow over segments: as first_of(), without names, as LEADING."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, columns in _leading(asked, most, batches, lambda seg: None):
            if len(columns[0]):
                yield _packed_row(part, columns, LEADING)

    return run


def ranked_of(asked: Asked, most: int) -> Callable:
    """For mapInArrow over what leading_of() made in all tasks, in order of part: RANKED. A rank beyond `most` is most + 1."""

    def ranks(part: int, near: Leaders, words: Leaders) -> pa.RecordBatch:
        a, b = near.settle(), words.settle()
        q, num, dense, lex = (np.concatenate(x) for x in ((a[0], b[0]), (a[2], b[2]), (a[1], b[3]), (a[3], b[1])))
        place = [np.arange(len(x[0])) - np.searchsorted(x[0], x[0]) + 1 for x in (a, b)]
        _, one, which = np.unique(num * STRETCH + q, return_index=True, return_inverse=True)
        rd, rl = np.full((2, len(one)), most + 1, np.int32)
        rd[which[: len(a[0])]], rl[which[len(a[0]) :]] = place
        columns = [(q[one] + part).astype(np.int32), num[one], dense[one] / 10**PLACES, lex[one] / 10**LEX_PLACES, rd, rl]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [x.split()[0] for x in RANKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near, words = None, None, None
        for part, (q, num, dense, lex) in _by_part(batches):
            if part != at:
                if at is not None:
                    yield ranks(at, near, words)
                queries = min(STRETCH, len(asked.names) - part)
                at, near, words = part, Leaders(queries, most), Leaders(queries, most)
            # A document that a task has in both rankings comes twice.
            one = np.unique(num * STRETCH + q, return_index=True)[1]
            near.take(q[one], dense[one], num[one], lex[one])
            words.take(q[one], lex[one], num[one], dense[one])
        if at is not None:
            yield ranks(at, near, words)

    return run


class Ahead:
    """How many documents come before each of some candidates of each query in one ranking.

    candidates: by query, (scores, numbers); places: to how many the scores are rounded.
    """

    def __init__(self, candidates: dict[int, tuple], queries: int, places: int):
        sizes = np.zeros(queries, np.int64)
        for q, v in candidates.items():
            sizes[q] = len(v[0])
        rows = [candidates[q] for q in sorted(candidates)]
        self.at = np.append(0, np.cumsum(sizes))
        self.q = np.repeat(np.arange(queries), sizes)
        self.scores = whole(np.concatenate([x[0] for x in rows]) * 10**places) if rows else np.empty(0, np.int64)
        self.nums = np.concatenate([x[1] for x in rows]) if rows else np.empty(0, np.int64)
        # In order of scores they are found faster.
        by = np.lexsort((self.nums, self.scores, self.q))
        self.scores, self.nums = self.scores[by], self.nums[by]
        self.counts = np.zeros(len(self.q), np.int64)

    def of(self, part: slice) -> slice:
        """The candidates of a stretch of queries."""
        return slice(self.at[part.start], self.at[part.stop])

    def add(self, scores: np.ndarray, part: slice, first: int) -> None:
        """Counts these documents (columns), numbered from `first` on, for the queries of the part (rows)."""
        mine, n = self.of(part), scores.shape[1]
        score, num, q, counts = self.scores[mine], self.nums[mine], self.q[mine] - part.start, self.counts[mine]
        if not len(q):
            return
        # All of a segment that stands before a candidate come ahead of it when they are equal.
        limit = score - (num >= first + n)
        kind = np.int32 if max(scores.max(), limit.max()) < 2**31 - 1 else np.int64
        scores, limit = whole(scores, kind), limit.astype(kind)
        ordered, place = np.sort(scores, axis=1), np.zeros(len(q), np.int64)
        ends = (self.at[part.start : part.stop + 1] - mine.start).tolist()
        for row, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if b > a:
                place[a:b] = ordered[row].searchsorted(limit[a:b], "right")
        counts += n - place
        # A candidate of this segment comes after those that equal it and stand before it; most have no equal.
        own = np.flatnonzero((num >= first) & (num < first + n) & (place > 1))
        own = own[ordered[q[own], place[own] - 2] == limit[own]]
        for at in range(0, len(own), ROWS):
            some = own[at : at + ROWS]
            equal = (scores[q[some]] == score[some, None]) & (np.arange(n) < (num[some] - first)[:, None])
            counts[some] += equal.sum(1)


def ahead_of(asked: Asked, near: dict[int, tuple], words: dict[int, tuple]) -> Callable:
    """For mapInArrow over segments: as COUNTED, how many documents of the task come before each candidate by cosine (higher) and by
    lexical score (above). near, words: by query, the (scores, numbers) of candidates whose rank is not known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Ahead(near, len(asked.names), PLACES), Ahead(words, len(asked.names), LEX_PLACES)
        for batch in batches:
            for k in range(batch.num_rows):
                seg = Segment(batch, k, asked)
                for part in asked.stretches():
                    for one, scores in zip(both, seg.scores(part), strict=True):
                        one.add(scores, part, seg.first)
        for part in asked.stretches():
            yield _packed_row(part, [x.counts[x.of(part)] for x in both], COUNTED)

    return run


def placed_of(asked: Asked, near: dict[int, tuple], words: dict[int, tuple]) -> Callable:
    """For mapInArrow over what ahead_of() made in all tasks, in order of part: PLACED, a row for each candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Ahead(near, len(asked.names), PLACES), Ahead(words, len(asked.names), LEX_PLACES)
        seen = set()
        for part, counts in _by_part(batches):
            part = slice(part, min(part + STRETCH, len(asked.names)))
            seen.add((part.start, part.stop))
            for one, found in zip(both, counts, strict=True):
                one.counts[one.of(part)] += found
        for start, stop in sorted(seen):
            for one in both:
                mine = one.of(slice(start, stop))
                yield pa.RecordBatch.from_arrays([pa.array(one.q[mine].astype(np.int32)), pa.array(one.nums[mine]), pa.array(one.counts[mine])], ["q", "num", "ahead"])

    return run


def all_of(asked: Asked, width: int = 64) -> Callable:
    """For mapInArrow over segments: q, num, doc_id, parent, dense, lex of every document for every query, `width` queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seg = Segment(batch, k, asked)
                every = np.arange(seg.n)
                for a in range(0, len(asked.names), width):
                    dense = seg.cosines(slice(a, a + width))
                    for q in range(a, a + dense.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(seg.n, q, np.int32)), pa.array(seg.nums), seg.rows("ids", every), seg.rows("parents", every), pa.array(dense[:, q - a]), pa.array(seg.lexical(q))], ["q", "num", "doc_id", "parent", "dense", "lex"])

    return run


def ends_of(asked: Asked) -> Callable:
    """For mapInArrow over segments: q and the least and highest cosine and lexical score of all documents of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(asked.names)
        low, high, some = np.full((2, n), np.inf), np.full((2, n), -np.inf), False
        for batch in batches:
            for k in range(batch.num_rows):
                seg, some = Segment(batch, k, asked), True
                dense = seg.cosines()
                low[0], high[0] = np.minimum(low[0], dense.min(0)), np.maximum(high[0], dense.max(0))
                for q in range(n):
                    lex = seg.lexical(q)
                    low[1, q], high[1, q] = min(low[1, q], lex.min()), max(high[1, q], lex.max())
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *[pa.array(x) for x in (low[0], high[0], low[1], high[1])]], ["q", "d0", "d1", "l0", "l1"])

    return run


def weighted_best(asked: Asked, ends: dict[int, tuple], alphas: list[float], most: int) -> Callable:
    """For mapInArrow over segments: alpha, q, doc_id, parent and f of documents among the best `most` of a query's weighted
    scores so far in the task. ends: by query, what ends_of() found over all segments."""

    def scaled(x: np.ndarray, low: float, high: float) -> np.ndarray:
        return (x - low) / (high - low) if high > low else np.zeros(len(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(len(asked.names), most) for _ in alphas]
        for batch in batches:
            for k in range(batch.num_rows):
                seg, found = Segment(batch, k, asked), []
                dense = seg.cosines()
                for q, (d0, d1, l0, l1) in ends.items():
                    d01, l01 = scaled(dense[:, q], d0, d1), scaled(seg.lexical(q), l0, l1)
                    for a, best in zip(alphas, bests, strict=True):
                        f = np.floor((a * d01 + (1 - a) * l01) * 10**6 + 0.5) / 10**6
                        chosen = best.add(q, f, seg.nums)
                        if len(chosen):
                            found.append((a, q, chosen, f[chosen]))
                if found:
                    sizes, chosen = [len(x[2]) for x in found], np.concatenate([x[2] for x in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], sizes)), pa.array(np.repeat([x[1] for x in found], sizes).astype(np.int32)), seg.rows("ids", chosen), seg.rows("parents", chosen), pa.array(np.concatenate([x[3] for x in found]))], ["alpha", "q", "doc_id", "parent", "f"])

    return run
