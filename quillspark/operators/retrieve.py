"""Hybrid retrieval over an index: two rankings of every candidate, fused, and collapsed to one hit a parent.

An index is made once, may be saved, and serves any number of calls. Only documents that one of the two rankings puts
among its first can come first in their fusion, so ranks are taken for those alone; see bounded().
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import text as t
from quillspark.sources.files import kept

from . import blocks
from .dense import PLACES, embed

# Defaults of retrieval.
TOP_K, OVERFETCH, RRF_K = 5, 4, 60
DIM = 64
ALPHAS = [0.9, 0.8, 0.7, 0.6, 0.5, 0.3]
# End of fixed values.

Embedder = Callable[[list[str]], np.ndarray]


def feature_vectors(df: DataFrame, *columns: str) -> DataFrame:
    """The columns and embedding: counts of terms by hash, each with a sign of its own. The default, free of any model.

    Terms are summed up by dimension, so a text costs its tokens, not tokens times dimensions.
    """
    code = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long")
    words = df.select(*columns, F.explode_outer(t.tokens(F.coalesce("text", F.lit("")))).alias("w"))
    sign = F.when(F.col("w").isNull(), 0.0).when(F.floor(code / DIM) % 2 == 0, 1.0).otherwise(-1.0)
    sums = words.groupBy(*columns, F.coalesce(code % DIM, F.lit(0)).cast("int").alias("d")).agg(F.sum(sign).alias("x"))
    maps = sums.groupBy(*columns).agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
    return maps.select(*columns, F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0.0)) for i in range(DIM)]).alias("embedding"))


@dataclass
class Index:
    """segments (see blocks), df (term, df, idf) and stats (n, avgdl). query_embedder is the route of questions, which may be
    another than that of passages; without one they get the default embedding."""

    segments: DataFrame
    df: DataFrame
    stats: DataFrame
    query_embedder: Embedder | None = None


TABLES = ("segments", "df", "stats")


def build_index(docs: DataFrame, embedder: Embedder | None = None, query_embedder: Embedder | None = None, segment: int = blocks.SEGMENT) -> Index:
    """The index of docs (doc_id, text, parent), written to the shared folder. Ids and parents may be of any type that sorts.

    An embedder of passages asks for one of queries. The default embedding is made of the documents' own terms.
    """
    if (embedder is None) != (query_embedder is None):
        raise ValueError("passages and queries need an embedder each")
    if embedder is not None:
        docs = kept(embed(docs.select("doc_id", "parent", F.coalesce("text", F.lit("")).alias("text")), embedder), "embedded")
    segments = blocks.build(docs, DIM, segment)
    return Index(segments, *blocks.statistics(segments), query_embedder)


def save_index(index: Index, path: str) -> None:
    """Every table of the index, below path."""
    for name in TABLES:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, query_embedder: Embedder | None = None) -> Index:
    """The index that save_index() wrote; raises where a table is missing."""
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in TABLES], query_embedder)


def passages(chunks: DataFrame, context: bool = True) -> DataFrame:
    """Chunks as what is indexed and read: doc_id is the chunk's id, parent its document's, text what is embedded, and context
    what is read once it is found. Without contexts, what is read are the parents themselves; see answer.ask()."""
    columns = [F.col("chunk_id").alias("doc_id"), F.col("doc_id").cast("string").alias("parent"), F.col("embed_text").alias("text"), F.col("context_text").alias("context"), F.col("title")]
    return chunks.select(columns if context else columns[:3])


def asked_blocks(index: Index, queries: DataFrame) -> Iterator[blocks.Asked]:
    """The queries with their terms' weights, in blocks of bounded size; a term that no document has weighs nothing."""
    spark = queries.sparkSession
    avgdl = (index.stats.first() or {"avgdl": 1.0})["avgdl"] or 1.0
    rows = queries.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    if index.query_embedder is not None:
        rows = embed(rows, index.query_embedder)
    rows = rows.select("item_id", t.tokens(F.col("text")).alias("toks"), *rows.columns[2:])
    for block in _taken(rows.toLocalIterator(), QUERIES):
        counts = [Counter(r.toks) for r in block]
        every = sorted({x for c in counts for x in c})
        known = spark.createDataFrame([(x,) for x in every], "term string")
        idf = {r.term: r.idf for r in index.df.join(F.broadcast(known), "term", "left_semi").select("term", "idf").collect()} if every else {}
        number = {x: j for j, x in enumerate(sorted(idf))}
        mine = [sorted(x for x in c if x in idf) for c in counts]
        weights = [(np.array([number[x] for x in xs], np.int64), np.array([c[x] * idf[x] for x in xs])) for xs, c in zip(mine, counts, strict=True)]
        m = np.array([r.embedding for r in block], np.float64) if index.query_embedder else _hashed(counts, every)
        yield blocks.Asked([r.item_id for r in block], m.T.copy(), sorted(idf), weights, [len(c) for c in counts], avgdl)


def _taken(rows: Iterator, most: int) -> Iterator[list]:
    while block := list(islice(rows, most)):
        yield block


def _hashed(counts: list[Counter], every: list[str]) -> np.ndarray:
    """The default embeddings of queries, as feature_vectors() makes them."""
    at, sign = blocks.hashed_dimensions(every, DIM)
    number = {x: j for j, x in enumerate(every)}
    out = np.zeros((len(counts), DIM))
    for row, c in zip(out, counts, strict=True):
        for x, n in c.items():
            row[at[number[x]]] += n * sign[number[x]]
    return out


def _scored(index: Index, queries: DataFrame, schema: T.StructType | str, run: Callable) -> Iterator[tuple[blocks.Asked, DataFrame]]:
    """Each block of queries, and what run(block) makes of all segments."""
    for asked in asked_blocks(index, queries):
        yield asked, index.segments.mapInArrow(run(asked), schema)


def _found(index: Index) -> T.StructType:
    kinds = {x: index.segments.schema[y].dataType.elementType for x, y in (("doc_id", "ids"), ("parent", "parents"))}
    return T.StructType([T.StructField("q", T.IntegerType()), T.StructField("num", T.LongType()), *[T.StructField(x, k) for x, k in kinds.items()], T.StructField("dense", T.DoubleType()), T.StructField("lex", T.DoubleType())])


def _named(df: DataFrame, asked: blocks.Asked, queries: DataFrame) -> DataFrame:
    """df with qid, term_hits and query_terms in place of the number of the query in its block."""
    longs = [T.StructField(x, T.LongType()) for x in ("term_hits", "query_terms")]
    kind = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("qid", queries.schema["item_id"].dataType), *longs])
    rows = [(j, name, len(asked.weights[j][0]), asked.n_terms[j]) for j, name in enumerate(asked.names)]
    return df.join(F.broadcast(queries.sparkSession.createDataFrame(rows, kind)), "q").drop("q")


def candidates(docs: DataFrame, queries: DataFrame, index: Index | None = None) -> DataFrame:
    """qid, doc_id, parent, dense, lex of every document for every query; a pair without a common term has lex 0.

    docs: doc_id, text, parent; queries: item_id, text. This is for reports on all pairs; retrieval goes by bounded().
    """
    index, out = index or build_index(docs), None
    for asked, made in _scored(index, queries, _found(index), blocks.all_of):
        made = _named(made, asked, queries).select("qid", "doc_id", "parent", "dense", "lex")
        out = made if out is None else out.unionByName(made)
    return out if out is not None else _none(index, queries).drop("num", "rd", "rl")


def _none(index: Index, queries: DataFrame) -> DataFrame:
    found = [f for f in _found(index).fields if f.name != "q"]
    return queries.sparkSession.createDataFrame([], T.StructType([T.StructField("qid", queries.schema["item_id"].dataType), *found, T.StructField("rd", T.LongType()), T.StructField("rl", T.LongType())]))


def ranked(df: DataFrame, by: Column, out: str) -> DataFrame:
    """1-based rank of each query's candidates by descending score, ties by doc_id; a query may have any number of them.

    Rows are dealt out by ranges of (query, score, id) and written. A rank is the place within a range, after what the
    query has in the ranges before; so no task sorts more than a range, and what is summed up are counts of ranges.
    """
    order = ["qid", F.col("_by").desc(), "doc_id"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_by", by).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    dealt = kept(dealt, "ranges")
    counts = dealt.groupBy("qid", "_range").agg(F.count("*").alias("_n"))
    before = counts.select("qid", "_range", (F.sum("_n").over(Window.partitionBy("qid").orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("qid", "_range").orderBy(F.col("_by").desc(), "doc_id"))
    return dealt.withColumn("_in", inside).join(before, ["qid", "_range"]).select(*df.columns, (F.col("_before") + F.col("_in")).alias(out))


def numbered(df: DataFrame, by: Column, out: str, carry: list[str]) -> DataFrame:
    """qid, doc_id, carry and the rank that ranked() gives, from one shuffle and one table.

    Rows are dealt out by ranges of (query, score, id), sorted there and numbered as they are written, without the score.
    Of each query in each range only the first number and the count are summed up: as many rows as there are queries and
    ranges together, which are broadcast.
    """
    order = ["qid", F.col("_by").desc(), "doc_id"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select("qid", "doc_id", *carry, by.alias("_by")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = kept(dealt.select("qid", "doc_id", *carry, F.monotonically_increasing_id().alias("_place")), "ranges", compression="zstd")
    dealt = dealt.withColumn("_range", F.shiftright("_place", 33))
    counts = dealt.groupBy("qid", "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("qid").orderBy("_range")) - F.col("_n")
    shifts = counts.select("qid", "_range", (before - F.col("_first") + 1).alias("_shift"))
    return dealt.join(F.broadcast(shifts), ["qid", "_range"]).select("qid", "doc_id", *carry, (F.col("_place") + F.col("_shift")).alias(out))


def fused_score(k: int = RRF_K) -> Column:
    return F.round(1 / (F.lit(k) + F.col("rd")).cast("double") + 1 / (F.lit(k) + F.col("rl")).cast("double"), 9)


def reciprocal(df: DataFrame, k: int = RRF_K) -> DataFrame:
    """Adds rd, rl and fused, the sum of reciprocal ranks."""
    rest = [c for c in df.columns if c not in ("qid", "doc_id")]
    out = numbered(numbered(df, F.col("dense"), "rd", rest), F.col("lex"), "rl", [*rest, "rd"])
    return out.withColumn("fused", fused_score(k))


def places(df: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, doc_id, rd, rl and fused as of reciprocal(). Scores travel as whole numbers, and not beyond their ranking."""
    lex = F.round(F.col("lex") * 10**blocks.LEX_PLACES).cast("long").alias("lex")
    slim = df.select("qid", "doc_id", F.round(F.col("dense") * 10**PLACES).cast("int").alias("dense"), lex)
    return numbered(numbered(slim, F.col("dense"), "rd", ["lex"]), F.col("lex"), "rl", ["rd"]).withColumn("fused", fused_score(k))


def hybrid_order(df: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, doc_id and r, the place of each candidate in the fusion."""
    return numbered(places(df, k), F.col("fused"), "r", [])


def scaled(df: DataFrame) -> DataFrame:
    """Adds d01 and l01: dense and lex scaled to 0..1 among a query's candidates, 0 where all are equal.

    Ranges are summed up before they are shuffled, and joined back: no task holds a query's whole corpus.
    """
    ends = df.groupBy("qid").agg(*[f(c).alias(f"{c}_{name}") for c in ("dense", "lex") for name, f in (("low", F.min), ("high", F.max))])

    def one(c: str) -> Column:
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))

    return df.join(ends, "qid").select(*df.columns, one("dense").alias("d01"), one("lex").alias("l01"))


def weighted(df: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """Adds, for each alpha, alpha of the scaled dense and the rest of the scaled lexical score."""
    return scaled(df).select(*df.columns, *[F.round(a * F.col("d01") + (1 - a) * F.col("l01"), 6).alias(f"alpha_{a}") for a in alphas])


def rankers(df: DataFrame) -> dict[str, Column]:
    """Every ranker's score, over what reciprocal() and weighted() add."""
    def rrf(k: int) -> Column:
        return F.round(1 / (F.lit(k) + F.col("rd")).cast("double") + 1 / (F.lit(k) + F.col("rl")).cast("double"), 9)

    return {"dense": F.col("dense"), "bm25": F.col("lex"), "rrf_10": rrf(10), "rrf_60": rrf(60)} | {f"alpha_{a}": F.col(f"`alpha_{a}`") for a in ALPHAS}


def collapse(df: DataFrame, by: Column, k: int = TOP_K, overfetch: int = OVERFETCH) -> DataFrame:
    """Each query's first k parents, each with its best candidate, among the best overfetch * k candidates.

    The first window keeps few rows a query, and is cut off early by Spark; the others run over those.
    """
    first = F.row_number().over(Window.partitionBy("qid").orderBy(by.desc(), "doc_id"))
    few = df.withColumn("_r", first).where(F.col("_r") <= overfetch * k)
    first = few.withColumn("_k", F.row_number().over(Window.partitionBy("qid", "parent").orderBy("_r"))).where("_k = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_r"))).where(F.col("rank") <= k).drop("_r", "_k")


def gate_scores(df: DataFrame) -> DataFrame:
    """The best cosine of each query over all candidates: what the score gate looks at, whatever the fusion ranks first."""
    return df.groupBy("qid").agg(F.max("dense").alias("gate_score"))


def reach(fetch: int, k: int = RRF_K) -> int:
    """How deep either ranking must be read for the first `fetch` of their fusion.

    The first `fetch` of one ranking score over 1 / (k + fetch); what is beyond rank k + 2 * fetch in both scores at most
    2 / (2 * k + 2 * fetch + 1), which is less.
    """
    return k + 2 * fetch


#: Queries of one pass over the index; more queries mean more passes, not larger broadcasts.
QUERIES = 8192


def bounded(index: Index, queries: DataFrame, fetch: int, k: int = RRF_K) -> tuple[DataFrame, DataFrame]:
    """qid, num, doc_id, parent, dense, lex, rd, rl of all documents that may be among the first `fetch` of the fusion; and
    qid, gate_score, term_hits, query_terms.

    A task passes on what is among the first reach() of either of its rankings, a row for each stretch of queries, so what
    is written and ranked is bounded by queries and tasks, not by pairs. A candidate whose place in the other ranking lies
    beyond reach() gets it as a count of what comes before it, from a second pass over the same segments; no window ever
    holds a query's whole corpus. Documents without a common term share lexical score 0 and follow by id.
    """
    most, found, gates = reach(fetch, k), None, None

    def summed(packed: DataFrame, run: Callable, schema: str) -> DataFrame:
        return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)

    for asked, made in _scored(index, queries, blocks.LEADING, lambda asked: blocks.leading_of(asked, most)):
        chosen = kept(summed(made, blocks.ranked_of(asked, most), blocks.RANKED), "chosen")
        rows = chosen.where((F.col("rd") > most) | (F.col("rl") > most)).select("q", "num", "dense", "lex", "rd", "rl").toArrow()
        unknown = [_by_query(rows, rank, score, most) for rank, score in (("rd", "dense"), ("rl", "lex"))]
        out, ranks = chosen, [F.col(r).cast("long").alias(r) for r in ("rd", "rl")]
        if rows.num_rows:
            counts = summed(index.segments.mapInArrow(blocks.ahead_of(asked, *unknown), blocks.COUNTED), blocks.placed_of(asked, *unknown), blocks.PLACED)
            out = chosen.join(counts, ["q", "num"], "left")
            ranks = [F.when(F.col(r) > most, F.col("ahead") + 1).otherwise(F.col(r)).cast("long").alias(r) for r in ("rd", "rl")]
        full = _named(out.select("q", "num", "dense", "lex", *ranks), asked, queries).select("qid", "num", "dense", "lex", "rd", "rl")
        gate = _named(chosen.where("rd = 1").select("q", F.col("dense").alias("gate_score")), asked, queries)
        found, gates = (full, gate) if found is None else (found.unionByName(full), gates.unionByName(gate))
    if found is not None:
        names = index.segments.select("first", F.posexplode(F.arrays_zip("ids", "parents")).alias("at", "x"))
        names = names.select((F.col("first") + F.col("at")).alias("num"), F.col("x.ids").alias("doc_id"), F.col("x.parents").alias("parent"))
        found = found.join(names, "num").select("qid", "num", "doc_id", "parent", "dense", "lex", "rd", "rl")
    if found is None:
        found = _none(index, queries)
        gates = found.select("qid", F.col("dense").alias("gate_score"), *[F.lit(0).cast("long").alias(x) for x in ("term_hits", "query_terms")])
    return found, gates.select("qid", "gate_score", "term_hits", "query_terms")


def _by_query(rows: pa.Table, rank: str, score: str, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By query, scores and numbers of the candidates whose rank is beyond `most`: some hundred a query."""
    far = rows.filter(pc.greater(rows.column(rank), most))
    q, scores, nums = (far.column(x).to_numpy() for x in ("q", score, "num"))
    by = np.argsort(q, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(q[by]) != 0]) if len(by) else np.empty(0, int)
    return {int(q[x[0]]): (scores[x], nums[x]) for x in np.split(by, heads[1:]) if len(x)}


def retrieve(docs: DataFrame | Index, queries: DataFrame, mode: str = "hybrid", k: int = TOP_K) -> tuple[DataFrame, DataFrame]:
    """hits (qid, rank, doc_id, parent, score, lex) and results (qid, gate_score, term_hits, query_terms).

    docs: an index, or documents to make one of. mode: dense, bm25 or hybrid. score stays the cosine: fusion orders
    hits, and never rescores them.
    """
    index = docs if isinstance(docs, Index) else build_index(docs)
    both, results = bounded(index, queries, OVERFETCH * k)
    fused = F.round(1 / (F.lit(RRF_K) + F.col("rd")).cast("double") + 1 / (F.lit(RRF_K) + F.col("rl")).cast("double"), 9)
    by = {"dense": F.col("dense"), "bm25": F.col("lex"), "hybrid": fused}[mode]
    hits = collapse(both, by, k)
    return hits.select("qid", "rank", "doc_id", "parent", F.col("dense").alias("score"), "lex"), results


def family(index: Index, queries: DataFrame, fetch: int = OVERFETCH * TOP_K, alphas: list[float] = ALPHAS) -> DataFrame:
    """ranker, qid, doc_id, parent and f of all documents that may be among a query's first `fetch` of any of rankers().

    Ranks and their fusions come from bounded(). What scales scores are the ends of all of a query's documents, found by
    one pass over the segments; in a second one each task keeps the best `fetch` by each weight. No pair is written.
    """
    found = kept(bounded(index, queries, fetch)[0], "found")
    out = None
    for name, by in rankers(found).items():
        if not name.startswith("alpha_"):
            one = found.select(F.lit(name).alias("ranker"), "qid", "doc_id", "parent", by.alias("f"))
            out = one if out is None else out.unionByName(one)
    kinds = {x.name: x.dataType for x in _found(index)}
    schema = T.StructType([T.StructField("alpha", T.DoubleType()), T.StructField("q", T.IntegerType()), *[T.StructField(x, kinds[x]) for x in ("doc_id", "parent")], T.StructField("f", T.DoubleType())])
    for asked in asked_blocks(index, queries):
        each = index.segments.mapInArrow(blocks.ends_of(asked), "q int, d0 double, d1 double, l0 double, l1 double")
        ends = each.groupBy("q").agg(F.min("d0"), F.max("d1"), F.min("l0"), F.max("l1")).collect()
        made = index.segments.mapInArrow(blocks.weighted_best(asked, {r[0]: tuple(r[1:]) for r in ends}, alphas, fetch), schema)
        out = out.unionByName(_named(made, asked, queries).select(F.concat(F.lit("alpha_"), F.col("alpha").cast("string")).alias("ranker"), "qid", "doc_id", "parent", "f"))
    return kept(out, "family")
