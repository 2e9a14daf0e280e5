"""Importance resampling towards a target: documents whose hashed n-grams are likelier in the target than in the corpus.

Each task counts its documents' n-grams by hash bucket in an embedded DuckDB, batch by batch; the counts by document are
spilled to Parquet in the shared folder. Spark merges them into counts of the corpus, and of the target, makes a gain a
bucket, scores each document by its own counts, adds Gumbel noise drawn by its id, and takes the highest scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches
from .textbatch import lean, text_bytes

# Words, and the parameters that the query uses.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N, BUCKETS, SEED, PERCENT, MIN_WORDS = 1, 10_000, 2024, 10, 20
# End of fixed values.

#: What DuckDB may hold in a task; a batch has 4 MB of text, or one longer text, which takes some 30 times its bytes.
MEMORY = "1GB"
#: Rows of one range when documents are put in order.
RANGE_ROWS = 250_000


def crc(features: pa.Array) -> pa.Array:
    """zlib's CRC-32 of each feature's UTF-8 bytes: the function that DuckDB calls, on distinct features only."""
    column = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
    raw, at = text_bytes(column)
    whole, ends = memoryview(np.ascontiguousarray(raw)), at.tolist()
    return pa.array([zlib.crc32(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def connect():
    """A DuckDB of one thread, in memory only, that knows crc()."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": "", "preserve_insertion_order": False})
    con.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def count_sql(n: int, buckets: int) -> str:
    """row, bucket, n of the runs of 1 to n words of table words (row, words); longer runs look ahead in a window."""
    runs = ["w", *[" || ' ' || ".join(["w", *[f"lead(w, {j}) OVER p" for j in range(1, k)]]) for k in range(2, n + 1)]]
    window = " WINDOW p AS (PARTITION BY row ORDER BY i)" if n > 1 else ""
    return f"""
WITH u AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM words),
f AS (SELECT row, {"w" if n == 1 else f"unnest([{', '.join(runs)}])"} AS f FROM u{window}),
c AS (SELECT row, f, count(*) AS n FROM f WHERE f IS NOT NULL GROUP BY row, f),
k AS (SELECT f, crc(f) % {buckets} AS bucket FROM (SELECT DISTINCT f FROM c))
SELECT row, CAST(bucket AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM c JOIN k USING (f) GROUP BY row, bucket ORDER BY row, bucket"""


def bucket_counts(docs: DataFrame, text_col: str, carry: list[str], n: int, buckets: int, name: str) -> DataFrame:
    """The carried columns as c_..., n_words, n_features and counts, a map of buckets, of each document; spilled to Parquet."""
    small_batches(docs.sparkSession)
    asked = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    fields = [f for f in asked.schema.fields if f.name != "_text"]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("counts", T.MapType(T.IntegerType(), T.LongType()))])
    split = f"CREATE OR REPLACE TEMP TABLE words AS SELECT row, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM batch"
    count = count_sql(n, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = connect()
        for batch in batches:
            rows = batch.num_rows
            con.register("batch", pa.table({"row": pa.array(np.arange(rows)), "text": batch.column("_text")}))
            con.sql(split)
            sizes = con.sql("SELECT len(words) AS n FROM words ORDER BY row").to_arrow_table().column("n").to_numpy()
            found = con.sql(count).to_arrow_table().combine_chunks()
            con.unregister("batch")
            row, counts = found.column("row").to_numpy(), found.column("n").to_numpy()
            at = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows))))
            sums = np.concatenate(([0], np.cumsum(counts)))
            maps = pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(found.column("bucket").to_numpy(), pa.int32()), pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(sizes, pa.int64()), pa.array(sums[at[1:]] - sums[at[:-1]]), maps], schema.names)
        con.close()

    return keep(asked.mapInArrow(lean(run), schema), name)


def merged(counts: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket, over all documents; there are as many sums as buckets, whatever the corpus."""
    out = np.zeros(buckets, np.int64)
    for r in counts.select(F.explode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the logarithm of how much likelier a feature of it is in the target; one count is added to each."""
    more, most = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * more / ((s + 1) * most))) for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], np.int64)


def noise(id_col: str, seed: int) -> Column:
    """A thousand times a Gumbel variable, drawn by the id: the highest sums are a sample without replacement."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """counts with weight, the sum of gains over each document's features, in place of the map."""
    fields = [f for f in counts.schema.fields if f.name != "counts"]
    schema = T.StructType([*fields, T.StructField("weight", T.LongType())])
    shared = counts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column("counts")
            at = maps.offsets.to_numpy()
            keys, values = (x.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False) for x in (maps.keys, maps.items))
            sums = np.concatenate(([0], np.cumsum(shared.value[keys] * values)))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]])], schema.names)

    return counts.mapInArrow(lean(run), schema)


def placed(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Adds rank, 1 for the first in order. Rows are dealt out by ranges of the order; only rows of one range are sorted
    together, and ranges are counted, not gathered."""
    parts = max(8, -(-rows // RANGE_ROWS))
    dealt = keep(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["_range"], before))
        before += r.n
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_in", inside).join(F.broadcast(starts), "_range").withColumn("rank", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", carry: list[str] | None = None, n: int = N, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The carried columns (all, if not given) and n_words, n_features, weight, score and rank of each document; documents
    that are not drawn have no rank.

    Of the documents with at least min_words words, percent in a hundred are drawn. A null or empty text has no features,
    weighs 0 and may be drawn only if min_words is 0. Ties go to the smaller id, null first; rows of one id and text are
    documents of their own, with one score and ranks next to each other. A null id draws its noise as the text 'null'.
    An empty table gives no rows; an empty target counts nothing in any bucket. Texts are counted whole: one of L bytes
    takes some 30 L in its task, and MEMORY at most. Carried columns that are named like results give way to them.
    """
    if n < 1 or buckets < 1:
        raise ValueError("n and buckets must be positive")
    made = ("n_words", "n_features", "weight", "score", "rank")
    columns = docs.columns if carry is None else carry
    counts = bucket_counts(docs, text_col, list(dict.fromkeys([*columns, id_col])), n, buckets, "bucket-counts")
    gain = gains(merged(bucket_counts(target, target_text_col, [], n, buckets, "target-counts"), buckets), merged(counts, buckets))
    scored = weighed(counts, gain).withColumn("score", F.col("weight") + noise(f"c_{id_col}", seed))
    scored = keep(scored, "scores")
    able = scored.where(F.col("n_words") >= min_words)
    rows = able.count()
    ranks = placed(able, [F.col("score").desc(), F.col(f"c_{id_col}").asc_nulls_first()], rows)
    drawn = ranks.withColumn("rank", F.when(F.col("rank") <= percent * rows // 100, F.col("rank").cast("long")))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*[F.col(f"c_{c}").alias(c) for c in columns if c not in made], *made)
