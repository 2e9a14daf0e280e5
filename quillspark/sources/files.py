"""File sources and sinks: JSON arrays, chunks by strategy, manifests, and the shared folder that scratch files use."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, deleted at the end.

    Where none is set, a local master gets a folder of its machine; on a cluster its executors would not see that.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def kept(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, written to the shared folder: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, array: bool = True) -> DataFrame:
    """A JSON file of records; one that is an array spans lines."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def write_json_arrays(df: DataFrame, path: str, each: int = 1000) -> None:
    """Files that hold one JSON array of about `each` records, as a reader of whole documents expects them.

    Rows are dealt out by their hash, so no file holds more than its share, however many rows there are.
    """
    files = max(1, -(-df.count() // each))
    dealt = df.withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.lit(files)))
    arrays = dealt.groupBy("_file").agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)


def json_round_trip(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "docs-json")
    write_json_arrays(df, path)
    return read_json(df.sparkSession, path, df.schema)


def write_chunks(chunks: DataFrame, path: str, *by: str) -> None:
    """One folder for each value of the columns by; a reader that filters on them opens no others."""
    chunks.write.mode("overwrite").partitionBy(*by).parquet(path)


def partitioned(df: DataFrame, *by: str) -> DataFrame:
    path = scratch(df.sparkSession, "chunks")
    write_chunks(df, path, *by)
    return df.sparkSession.read.parquet(path)


def stored(chunks: DataFrame, contexts: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Chunks by folders as write_chunks() makes them, and contexts (doc_id, context_text), each written once; both read again.

    Chunks are written without context_text, which is a document's for all its chunks, or is what is embedded.
    """
    path = scratch(chunks.sparkSession, "store")
    write_chunks(chunks.drop("context_text"), f"{path}/chunks", *by)
    contexts.write.mode("overwrite").parquet(f"{path}/contexts")
    return tuple(chunks.sparkSession.read.parquet(f"{path}/{name}") for name in ("chunks", "contexts"))


def manifest(docs: DataFrame, dropped: DataFrame, source: str) -> dict:
    """What a corpus holds, by kind, and what was dropped from it; raises for an empty one."""
    kinds = {r.kind: r.n for r in docs.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if not kinds:
        raise ValueError("refusing to write an empty corpus")
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    return {"source": source, "n_docs": sum(kinds.values()), "n_chars": chars, "by_kind": kinds, "n_dropped": dropped.count()}


def write_corpus(docs: DataFrame, dropped: DataFrame, path: str, source: str) -> dict:
    """Writes docs, what was dropped, and the manifest."""
    made = manifest(docs, dropped, source)
    docs.write.mode("overwrite").json(f"{path}/docs")
    dropped.write.mode("overwrite").json(f"{path}/dropped")
    docs.sparkSession.range(1).select(F.lit(json.dumps(made)).alias("value")).write.mode("overwrite").text(f"{path}/manifest")
    return made


def read_index(spark: SparkSession, path: str, model: str, kind: str, strategy: str) -> DataFrame:
    """The vectors of one model, kind and strategy; no other folders are opened. Raises where there are none."""
    found = spark.read.parquet(path).where((F.col("model") == model.replace("/", "__")) & (F.col("index_kind") == kind) & (F.col("strategy") == strategy))
    if not found.take(1):
        raise ValueError(f"no index of {model}, {kind}, {strategy}")
    return found.drop("model", "index_kind")


def write_index(index: DataFrame, path: str, model: str, kind: str) -> None:
    """Vectors and their chunks (with their strategy) under model, kind and strategy."""
    named = index.withColumns({"model": F.lit(model.replace("/", "__")), "index_kind": F.lit(kind)})
    write_chunks(named, path, "model", "index_kind", "strategy")


def numbered_rows(df: DataFrame, out: str, *order: Column | str) -> DataFrame:
    """Adds each row's number from 0 on, in order, for any number of rows: the place in a range, after all rows before it.

    Only ranges are sorted by a task each; what is summed up in one place is a row for each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_in")).alias(out))


def encoded(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks under short keys, each with the code of its parent's text in place of the text, and the texts by code.

    Codes follow the order in which documents are first used, chunk by chunk in order of (doc_id, part). chunks: as a
    strategy makes them; a document's chunks share one context.
    """
    # A document's first chunk stands for it; only ids are numbered, and no text is shuffled with each chunk.
    first = chunks.where("part = 0").select(F.col("doc_id").alias("d"), F.col("context_text").alias("x"))
    codes = kept(numbered_rows(chunks.where("part = 0").select(F.col("doc_id").alias("d")).distinct(), "p", "d"), "codes")
    parents = first.join(codes, "d").groupBy("p", "d").agg(F.first("x").alias("x"))
    short = chunks.select(F.col("chunk_id").alias("c"), F.col("doc_id").alias("d"), F.col("title").alias("t"), F.col("kind").alias("k"), F.col("embed_text").alias("e"))
    return short.join(codes, "d").select("c", "d", "p", "t", "k", "e"), parents


def write_export(chunks: DataFrame, path: str, note: str = "") -> None:
    """The export of encoded(): chunks and parents as JSON lines, compressed, and a header with their numbers."""
    short, parents = encoded(chunks)
    short.write.mode("overwrite").option("compression", "gzip").json(f"{path}/chunks")
    parents.write.mode("overwrite").option("compression", "gzip").json(f"{path}/parents")
    # What is written is counted by its lines: nothing is made again.
    n = [chunks.sparkSession.read.text(f"{path}/{x}").agg(F.count("*").alias(name)) for x, name in (("chunks", "n_chunks"), ("parents", "n_docs"))]
    n[0].crossJoin(n[1]).withColumn("note", F.lit(note)).coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_export(spark: SparkSession, path: str, doc_id: str = "long") -> tuple[DataFrame, DataFrame]:
    """The chunks of an export with their contexts again, and its header."""
    parents = spark.read.schema(f"p long, d {doc_id}, x string").json(f"{path}/parents")
    short = spark.read.schema(f"c string, d {doc_id}, p long, t string, k string, e string").json(f"{path}/chunks")
    header = spark.read.schema("n_chunks long, n_docs long, note string").json(f"{path}/header")
    whole = short.join(parents.select("p", F.col("x").alias("context_text")), "p")
    return whole.select(F.col("c").alias("chunk_id"), F.col("d").alias("doc_id"), F.col("p").alias("parent_code"), F.col("t").alias("title"), F.col("k").alias("kind"), F.col("e").alias("embed_text"), "context_text"), header
