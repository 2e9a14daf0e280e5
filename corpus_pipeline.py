"""The corpus pipeline: quality rules, near copies, contamination, mixing and sharding, each over what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns a row for each document
as read back from its shard. Any column may be null, and a table without rows gives none. Rows that repeat are each
judged, for quality and contamination; of near copies, rows that repeat an id and a text count as one and one of them
stays; in the mix and in shards each row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import keep, scratch, shuffled_key
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.jaccard import first_of_each
from quillspark.llm.mixing import mix, repeat_rows
from quillspark.llm.quality import judge
from quillspark.llm.sharding import shard


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    return judge(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the least id; one row of it, however many repeat its id and text."""
    return first_of_each(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target takes it."""
    return repeat_rows(mix(docs), docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen arrivals, by hash of the id, compacted; each document as it is read back from its shard."""
    arrival = F.substring(shuffled_key("arrival", F.col("doc_id")), 1, 1)
    held = shard(docs, scratch(spark, "shards"), arrival)
    return held.select("doc_id", "source", "shard", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("benchmark decontamination", contamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Expectation-maximisation has no plain SQL form; tests/llm/test_pipeline_brute_force.py holds run() against plain Python
#: for the first three stages and against the SQL of the mix for the fourth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before kept, written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = keep(docs, f"stage-{n + 1}")
    return docs
