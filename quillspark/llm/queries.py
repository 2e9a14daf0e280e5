"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, shuffled_key
from .decontaminate import decontaminate
from .jaccard import link
from .linededup import dedup_lines
from .mixing import mix
from .quality import judge
from .resampling import resample
from .secrets import digest, scan
from .sharding import shard
from .similarity import fingerprints
from .substring import dedup_substrings
from .suffixes import dedup_suffixes
from .toxicity import score
from .variants import spelling_variants
from .oracles import ORACLES  # noqa: F401


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_read(spark, sf_dir, "documents"), carry=["doc_id"]).withColumn("base", F.filter("secrets", lambda x: x["kind_no"] < 3))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(_read(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "n_shingles", "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals, by hash of the id, compacted; each document as it is read back from its shard."""
    arrival = F.substring(shuffled_key("arrival", F.col("doc_id")), 1, 1)
    held = shard(_read(spark, sf_dir, "documents"), scratch(spark, "shards"), arrival)
    return held.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_suffixes(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), carry=["doc_id"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secrets": op2_secrets,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fingerprints": op13_fingerprints,
}
