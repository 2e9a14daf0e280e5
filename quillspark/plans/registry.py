"""Every query by name, and its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import q_corpus, q_eval, q_retrieval, q_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (q_text, q_corpus, q_retrieval, q_eval):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

FLAGSHIP = "top04_bm25_top5"
