"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], warm, all rows read."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = [
    "str02_tokenize", "agg03_chunk_stats", "win03_dedupe", "flt14_invariants", "agg05_document_frequency", "j04_bm25_scores",
    "top04_bm25_top5", "top01_exact_top5", "win02_parent_collapse", "top05_hybrid_hits", "flt08_groundedness", "udf09_decision",
    "agg10_quality", "agg17_best_cutoff", "agg21_bootstrap", "htm01_strip_tags",
]


def on_index(spark, folder: str) -> dict[str, float]:
    """Seconds to index the documents, and to answer all items by that index: what a service does once, and then each time."""
    from quillspark.operators import answer, retrieve
    from quillspark.plans.q_retrieval import docs_of, items_of

    took: dict[str, float] = {}
    docs, items = docs_of(spark, folder), items_of(spark, folder)

    def timed(name, run):
        begin = time.perf_counter()
        out = run()
        took[name] = round(time.perf_counter() - begin, 3)
        return out

    index = timed("build", lambda: retrieve.build_index(docs))
    timed("hybrid_hits", lambda: retrieve.retrieve(index, items)[0].write.format("noop").mode("overwrite").save())
    timed("answers", lambda: answer.ask(docs, items, index=index).write.format("noop").mode("overwrite").save())
    return took


def main() -> None:
    from quillspark.plans import registry
    from quillspark.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(f"local[{cpus}]", int(cpus), "16g")
    took: dict[str, float] = {}
    for name in [HEADLINE[0], *HEADLINE]:  # the first run only warms up
        begin = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    indexed = on_index(spark, folder)
    items, docs = (spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("benchmark", "documents"))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    rates = {
        "bm25_pairs_per_s": round(items * docs / took["j04_bm25_scores"]),
        "vector_comparisons_per_s": round(-(-vectors // 20) * vectors / took["top01_exact_top5"]),
        "hybrid_queries_per_s": round(items / took["top05_hybrid_hits"], 2),
        "hybrid_queries_per_s_on_index": round(items / indexed["hybrid_hits"], 2),
    }
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder), "rates": rates, "on_index": indexed}))


if __name__ == "__main__":
    main()
