"""What the fourth round's findings are about."""

from __future__ import annotations

from itertools import product
from math import isqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import blocks, dense, lexical, retrieve
from quillspark.plans import registry


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _corpus(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 23}" for j in range(k % 9))) for k in range(400)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(k, f"w{k} w{k * k % 23} w{k} other w1") for k in range(30)] + [(30, ""), (31, "nowhere")], "item_id long, text string")
    return docs, items


def test_pairs_of_bm25_are_not_shuffled(spark, data):
    assert "Exchange" not in _plan(registry.QUERIES["agg07_bm25"](spark, data))


def test_bm25_is_the_same_by_blocks_and_by_batches(spark, monkeypatch):
    docs, items = _corpus(spark)

    def rows():
        return sorted(map(tuple, lexical.bm25(lexical.counted(docs, items)).collect()))

    whole = rows()
    matched = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w")).where("w <> ''").join(items.select("item_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w")), "w").groupBy("item_id", "doc_id").count()
    assert {(q, d): n for q, d, _, n in whole} == {(r.item_id, r.doc_id): r["count"] for r in matched.collect()}
    monkeypatch.setattr(lexical, "QUERIES", 7)
    monkeypatch.setattr(lexical, "CELLS", 512)
    monkeypatch.setattr(lexical, "ROWS", 128)
    assert rows() == whole


def test_bm25_without_queries_or_documents_has_no_rows(spark):
    docs, items = _corpus(spark)
    for some in ((docs, items.limit(0)), (docs.limit(0), items), (docs, items.where("text = ''"))):
        assert lexical.bm25(lexical.counted(*some)).count() == lexical.bm25(lexical.counted(*some), 5).count() == 0


@pytest.mark.parametrize("name", ["j06_hits_gold", "agg25_covers_all_gold"])
def test_only_the_first_hits_of_a_task_are_ranked(spark, data, name, monkeypatch):
    """What is ranked are some rows a query and task, whatever the number of documents."""
    seen, top_k = [], dense.top_k
    monkeypatch.setattr(dense, "top_k", lambda df, *rest: seen.append(df.groupBy("qid", F.spark_partition_id()).count().agg(F.max("count")).first()[0]) or top_k(df, *rest))
    registry.QUERIES[name](spark, data)
    assert seen and max(seen) <= 5


def _text(counts: list[int]) -> str:
    """A text whose default embedding has these counts in its first dimensions."""
    words = [f"x{k}" for k in range(4000)]
    at, sign = blocks.hashed_dimensions(words, retrieve.DIM)
    return " ".join(" ".join([next(w for w, a, s in zip(words, at, sign, strict=True) if a == d and s > 0)] * n) for d, n in enumerate(counts))


def test_cosines_halfway_between_two_places_are_rounded_up(spark):
    """(x + y) / 1024 has ten places and ends in 5; the sum of products of rounded unit vectors falls on either side of it."""
    some = product(range(1, 200, 10), range(2, 200, 12), range(301, 700, 14), range(101, 400, 18))
    left = {v: 2 * 512**2 - sum(x * x for x in v) for v in some}
    vectors = [(*v, isqrt(r)) for v, r in left.items() if r > 0 and isqrt(r) ** 2 == r][:40]
    assert len(vectors) == 40
    docs = spark.createDataFrame([(k, _text(v), "") for k, v in enumerate(vectors)], "doc_id long, text string, parent string")
    items = spark.createDataFrame([(0, _text([1, 1]))], "item_id long, text string")
    found = {r.doc_id: r.dense for r in retrieve.candidates(docs, items).collect()}
    assert found == {k: ((v[0] + v[1]) * 10**9 // 1024 + 1) / 10**9 for k, v in enumerate(vectors)}


def test_leaders_that_tie_are_the_first_by_number():
    rng = np.random.default_rng(3)
    best, kept = blocks.Leaders(5, 10), []
    for first in range(0, 3000, 100):
        scores = rng.integers(-3, 4, (5, 100)) * 1.0 if first % 300 else np.zeros((5, 100))
        best.add(scores, scores, first)
        kept.append(scores)
    q, score, num, _ = best.settle()
    whole = np.concatenate(kept, 1)
    for j in range(5):
        by = np.lexsort((np.arange(whole.shape[1]), -whole[j]))[:10]
        assert np.array_equal(num[q == j], by) and np.array_equal(score[q == j], whole[j][by])


def test_samples_count_the_documents_once(spark, data, monkeypatch):
    """Turns repeat the questions, not the index."""
    made, counted, postings = [], lexical.counted, lexical.postings
    monkeypatch.setattr(lexical, "counted", lambda *x: made.append(1) or counted(*x))
    monkeypatch.setattr(lexical, "postings", lambda *x: made.append(1) or postings(*x))
    assert {(r.stage, r.n) for r in registry.QUERIES["har01_latency_samples"](spark, data).collect()} == {("lexical", 3), ("dense", 3), ("total", 3)}
    assert made == [1]


def test_nearest_takes_up_rows_of_many_batches(spark):
    """Equal and nearly equal scores: only what may be among the best is rounded, and nothing is lost by that."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(k, (base[k % 40] * (1 + k % 3) + (k % 7 == 0) * 1e-10).tolist()) for k in range(6000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    got = {(r.qid, r["rank"]): r.vec_id for r in dense.exact_top_k(vectors, asked, 5).collect()}
    m = np.array([x for _, x in rows])
    s = dense.cosines(m[::20], m)
    best = np.lexsort((np.broadcast_to(np.arange(6000), s.shape), -s), axis=1)[:, :5]
    assert got == {(20 * j, n + 1): int(v) for j, row in enumerate(best) for n, v in enumerate(row)}
