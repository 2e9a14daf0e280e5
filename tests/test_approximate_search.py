"""Cells and signatures: recall against exact search, what is read, and independence of batches and layout."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import cells, dense
from quillspark.plans import registry
from quillspark.plans.q_retrieval import _document_vectors
from tests.oracle import same

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('vectors')}/v"
    _document_vectors(spark, DATA).write.parquet(path)
    return spark.read.parquet(path)


def asked_of(vectors):
    return vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "embedding")


def pairs(df):
    return {(r.qid, r.doc_id) for r in df.collect() if r.qid != r.doc_id}


def test_cells_find_nearly_all_in_a_third_of_the_vectors(spark, vectors):
    index = cells.build(vectors, vid="doc_id")
    assert index.table.count() == vectors.count()
    asked = asked_of(vectors)
    sizes = {r.cell: r["count"] for r in index.table.groupBy("cell").count().collect()}
    opened = cells.probed(index, np.array([r.embedding for r in asked.collect()]))
    read = np.mean([sum(sizes.get(c, 0) for c in row) for row in opened.tolist()]) / vectors.count()
    best = pairs(dense.exact_top_k(vectors, asked, 5, vid="doc_id"))
    assert read <= 1 / 3 and len(pairs(cells.nearest(index, asked)) & best) >= 0.9 * len(best)


def test_all_cells_are_exact(spark, vectors):
    asked = asked_of(vectors)
    got = cells.nearest(cells.build(vectors, vid="doc_id", cells=9), asked, probes=1.0)
    want = dense.exact_top_k(vectors, asked, 5, vid="doc_id")
    assert sorted(map(str, got.select("qid", "doc_id", "score", "rank").collect())) == sorted(map(str, want.select("qid", "doc_id", "score", "rank").collect()))


def test_cells_that_no_query_opens_are_not_read(spark, vectors):
    index = cells.build(vectors, vid="doc_id", cells=40)
    plan = cells.nearest(index, asked_of(vectors).limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_layout_and_batches_change_nothing(spark, vectors, tmp_path):
    asked = asked_of(vectors)
    found = []
    try:
        for rows, parts in ((10_000, 1), (7, 13)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
            dealt = vectors.repartition(parts)
            signed = dense.sign(dealt)
            found.append((sorted(map(str, cells.nearest(cells.build(dealt, vid="doc_id"), asked).collect())), sorted(map(str, dense.approximate_top_k(signed, asked, vid="doc_id").collect()))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1]


def test_an_index_of_cells_is_loaded(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/cells"
    made = cells.build(vectors, path, vid="doc_id")
    loaded = cells.load(spark, path, vid="doc_id")
    assert pairs(cells.nearest(loaded, asked_of(vectors))) == pairs(cells.nearest(made, asked_of(vectors)))


def test_odd_vectors(spark):
    schema = "vec_id string, embedding array<double>"
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "qid long, embedding array<double>")
    assert cells.nearest(cells.build(spark.createDataFrame([], schema)), asked).count() == 0
    assert dense.approximate_top_k(dense.sign(spark.createDataFrame([], schema)), asked).count() == 0
    some = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 0.0]), ("e", [0.0, 1.0])], schema)
    got = cells.nearest(cells.build(some), asked, k=2)
    assert sorted((r.qid, r.vec_id, r["rank"]) for r in got.collect()) == [(1, "a", 1), (1, "d", 2), (2, "a", 1), (2, "c", 2)]
    assert cells.nearest(cells.build(some), asked.limit(0)).count() == 0


def test_a_task_passes_on_k_rows_a_query(spark, vectors):
    """However many batches it reads, and however many copies tie at the edge."""
    asked = asked_of(vectors)
    copies = vectors.unionByName(vectors.withColumn("doc_id", F.col("doc_id") + 1_000_000)).coalesce(1)
    n = asked.count()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert dense.score(copies, asked, 5, vid="doc_id").count() == 5 * n
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_scores_are_made_in_bounded_stretches():
    for rows, queries in ((10_000, 65_536), (1, 1), (3000, 7), (0, 5)):
        seen = list(dense.tiles(rows, queries))
        sizes = [(a.stop - a.start) * (q.stop - q.start) for a, q in seen]
        assert sum(sizes) == rows * queries and max(sizes, default=0) <= dense.CELLS


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A table of 8000 vectors in one batch, 400 of which ask."""
    folder, rng = str(tmp_path_factory.mktemp("many")), np.random.default_rng(5)
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(rng.normal(size=(8000, 8)).astype(np.float32))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).toPandas().to_parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["top03_overfetch", "win02_parent_collapse", "top01_exact_top5", "mth08_signals", "j01_payload", "agg19_signal_aucs"])
def test_a_task_holds_few_scores(spark, many, monkeypatch, name):
    """The scores that are made at once are bounded, whatever a batch and a block of queries would give."""

    def few(s, plain=dense.rounded):
        assert s.size <= 1 << 18
        return plain(s)

    monkeypatch.setattr(dense, "rounded", few)
    same(spark, many, registry.QUERIES[name], registry.ORACLES[name])


def test_askers_of_cells():
    opened = np.array([[3, 1], [1, 2], [3, 2]])
    assert {c: x.tolist() for c, x in cells.askers_of(opened).items()} == {1: [0, 1], 2: [1, 2], 3: [0, 2]}
