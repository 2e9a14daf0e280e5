"""Ranks over ranges, resampling by counts, and generation that is held to its schema."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import answer, evaluate, retrieve


def test_ranks_over_ranges_equal_a_sort(spark):
    """One query holds most rows, most scores are equal."""
    rng = random.Random(1)
    rows = [(1 if k % 10 else 2, k, rng.choice([0.0, 0.0, 0.0, rng.random()])) for k in range(5000)]
    df = spark.createDataFrame(rows, "qid long, doc_id long, s double").repartition(7)
    got = {(r.qid, r.doc_id): r.r for r in retrieve.ranked(df, F.col("s"), "r").collect()}
    for q in (1, 2):
        order = sorted((-s, d) for k, d, s in rows if k == q)
        assert all(got[q, d] == n + 1 for n, (_, d) in enumerate(order))
    plan = retrieve.ranked(df, F.col("s"), "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "[qid#" in plan and ", _range#" in plan.split("row_number()")[1].split("\n")[0]


def test_a_fusion_of_all_pairs_writes_each_ranking_once_without_its_scores(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(1 if k % 10 else 2, k, "parent", rng.choice([0.0, round(rng.uniform(-1, 1), 9)]), rng.choice([0.0, 0.0, round(rng.uniform(0, 9), 4)])) for k in range(3000)]
    written, write = [], retrieve.kept
    monkeypatch.setattr(retrieve, "kept", lambda df, *a, **b: written.append(set(df.columns)) or write(df, *a, **b))
    df = spark.createDataFrame(rows, "qid long, doc_id long, parent string, dense double, lex double").repartition(5)
    out = retrieve.hybrid_order(df)
    got = {(r.qid, r.doc_id): r.r for r in out.collect()}
    assert written == [{"qid", "doc_id", "lex", "_place"}, {"qid", "doc_id", "rd", "_place"}, {"qid", "doc_id", "_place"}]
    for q in (1, 2):
        mine = [x for x in rows if x[0] == q]
        rd, rl = ({x[1]: n + 1 for n, x in enumerate(sorted(mine, key=lambda x: (-x[c], x[1])))} for c in (3, 4))
        fused = {k: round(1 / (60 + rd[k]) + 1 / (60 + rl[k]), 9) for k in rd}
        assert [got[q, k] for k in sorted(fused, key=lambda k: (-fused[k], k))] == list(range(1, len(mine) + 1))


def outcomes(spark, groups):
    return spark.createDataFrame([(g, k, int(k < hits)) for g, n, hits in groups for k in range(n)], "g string, i long, ok int")


def test_chances_are_binomial(spark):
    rows = evaluate.hit_table(outcomes(spark, [("a", 30, 7), ("b", 4, 4), ("c", 3, 0)]), "ok", "g").collect()
    for g, n, p in (("a", 30, 7 / 30),):
        total = 0.0
        for r in sorted(x for x in rows if x.g == g):
            total += math.comb(n, r.k) * p**r.k * (1 - p) ** (n - r.k)
            assert r.cdf == pytest.approx(total, abs=1e-9)
    assert [(r.k, r.cdf) for r in rows if r.g in "bc"] == [(4, 1.0), (0, 1.0)] or {(r.g, r.k, r.cdf) for r in rows if r.g in "bc"} == {("b", 4, 1.0), ("c", 0, 1.0)}


def test_resamples_by_counts_are_those_of_draws(spark):
    """Mean and spread of the resampled means are those of draws with replacement; ends agree with the draws' own."""
    groups = [("a", 200, 150), ("b", 50, 0), ("c", 50, 50), ("d", 37, 5)]
    found = evaluate.resampled_by_counts(outcomes(spark, groups), "ok", "g", 2000)
    stats = {r.g: r for r in found.groupBy("g").agg(F.count("*").alias("n"), F.avg("m").alias("m"), F.stddev_pop("m").alias("s")).collect()}
    for g, n, hits in groups:
        p = hits / n
        sd = math.sqrt(p * (1 - p) / n)
        assert stats[g].n == 2000 and abs(stats[g].m - p) <= 4 * sd / math.sqrt(2000) + 1e-9 and stats[g].s == pytest.approx(sd, rel=0.1, abs=1e-9)
    ends = {r.g: (r.mean, r.low, r.high) for r in evaluate.bootstrap_by_counts(outcomes(spark, groups), "ok", "g").collect()}
    assert ends["b"] == (0.0, 0.0, 0.0) and ends["c"] == (1.0, 1.0, 1.0)
    drawn = evaluate.bootstrap(outcomes(spark, groups[:1]), "ok", "g", "i").first()
    assert abs(ends["a"][1] - drawn.low) <= 0.016 and abs(ends["a"][2] - drawn.high) <= 0.016


def test_the_table_of_chances_grows_with_the_root(spark):
    sizes = spark.createDataFrame([("x", 0)], "g string, ok int").crossJoin(spark.range(200_000)).withColumn("ok", (F.col("id") % 2).cast("int"))
    assert evaluate.hit_table(sizes, "ok", "g").count() <= 24 * math.sqrt(200_000 / 4) + 30
    assert evaluate.resampled_by_counts(outcomes(spark, []), "ok", "g").count() == 0


VALID = {"answerable": True, "answer": " yes ", "cited_doc_ids": ["a", "b"], "confidence": 0.5}


@pytest.mark.parametrize(("raw", "ok"), [
    (json.dumps(VALID), True),
    ('{"answerable": false}', True),
    ('{"answerable": true, "answer": "x", "confidence": 1, "cited_doc_ids": []}', True),
    ('  {"answerable": true, "more": 3}\n', True),
    ("The answer is 5.", False),
    ('Sure! {"answerable": true}', False),
    ('{"answerable": true} I hope this helps', False),
    ('{"answerable": true}{"answerable": true}', False),
    ('{"answerable": true}, {"answerable": true}', False),
    ('{"answerable": true}] more', False),
    ('{"answerable": "true"}', False),
    ('{"answerable": 1}', False),
    ('{"answer": "x"}', False),
    ('{"answerable": true, "answer": 5}', False),
    ('{"answerable": true, "cited_doc_ids": "a"}', False),
    ('{"answerable": true, "cited_doc_ids": [1, 2]}', False),
    ('{"answerable": true, "confidence": "high"}', False),
    ('{"answerable": true, "confidence": 1.5}', False),
    ("[true]", False), ("null", False), ("", False), (None, False), ('{"answerable": true', False),
])
def test_output_is_held_to_its_schema(spark, raw, ok):
    d = spark.createDataFrame([(raw,)], "raw string").select(answer.decoded(F.col("raw")).alias("d")).first().d
    assert d.ok is ok and (ok or d.answerable is None and d.answer is None)
    if raw == json.dumps(VALID):
        assert d.asDict() == VALID | {"ok": True, "answer": "yes"}


def test_generators_of_any_output_end_nothing(spark):
    said = ['{"answerable": true, "answer": "fine"}', "just prose", '{"answerable": "yes"}', '{"answer": "no flag"}']
    asked = spark.createDataFrame([(k, str(k)) for k in range(6)], "qid long, prompt string")

    def generator(prompt):
        k = int(prompt)
        return said[k] if k < 4 else {"answerable": True, "answer": 7} if k == 4 else {"answerable": False, "answer": "", "confidence": 0.25}

    got = {r.qid: r for r in answer.generate(asked, generator).collect()}
    assert [got[k].ok for k in range(6)] == [True, False, False, False, False, True]
    assert got[0].answer == "fine" and got[1].error == "not of the schema: just prose" and got[5].confidence == 0.25 and got[4].answer == ""


def test_an_answer_of_another_shape_falls_back(spark):
    docs = spark.createDataFrame([(1, "The fee is 4500 rupees and is paid in May.", "p")], "doc_id long, text string, parent string")
    asked = spark.createDataFrame([(1, "what is the fee")], "item_id long, text string")
    made = answer.ask(docs, asked, threshold=-1.0, generator=lambda p: "It is 4500.").first()
    assert (made.mode, made.answer) == ("extractive", "The fee is 4500 rupees and is paid in May.")


def test_words_are_hashed_as_one_by_one():
    from hashlib import md5

    texts = ["Alpha beta alpha", "", "  É x \n", "gamma"]
    want = np.zeros((4, 16))
    for row, text in zip(want, texts, strict=True):
        for word in ("q: " + text).lower().split():
            code = int.from_bytes(md5(word.encode()).digest()[:4], "big")
            row[code % 16] += 1 if code // 16 % 2 == 0 else -1
    assert np.array_equal(answer.hashing_embedder("q: ", 16)(texts), want) and answer.hashing_embedder(dim=8)([]).shape == (0, 8)
