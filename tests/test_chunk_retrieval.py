"""Retrieval over the engine's own chunks: string ids, blocks of postings, and the whole path from pages to answers."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import answer, blocks, chunking, corpus, html, retrieve
from quillspark.plans.q_corpus import FIXTURE
from tests.test_services import corpus_of


def tokens(text):
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return [next((w[: -len(x)] for x in ("ing", "es", "s") if w.endswith(x) and len(w) > len(x) + 2), w) for w in words]


def by_hand(docs, asked, k=5):
    """Hits of every query, from scores of every pair: docs (id, text, parent), asked (id, text)."""
    docs = sorted(docs)
    bags = [Counter(tokens(x)) for _, x, _ in docs]
    df, n = Counter(w for b in bags for w in b), len(docs)
    avgdl = sum(sum(b.values()) for b in bags) / n

    def vector(bag):
        terms = list(bag)
        at, sign = blocks.hashed_dimensions(terms, retrieve.DIM)
        v = np.bincount(at, [bag[w] * s for w, s in zip(terms, sign, strict=True)], retrieve.DIM) if terms else np.zeros(retrieve.DIM)
        return v / (math.sqrt(v @ v) or 1.0)

    vectors = [vector(b) for b in bags]
    out = {}
    for q, text in asked:
        bag = Counter(tokens(text))
        mine = vector(bag)
        dense = [round(float(v @ mine), 9) for v in vectors]
        lex = []
        for b in bags:
            norm = 1.5 * (0.25 + 0.75 * sum(b.values()) / avgdl)
            lex.append(round(sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.5 / (b[w] + norm) for w, m in bag.items() if w in b), 4))
        rd, rl = ({j: r + 1 for r, j in enumerate(sorted(range(n), key=lambda j, x=x: (-x[j], j)))} for x in (dense, lex))
        order = sorted(range(n), key=lambda j: (-round(1 / (60 + rd[j]) + 1 / (60 + rl[j]), 9), j))[: 4 * k]
        firsts = {}
        for j in order:
            firsts.setdefault(docs[j][2], j)
        out[q] = [docs[j][0] for j in list(firsts.values())[:k]]
    return out


def hits(found):
    out = {}
    for r in sorted(found[0].collect(), key=lambda r: r["rank"]):
        out.setdefault(r.qid, []).append(r.doc_id)
    return out


@pytest.fixture(scope="module")
def passages(spark, data):
    docs = corpus.corpus(spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 4 = 1"))
    return retrieve.passages(chunking.dedupe(chunking.chunks(docs)))


@pytest.mark.parametrize("segment", [1024, 100])
def test_hits_over_all_strategies_equal_all_pairs(spark, data, passages, segment):
    """Structural, recursive and child chunks together, by string ids; segments of any size give the same."""
    _, items = corpus_of(spark, data)
    rows = [(r.doc_id, r.text, r.parent) for r in passages.collect()]
    assert len(rows) > 1000 and {x[0].split("::")[0] for x in rows} == {"st", "rc", "pc"}
    index = retrieve.build_index(passages, segment=segment)
    assert index.segments.agg(F.sum("n")).first()[0] == len(rows)
    assert hits(retrieve.retrieve(index, items)) == by_hand(rows, [(r.item_id, r.text) for r in items.collect()])


def test_only_bounded_rows_leave_a_task(spark, data, passages):
    """Of all pairs, a task passes on what may be among the first of either ranking."""
    _, items = corpus_of(spark, data)
    index = retrieve.build_index(passages, segment=200)
    asked = next(iter(retrieve.asked_blocks(index, items)))
    most, n = 10, passages.count()
    found = index.segments.coalesce(1).mapInArrow(blocks.first_of(asked, most), retrieve._found(index)).toArrow()
    # What a task has passed on grows with the logarithm of its documents, for each ranking.
    assert found.num_rows <= 2 * most * (2 + math.log(n / most)) * items.count() < n * items.count() / 10


def test_no_score_exceeds_its_bound(spark, data):
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs, segment=128)
    asked = next(iter(retrieve.asked_blocks(index, items)))
    for batch in index.segments.toArrow().to_batches():
        for k in range(batch.num_rows):
            seg = blocks.Segment(batch, k, asked)
            bounds, some = seg.bounds(asked.table()), np.arange(0, seg.n, 3)
            pairs = seg.lexical_of(some, asked.by_term())
            for q in range(len(asked.names)):
                lex = seg.lexical(q)
                assert (lex <= np.repeat(bounds[q], blocks.BLOCK)[: seg.n]).all() and np.allclose(pairs[q], lex[some], atol=1.1e-4)
                alive = bounds[q] > np.median(bounds[q])
                assert np.array_equal(seg.lexical(q, alive), np.where(np.repeat(alive, blocks.BLOCK)[: seg.n], lex, 0))


def test_segments_that_add_nothing(spark, data):
    """A segment of which no document comes among the best passes nothing on, wherever it stands."""
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs.where("length(text) > 200"), segment=16)
    asked = next(iter(retrieve.asked_blocks(index, items.limit(1))))
    batches = index.segments.coalesce(1).toArrow().to_batches()
    assert sum(x.num_rows for x in batches) > 5
    found = list(blocks.first_of(asked, 1)(iter(batches)))
    best = max((max(b.column("dense").to_pylist()) for b in found))
    assert len(found) < sum(x.num_rows for x in batches) and best == max(blocks.Segment(b, k, asked).cosines().max() for b in batches for k in range(b.num_rows))
    seg = blocks.Segment(batches[0], 0, asked)
    assert seg.lexical_of(np.empty(0, np.int64), asked.by_term()).shape == (1, 0)


def test_best_settles_ties_by_number():
    best = blocks.Best(1, 3)
    assert best.add(0, np.array([1.0, 2.0, 1.0, 1.0]), np.array([10, 11, 12, 13])).tolist() == [1, 0, 2]
    assert best.add(0, np.array([1.0, 1.0, 0.5]), np.array([5, 20, 1])).tolist() == [0] and best.nums[0].tolist() == [11, 5, 10]


def test_odd_documents(spark):
    schema = "doc_id string, text string, parent string"
    asked = spark.createDataFrame([("a", "red fox"), ("b", ""), ("c", None), ("d", "!!")], "item_id string, text string")
    none = retrieve.build_index(spark.createDataFrame([], schema))
    found, results = retrieve.retrieve(none, asked)
    assert found.count() == 0 and results.count() == 0
    docs = spark.createDataFrame([("x", None, "p"), ("y", "", None), (None, "a red fox", "q"), ("z", "red red", "p"), ("z", "red red", "p")], schema)
    index = retrieve.build_index(docs)
    found, results = retrieve.retrieve(index, asked)
    assert hits((found, None))["a"][0] is None and {r.qid: (r.term_hits, r.query_terms) for r in results.collect()} == {"a": (2, 2), "b": (0, 0), "c": (0, 0), "d": (0, 0)}
    assert retrieve.retrieve(index, asked.limit(0))[0].count() == 0


def test_blocks_of_queries_agree(spark, data, monkeypatch):
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs)
    want = hits(retrieve.retrieve(index, items))
    monkeypatch.setattr(retrieve, "QUERIES", 7)
    found, results = retrieve.retrieve(index, items)
    assert hits((found, None)) == want and results.count() == items.count()


def test_from_pages_to_answers(spark):
    """Pages are extracted, checked, cut, deduped, indexed, found by children and read and cited by documents."""
    pages = spark.createDataFrame([(1, "https://site.test/", FIXTURE), (2, "https://site.test/terms", FIXTURE), (3, "https://site.test/result", "<p>soon</p>")], "page_id long, url string, html string")
    docs = html.dispatch(pages).where("not volatile")
    kept = corpus.routed(docs.select("doc_id", "section", "title", "text", "kind")).where("reason is null").drop("reason")
    chunks = chunking.dedupe(chunking.chunks(kept, ["parent_child"]))
    passages = retrieve.passages(chunks)
    asked = spark.createDataFrame([(1, "when does registration open"), (2, "where is the venue and when do doors open"), (3, "when are prizes paid"), (4, "zzz qqq"), (5, "write me a poem")], "item_id long, text string")
    got = {r.qid: r for r in answer.ask(passages, asked, threshold=0.2, cite="parent").collect()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert "faq-00" not in texts  # too short a document
    assert got[1].answered and got[1].citations[0] == "timeline-00" and got[1].answer == texts["timeline-00"]
    assert got[2].citations[0] == "notice-board-00" and "old mill" in got[2].answer
    assert "thirty days" in got[3].answer and got[3].mode == "extractive"
    assert got[4].refusal_reason == "no_corpus_vocabulary" and got[4].citations == []
    assert got[5].refusal_reason == "out_of_scope_instruction"
    slim, parents = retrieve.passages(chunks, context=False), kept.select("doc_id", "title", "text")
    assert "context" not in slim.columns
    assert {r.qid: tuple(r) for r in answer.ask(slim, asked, threshold=0.2, read=parents).collect()} == {q: tuple(r) for q, r in got.items()}
    told = answer.ask(passages, asked.where("item_id = 3"), threshold=0.0, generator=lambda p: {"answerable": True, "answer": "within 45 days"}, cite="parent").first()
    assert told.refusal_reason == "ungrounded_answer"


def test_an_index_of_chunks_is_saved_and_streams(spark, tmp_path, data, passages):
    from quillspark.streaming.questions import answer_stream

    _, items = corpus_of(spark, data)
    index = retrieve.build_index(passages)
    retrieve.save_index(index, f"file://{tmp_path}/index")
    loaded = retrieve.load_index(spark, f"file://{tmp_path}/index")
    items.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, passages, str(tmp_path / "out"), str(tmp_path / "at"), loaded, cite="parent").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "mode", "citations").collect()
    want = answer.ask(passages, items, index=index, cite="parent").select("qid", "mode", "citations").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and pa.types.is_string(pa.array([x for r in got for x in r.citations]).type)


def test_leaders_and_counts_equal_all_scores():
    """However documents come, the best of each query and how many come before a candidate are those of one sort of all."""
    rng = np.random.default_rng(5)
    scores, others = rng.integers(-40, 40, (7, 500)), rng.integers(0, 9, (7, 500))
    for step in (500, 37, 5):
        firsts = rng.permutation(np.arange(0, 500, step))
        best = blocks.Leaders(7, 20)
        ahead = blocks.Ahead({q: (scores[q, q::3] / 10**9, np.arange(q, 500, 3)) for q in range(7)}, 7, 9)
        for at in firsts.tolist():
            # Scores come as they are before they are rounded.
            raw = scores[:, at : at + step] + rng.uniform(-0.4, 0.4, (7, len(range(at, min(at + step, 500)))))
            best.add(raw, others[:, at : at + step].astype(float), at)
            ahead.add(raw, slice(0, 7), at)
        order = [np.lexsort((np.arange(500), -scores[q])) for q in range(7)]
        q, score, num, other = best.settle()
        assert num.tolist() == np.concatenate([x[:20] for x in order]).tolist()
        assert np.array_equal(score, scores[q, num]) and np.array_equal(other, others[q, num])
        places = {(j, n): r for j, x in enumerate(order) for r, n in enumerate(x.tolist())}
        assert ahead.counts.tolist() == [places[x] for x in zip(ahead.q.tolist(), ahead.nums.tolist(), strict=True)]


def test_products_and_postings_make_the_same_scores(spark, data, monkeypatch):
    """BM25 by a product of frequent terms and by postings of the others is what it is query by query; and little leaves a task."""
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs, segment=64)
    asked = next(iter(retrieve.asked_blocks(index, items)))
    batches = index.segments.coalesce(1).toArrow().to_batches()
    for often in (0.0, 0.005, 2.0):
        monkeypatch.setattr(blocks, "OFTEN", often)
        monkeypatch.setattr(blocks, "PAIRS", 1000)
        seg = blocks.Segment(batches[0], 0, asked)
        dense, lex = seg.scores(slice(0, len(asked.names)))
        assert np.array_equal(blocks.whole(dense), np.rint(seg.cosines().T * 10**9))
        assert np.allclose(blocks.whole(lex) / 10**4, [seg.lexical(q) for q in range(len(asked.names))], atol=1.1e-4)
    rows = list(blocks.leading_of(asked, 5)(iter(batches)))
    assert len(rows) == len(asked.stretches()) and all(len(x.column("q")[0].as_py()) <= 8 * 2 * 5 * blocks.STRETCH for x in rows)
