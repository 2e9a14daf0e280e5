"""Settings, page fetching, loaders with checks, reports, latency, the token bucket, sinks and a saved index."""

from __future__ import annotations

import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import settings
from quillspark.operators import answer, corpus, dense, evaluate, latency, reports, retrieve
from quillspark.sources import files, labelled, pages


def test_settings_tolerate_what_does_not_parse():
    found = settings.Settings.read({"TOP_K": "seven", "RETRIEVAL_MIN_SCORE": "0.5", "GEN_RPM_LIMIT": "", "RETRIEVAL_MODE": "DENSE", "GEMINI_API_KEY": "  k ", "EMBED_MODEL": "a/b"})
    assert (found.top_k, found.min_score, found.per_minute, found.mode, found.api_key) == (5, 0.5, 30, "dense", "k")
    assert found.index_path == "a__b/flat/parent_child" and found.can_generate
    shown = found.redacted()
    assert "k" not in map(str, shown.values()) and shown["generation_enabled"]


@pytest.mark.parametrize(("raw", "want"), [("*", ["*"]), (" https://a.b , ,http://c", ["https://a.b", "http://c"]), ("", [])])
def test_origins(raw, want):
    assert settings.origins(raw) == want


def test_health():
    assert settings.health(None, settings.Settings())["status"] == "loading"
    assert settings.health(3, settings.Settings(api_key="x")) == {"status": "ok", "vectors": 3, "generation_enabled": True, "accepts_user_key": True}


def test_fetching_waits_longer_each_time():
    calls, pauses = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return "page"

    assert pages.persistent(flaky, pause=pauses.append)("u") == "page" and pauses == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="could not fetch u"):
        pages.persistent(lambda u: 1 / 0, pause=pauses.append)("u")


def test_pages_of_a_local_server(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/terms":
                self.send_response(302)
                self.send_header("Location", "/moved")
                self.end_headers()
                return
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<p>é {self.path}</p>".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}/"
        rows = {r.page_id: r for r in pages.fetch_pages(spark, base).collect()}
        assert {i: r.html for i, r in rows.items()} == {0: "<p>é /</p>", 1: "<p>é /moved</p>"}
        assert [r.volatile for r in pages.fetch_pages(spark, base, volatile=True).orderBy("page_id").collect()] == [False, False, True]
    finally:
        server.shutdown()


def test_questions_with_faults_are_refused(spark):
    schema = "id string, query string, expect string, gold array<string>"
    good = spark.createDataFrame([("a", "q", "answer", ["d"]), ("b", "q", "refuse", None)], schema)
    assert {r.id: r.gold for r in labelled.load_questions(good).collect()} == {"a": ["d"], "b": []}
    bad = spark.createDataFrame([("c", "q", "answer", []), ("d", "q", "refuse", ["x"]), ("e", "q", "maybe", None), (None, "q", "refuse", None)], schema)
    assert labelled.question_faults(bad).count() == 4
    with pytest.raises(ValueError, match="requires gold|must have empty gold|must be answer"):
        labelled.load_questions(good.union(bad))


def test_cases_get_defaults_or_are_refused(spark):
    schema = "id string, query string, expect string, gate_expect string"
    good = spark.createDataFrame([("a", "q", "block", None), ("b", "q", None, "pass"), ("c", "q", "odd", "block")], schema)
    assert all(r.known_limit is False and r.answer == "" for r in labelled.load_cases(good).collect())
    bad = good.union(spark.createDataFrame([("x", "q", None, None), ("y", "q", "pass", "maybe")], schema))
    assert {r.id: r.fault for r in labelled.case_faults(bad).collect()} == {"x": "expect must be block|pass", "y": "gate_expect must be block|pass"}
    with pytest.raises(ValueError, match="block"):
        labelled.load_cases(bad)


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def __call__(self):
        return self.now

    def wait(self, seconds):
        self.waits.append(seconds)
        self.now += seconds


def test_bucket_bursts_waits_and_gives_up():
    clock = Clock()
    bucket = answer.Bucket(60, 3, clock, clock.wait)
    assert all(bucket.acquire() for _ in range(3)) and not clock.waits
    assert bucket.acquire() and sum(clock.waits) == pytest.approx(1.0) and max(clock.waits) <= 0.25
    assert not bucket.acquire(deadline=0.5) and clock.now == pytest.approx(1.0)
    clock.now += 100
    assert [bucket.acquire(0) for _ in range(4)] == [True, True, True, False]


def test_paced_calls_share_a_rate():
    clock = Clock()
    call = answer.paced(lambda p: {"answer": p}, 60, 60, 10.0, clock, clock.wait)
    assert call("a") == {"answer": "a"}
    with pytest.raises(TimeoutError):
        call("c")
    assert answer.retried(call, lambda e: False, pause=clock.wait)("d")["error"].startswith("rate limit")


def test_error_details_are_cut():
    def fail(prompt):
        raise RuntimeError("x" * 500)

    assert answer.retried(fail, lambda e: False)("p")["error"] == "x" * 160


def test_pauses_grow_up_to_five_seconds():
    pauses = []
    answer.retried(lambda p: 1 / 0, lambda e: True, attempts=6, pause=pauses.append)("p")
    assert all(2**n <= x <= 2**n + 0.4 for n, x in enumerate(pauses[:2])) and pauses[3:] == [5.0, 5.0]


def test_timings_add_up():
    clock = Clock()
    timings = latency.Timings(clock)
    for name, seconds in (("embed", 0.5), ("search", 0.25), ("embed", 0.5)):
        with timings.stage(name):
            clock.now += seconds
    assert timings.total() == {"embed": 1000.0, "search": 250.0, "total": 1250.0}


def test_warm_up_and_samples(spark):
    assert latency.warm_up(spark, lambda texts: np.zeros((len(texts), 7)), 2) == 7
    rows = latency.samples(spark, {"a": lambda: spark.range(10), "b": lambda: spark.range(5)}, repeats=2).collect()
    assert sorted((r.stage, r.turn) for r in rows) == [(s, t) for s in ("a", "b", "total") for t in (0, 1)] and all(r.ms > 0 for r in rows)


def test_reports_and_exit_status(spark, tmp_path):
    cases = spark.createDataFrame([(1, True, False, "scope"), (2, False, False, "score"), (3, False, True, "reaches_generation")], "id long, correct boolean, known_limit boolean, first_gate string")
    rollup = evaluate.rollup(cases)
    report = reports.guardrail_report(cases, rollup, threshold=0.5)
    assert (report["n_cases"], report["scored_correct"], report["documented_limits"], report["undocumented_failures"]) == (3, 1, 1, ["2"])
    path = f"file://{tmp_path}/report"
    reports.write_report(spark, path, report)
    assert reports.read_report(spark, path) == report
    assert reports.exit_status(rollup) == 1 and reports.exit_status(evaluate.rollup(cases.where("id <> 2"))) == 0
    rules = spark.createDataFrame([("01", True), ("02", False)], "rule string, ok boolean")
    assert reports.exit_status(invariants=rules) == 1 and reports.exit_status(invariants=rules.where("ok")) == 0
    results = spark.createDataFrame([("dense", 0.7, 5.0), ("rrf", 0.7, 4.0)], "ranker string, prec1 double, p50 double")
    assert reports.retrieval_report(results, 2, k=5)["results"][0]["ranker"] == "dense"
    assert evaluate.best_ranker(results, "p50", "prec1").first().ranker == "rrf"
    made = reports.calibration_report(results, results.limit(1), results, results, results, kind="flat")
    assert made["config"] == {"kind": "flat"} and len(made["queries"]) == 2


def test_best_signal_by_accuracy(spark):
    aucs = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.5)], "signal string, auc double")
    accuracy = spark.createDataFrame([("a", 0.8), ("b", 0.7), ("c", 0.99)], "signal string, accuracy double")
    assert tuple(evaluate.best_signal(aucs, accuracy).first()) == ("a", 0.9, 0.8)


def test_a_lone_value_is_its_own_cutoff(spark):
    table = evaluate.value_table(spark.createDataFrame([(0.5, True), (0.5, False), (0.5, True)], "v double, pos boolean"), "v", F.col("pos"))
    best = evaluate.best_cutoff(evaluate.sweep(table)).first()
    assert (best.cutoff, best.kept, best.blocked, best.hallucination_risk) == (0.5, 2, 0, 1)


def test_percentile_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "v double")
    assert evaluate.percentile(none, "v", 95).first().value == 0 and evaluate.middle(none, "v").first().value == 0


def test_corpus_and_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one", "faq"), (2, "three", "task"), (3, "two", "faq")], "doc_id long, text string, kind string")
    path = f"file://{tmp_path}/corpus"
    made = files.write_corpus(docs, docs.where("doc_id = 9"), path, "here")
    assert made == {"source": "here", "n_docs": 3, "n_chars": 11, "by_kind": {"faq": 2, "task": 1}, "n_dropped": 0}
    assert spark.read.json(f"{path}/docs").count() == 3 and reports.read_report(spark, f"{path}/manifest") == made
    with pytest.raises(ValueError, match="empty corpus"):
        files.write_corpus(docs.where("false"), docs, path, "here")
    index = spark.createDataFrame([(1, "parent_child", [1.0, 0.0])], "doc_id long, strategy string, embedding array<double>")
    files.write_index(index, f"{path}/index", "a/b", "flat")
    assert files.read_index(spark, f"{path}/index", "a/b", "flat", "parent_child").first().embedding == [1.0, 0.0]
    with pytest.raises(ValueError, match="no index"):
        files.read_index(spark, f"{path}/index", "a/b", "hnsw", "parent_child")


def corpus_of(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("parent"))
    return docs, spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")


def hits_by(found):
    return sorted((r.qid, r["rank"], r.doc_id, r.score) for r in found[0].collect())


def test_a_saved_index_gives_the_same(spark, data, tmp_path):
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs)
    retrieve.save_index(index, f"file://{tmp_path}/index")
    loaded = retrieve.load_index(spark, f"file://{tmp_path}/index")
    want = hits_by(retrieve.retrieve(docs, items))
    assert hits_by(retrieve.retrieve(loaded, items)) == want and want
    assert "documents.parquet" not in str(retrieve.retrieve(loaded, items)[0]._jdf.queryExecution().toString())


def test_ones_own_embedders(spark, data):
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs, answer.hashing_embedder("passage: "), answer.hashing_embedder("query: "))
    best = retrieve.retrieve(index, items, "dense")[0].where("rank = 1").select("qid", "score")
    vectors = dense.embed(docs, answer.hashing_embedder("passage: "))
    asked = dense.embed(items, answer.hashing_embedder("query: "))
    want = dense.exact_top_k(vectors, asked, 1, vid="doc_id", qid="item_id").select("qid", "score")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError, match="embedder"):
        retrieve.build_index(docs, answer.hashing_embedder())


def test_bounded_ranks_are_those_among_all(spark, data):
    """Ranks of candidates against windows over every document; and no document of the first twenty is missed."""
    docs, items = corpus_of(spark, data)
    index = retrieve.build_index(docs)
    full = {(r.qid, r.doc_id): (r.rd, r.rl, r.fused) for r in retrieve.reciprocal(retrieve.candidates(docs, items, index)).collect()}
    for fetch in (20, 3):
        some, gate = retrieve.bounded(index, items, fetch, 5)
        got = {(r.qid, r.doc_id): (r.rd, r.rl) for r in some.collect()}
        assert all(full[k][:2] == v for k, v in got.items())
        by_query = {}
        for (q, doc), (rd, rl, _) in full.items():
            by_query.setdefault(q, []).append((-(1 / (5 + rd) + 1 / (5 + rl)), doc))
        assert all((q, doc) in got for q, rows in by_query.items() for _, doc in sorted(rows)[:fetch])
    assert gate.count() == items.count()


def test_candidates_of_approximate_search(spark, data):
    """A tenth of all pairs at most get an exact score, and recall against the exact best is 0.9 or more."""
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = {(r.qid, r.vec_id) for r in dense.approximate_top_k(dense.sign(vectors), asked, 5).collect() if r.qid != r.vec_id}
    best = {(r.qid, r.vec_id) for r in dense.exact_top_k(vectors, asked, 5).collect() if r.qid != r.vec_id}
    assert dense.SHARE <= 0.1 and len(found & best) >= 0.9 * len(best)


def test_documents_that_hold_an_item(spark):
    docs = [(1, "x the quick brown fox jumps over y"), (2, "the quick brown fox"), (3, None), (4, "quick  brown"), (5, "a the quick brown foxes b c")]
    items = [(1, "the quick brown fox"), (2, "he quick brown f"), (3, "quick brown"), (4, None), (5, ""), (6, "foxes b c"), (7, "ow"), (8, " "), (9, "k  b"), (10, "fox"), (11, "x"), (12, "quick brown")]
    rows = corpus.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "qid long, text string"))
    want = {(q, d) for q, item in items if item for d, text in docs if text and item in text}
    assert {tuple(r) for r in rows.collect()} == want and {(2, 5), (7, 1), (9, 4), (3, 2)} <= want


def test_markers_of_a_site(spark):
    from quillspark.functions import text as t

    row = spark.createDataFrame([("Join 40 Hackers now",)], "x string")
    assert not row.select(t.like_counter(F.col("x"))).first()[0] and row.select(t.like_counter(F.col("x"), ["hackers"])).first()[0]
    assert row.select(t.boilerplate(F.col("x"), r"^join \d+ .*$")).first()[0] is False
    assert row.select(t.boilerplate(F.col("x"), r"(?i)^join \d+ .*$")).first()[0]


def test_stages_of_answers_are_timed(spark, tmp_path):
    """Times of stages add up whatever the clock says; percentiles follow the reports' rule; a stream keeps each batch's."""
    from quillspark.streaming.questions import answer_stream

    docs = spark.createDataFrame([(1, "The fee is 4500 rupees and is paid in May.", "p")], "doc_id long, text string, parent string")
    asked = spark.createDataFrame([(1, "what is the fee"), (2, "write me a poem")], "item_id long, text string")
    index, clock = retrieve.build_index(docs), Clock()

    def run(batch, timings):
        found = answer.ask(docs, batch, index=index, timings=timings, threshold=-1.0, generator=answer.first_passage)
        clock.now += 1
        return found

    rows = latency.micro_batches(spark, [asked, asked], run, clock).collect()
    assert {r.stage for r in rows} == {"gate", "retrieval", "contexts", "generation", "grounding", "total"} and {r.turn for r in rows} == {0, 1}
    told = answer.ask(docs, asked, index=index, timings=latency.Timings(), threshold=-1.0)
    assert sorted(map(str, told.collect())) == sorted(map(str, answer.ask(docs, asked, index=index, threshold=-1.0).collect()))
    samples = spark.createDataFrame([("a", k, float(k)) for k in range(1, 21)] + [("b", 0, 5.0)], latency.SAMPLES)
    assert {r.stage: tuple(r)[1:] for r in latency.report(samples).collect()} == {"a": (20, 10.5, 10.0, 20.0, 20.0), "b": (1, 5.0, 5.0, 5.0, 5.0)}
    asked.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, docs, str(tmp_path / "out"), str(tmp_path / "at"), index, str(tmp_path / "ms")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "ms"))
    assert kept.where("stage = 'total' and ms > 0").count() == spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() == 1


def test_samples_of_a_fake_clock(spark):
    clock = Clock()

    def run(batch, timings):
        for name, seconds in (("gate", 1.0), ("retrieval", batch.count())):
            with timings.stage(name):
                clock.now += seconds

    found = latency.report(latency.micro_batches(spark, [spark.range(n) for n in (2, 4, 9)], run, clock))
    assert {r.stage: (r.n, r.p50, r.max) for r in found.collect()} == {"gate": (3, 1000.0, 1000.0), "retrieval": (3, 4000.0, 9000.0), "total": (3, 5000.0, 10000.0)}


def chunked(spark, data):
    from quillspark.operators import chunking

    docs = corpus.corpus(spark.read.parquet(f"{data}/documents.parquet"))
    return chunking, docs, chunking.chunks(docs)


def test_summary_of_all_strategies(spark, data):
    """Sizes and dropped copies of every strategy, recursive ones too, against plain Python over the chunks."""
    import statistics

    chunking, _, made = chunked(spark, data)
    rows, firsts = made.collect(), {}
    for r in sorted(rows, key=lambda r: (r.strategy, r.doc_id, r.part, r.chunk_id)):
        firsts.setdefault((r.strategy, r.embed_text.strip().lower()), r)
    got = {r.strategy: r for r in chunking.summary(made).collect()}
    assert set(got) == {"structural", "recursive", "parent_child"}
    for name, r in got.items():
        left = [x for (s, _), x in firsts.items() if s == name]
        sizes = [len(x.embed_text) for x in left]
        assert (r.n_chunks, r.deduped) == (len(left), sum(x.strategy == name for x in rows) - len(left))
        assert (r.embed_min, r.embed_median, r.embed_max) == (min(sizes), int(statistics.median(sizes)), max(sizes))
        assert r.amplification == pytest.approx(sum(len(x.context_text) for x in left) / sum(sizes), abs=0.006)


def test_build_report_of_all_strategies(spark, data):
    _, _, made = chunked(spark, data)
    want = {r.strategy: r["count"] for r in made.groupBy("strategy").count().collect()}
    got = dense.timed_report(made, answer.hashing_embedder(dim=16)).collect()
    assert {r.strategy: (r.n_vectors, r.dim) for r in got} == {s: (n, 16) for s, n in want.items()} and all(r.embed_ms > 0 for r in got)


def test_export_is_read_again(spark, data, tmp_path):
    chunking, docs, _ = chunked(spark, data)
    made = chunking.parent_child(docs)
    path = f"file://{tmp_path}/export"
    files.write_export(made, path, "a note")
    back, header = files.read_export(spark, path)
    columns = ["chunk_id", "doc_id", "title", "kind", "embed_text", "context_text"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, made.select(columns).collect()))
    codes = [r.doc_id for r in back.select("doc_id", "parent_code").distinct().orderBy("parent_code").collect()]
    assert codes == sorted(codes) and [r.parent_code for r in back.select("parent_code").distinct().orderBy("parent_code").collect()] == list(range(len(codes)))
    assert tuple(header.first()) == (made.count(), len(codes), "a note")


def test_numbers_of_rows_run_through_ranges(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), "id").repartition(5)
    got = sorted((r.n, r.x, r.id) for r in files.numbered_rows(df, "n", "x", "id").collect())
    assert [n for n, *_ in got] == list(range(1000)) and [(x, i) for _, x, i in got] == sorted((x, i) for _, x, i in got)
    assert files.numbered_rows(df.limit(0), "n", "x").count() == 0


def test_texts_are_not_shuffled_with_each_chunk(spark, data):
    """Neither by what tells copies, nor by a summary, a store of chunks or an export."""
    chunking, docs, made = chunked(spark, data)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "context_text" not in plan(chunking.dedupe(made, ["chunk_id"]))
    assert "struct(chunk_id" not in plan(chunking.summary(made)) and "Join" not in plan(chunking.summary(made))
    chunks, contexts = files.stored(made, docs.select("doc_id", F.col("text").alias("context_text")), "strategy")
    assert "context_text" not in chunks.columns and chunks.count() == made.count() and contexts.count() == docs.count()
    some = chunking.split_contexts(docs)[1]
    assert "Generate" not in plan(some) and some.count() == chunking.parent_child(docs).select("doc_id").distinct().count()
    short, _ = files.encoded(chunking.parent_child(docs))
    assert "context_text" not in plan(short)


def test_a_text_is_packed_once(spark, data):
    chunking, docs, _ = chunked(spark, data)
    plan = chunking.parent_child(docs).select("chunk_id", "n_parts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1


def test_a_family_of_rankers_keeps_few_candidates(spark, data):
    """The first of each ranker as over all pairs, from far fewer of them."""
    from quillspark.plans import q_retrieval as r

    both = retrieve.weighted(retrieve.reciprocal(r.both_of(spark, data)))
    few = retrieve.family(retrieve.build_index(r.docs_of(spark, data)), r.items_of(spark, data), fetch=20)
    for name in ("dense", "rrf_10", "alpha_0.5"):
        got = retrieve.collapse(few.where(F.col("ranker") == name), F.col("f")).select("qid", "rank", "doc_id").collect()
        want = retrieve.collapse(both, retrieve.rankers(both)[name]).select("qid", "rank", "doc_id").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
