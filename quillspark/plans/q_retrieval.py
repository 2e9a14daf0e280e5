"""Queries over retrieval: postings, BM25, vectors, fusion, gates and answers.

Documents are the chunks, their source is the parent that hits collapse to, and every benchmark item is a query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import answer, cells, chunking, corpus, dense, guardrails, lexical, retrieve
from quillspark.sources.files import kept
from quillspark.sources.tables import table

from . import sql as q

QUERIES, ORACLES = {}, {}


def _add(name, build, oracle=None):
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


def docs_of(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("parent"))


def items_of(s, d):
    return table(s, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"))


def both_of(s, d):
    return retrieve.candidates(docs_of(s, d), items_of(s, d))


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


# Postings and BM25.
T = f"WITH {q.TERMS} "
BM = f"WITH {q.BM25} "
_add("agg04_term_frequency", lambda s, d: lexical.postings(docs_of(s, d)).tf, T + "SELECT doc_id, term, tf FROM tf")
_add("agg05_document_frequency", lambda s, d: lexical.postings(docs_of(s, d)).df.select("term", "df"), T + "SELECT term, df FROM df")
_add("agg06_lengths", lambda s, d: lexical.postings(docs_of(s, d)).stats.select("n", F.round("avgdl", 6).alias("avgdl")), T + "SELECT n, round(avgdl, 6) AS avgdl FROM stats")
_add("mth01_idf", lambda s, d: lexical.postings(docs_of(s, d)).df.select("term", F.round("idf", 6).alias("idf")), T + "SELECT term, round(idf, 6) AS idf FROM df")
_add("mth02_term_weight", lambda s, d: _weights(s, d), T + "SELECT doc_id, term, round(idf * tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)), 5) AS weight FROM tf JOIN df USING (term) JOIN dl USING (doc_id), stats")


def _weights(s, d):
    p = lexical.postings(docs_of(s, d))
    x = p.tf.join(p.df, "term").join(p.lengths, "doc_id").crossJoin(F.broadcast(p.stats.select("avgdl")))
    return x.select("doc_id", "term", F.round(F.col("idf") * F.col("tf") * 2.5 / (F.col("tf") + 1.5 * (F.lit(0.25) + 0.75 * F.col("dl") / F.col("avgdl"))), 5).alias("weight"))


def _bm25(s, d, k=None):
    return lexical.bm25(lexical.counted(docs_of(s, d), items_of(s, d)), k)


_add("j04_bm25_scores", lambda s, d: _bm25(s, d).drop("n_terms"), BM + "SELECT qid, doc_id, score FROM bm")
_add("agg07_bm25", _bm25, BM + "SELECT qid, doc_id, score, n_terms FROM bm JOIN (SELECT qid, doc_id, count(*) AS n_terms FROM qt JOIN tf USING (term) GROUP BY ALL) USING (qid, doc_id)")
_add("top04_bm25_top5", lambda s, d: dense.top_k(_bm25(s, d, 5), 5, "doc_id").select("qid", "doc_id", "score", *_long("rank")), BM + "SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 5")
_add("top04_distinct_parents", lambda s, d: hits_of(s, d, "bm25")[0].select("qid", *_long("rank"), "doc_id", "parent", "lex"), f"WITH {q.RANKS}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, parent ORDER BY rl) AS k FROM ranks WHERE rl <= 20) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rl) AS rank, doc_id, parent, lex FROM f WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rl) <= 5")
_OV = f"WITH {q.TERMS}, overlap AS (SELECT b.item_id AS qid, count(DISTINCT qt.term) FILTER (df.term IS NOT NULL) AS term_hits, count(DISTINCT qt.term) AS query_terms FROM benchmark b LEFT JOIN qt ON qt.qid = b.item_id LEFT JOIN df ON df.term = qt.term GROUP BY 1) "


def _overlap(s, d):
    items = items_of(s, d)
    return lexical.overlap(items, lexical.query_terms(items), lexical.postings(docs_of(s, d)))


_add("j05_known_terms", lambda s, d: lexical.query_terms(items_of(s, d)).join(lexical.postings(docs_of(s, d)).df, "term", "left_semi").select("qid", "term"), T + "SELECT DISTINCT qid, term FROM qt SEMI JOIN df USING (term)")
_add("agg15_overlap", _overlap, _OV + "SELECT * FROM overlap")
_add("flt06_vocabulary_gate", lambda s, d: _overlap(s, d).select("qid", guardrails.vocabulary(F.col("term_hits")).alias("ok")), _OV + "SELECT qid, term_hits > 0 AS ok FROM overlap")

# Vectors: every twentieth vector asks, all answer.
VEC = "WITH a AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT qid, vec_id, label, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(q AS DOUBLE[]), CAST(q AS DOUBLE[]))) * sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))), 9) + 0 AS score FROM a, embeddings) "


def _asked(s, d):
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def _scored(s, d, k=None):
    return dense.score(table(s, d, "embeddings"), _asked(s, d), k, keep=["label"])


_add("mth03_unit", lambda s, d: table(s, d, "embeddings").select("vec_id", F.round(t.dot(t.unit(F.col("embedding")), t.unit(F.col("embedding"))), 9).alias("norm")), "SELECT vec_id, CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm FROM (SELECT vec_id, list_inner_product(embedding, embedding) AS n FROM embeddings)")
_add("mth04_inner_product", lambda s, d: _scored(s, d).select("qid", "vec_id", "score"), VEC + "SELECT qid, vec_id, score FROM s")
_add("j03_queries_by_chunks", lambda s, d: dense.score_ranges(table(s, d, "embeddings"), _asked(s, d)), VEC + "SELECT qid, count(*) AS n, min(score) AS low, max(score) AS high FROM s GROUP BY qid")
_TOP5 = VEC + "SELECT qid, vec_id, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"
_top5 = lambda s, d: dense.top_k(_scored(s, d, 5), 5).select("qid", "vec_id", "label", "score", *_long("rank"))
_add("top01_exact_top5", _top5, _TOP5)
_add("j01_payload", lambda s, d: dense.exact_top_k(table(s, d, "embeddings"), _asked(s, d), 5).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").select("qid", "vec_id", "label", *_long("rank")), VEC + "SELECT h.qid, h.vec_id, e.label, h.rank FROM (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5) h JOIN embeddings e USING (vec_id)")
_add("top03_overfetch", lambda s, d: dense.top_k(_scored(s, d, 20), 20).select("qid", "vec_id", *_long("rank")), VEC + "SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20")
_add("top02_approximate_top5", lambda s, d: dense.approximate_top_k(dense.sign(table(s, d, "embeddings")), _asked(s, d)))
_add("top02_cells_top5", lambda s, d: _in_cells(kept(_document_vectors(s, d), "vectors")))


def _document_vectors(s, d):
    """Documents by the default embedding: unlike the table of vectors, which are random, these lie in groups."""
    return retrieve.feature_vectors(table(s, d, "documents").select("doc_id", "text"), "doc_id")


def _in_cells(vectors):
    return cells.nearest(cells.build(vectors, vid="doc_id"), vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"))


_add("win02_parent_collapse", lambda s, d: retrieve.collapse(_scored(s, d, 20).withColumnsRenamed({"label": "parent", "vec_id": "doc_id"}), F.col("score")).select("qid", "doc_id", "parent", "score", *_long("rank")), VEC + ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS r FROM s), f AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY r) AS k FROM r WHERE r <= 20) SELECT qid, vec_id AS doc_id, label AS parent, score, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM f WHERE k = 1 QUALIFY rank <= 5")

# Fusion.
BOTH, RANKS, RRF, HITS = (f"WITH {x} " for x in (q.DENSE, q.RANKS, q.RRF, q.HITS))
_add("j09_full_candidates", both_of, BOTH + "SELECT qid, doc_id, parent, dense, lex FROM cand")
_add("win01_ranks", lambda s, d: retrieve.places(both_of(s, d)).select("qid", "doc_id", *_long("rd", "rl")), RANKS + "SELECT qid, doc_id, rd, rl FROM ranks")
_add("mth05_reciprocal_ranks", lambda s, d: retrieve.places(both_of(s, d)).select("qid", "doc_id", "fused"), RRF + "SELECT qid, doc_id, f AS fused FROM fused")
_add("top07_hybrid_order", lambda s, d: retrieve.hybrid_order(both_of(s, d)).select("qid", "doc_id", *_long("r")), RRF + "SELECT qid, doc_id, r FROM ordered")
_SCALED = f"WITH {q.DENSE}, m AS (SELECT *, min(dense) OVER w AS d0, max(dense) OVER w AS d1, min(lex) OVER w AS l0, max(lex) OVER w AS l1 FROM cand WINDOW w AS (PARTITION BY qid)), s01 AS (SELECT *, CASE WHEN d1 > d0 THEN (dense - d0) / (d1 - d0) ELSE CAST(0 AS DOUBLE) END AS d01, CASE WHEN l1 > l0 THEN (lex - l0) / (l1 - l0) ELSE CAST(0 AS DOUBLE) END AS l01 FROM m) "
_add("mth06_min_max", lambda s, d: _scaled(s, d).select("qid", "doc_id", F.round("d01", 6).alias("d01"), F.round("l01", 6).alias("l01")), _SCALED + "SELECT qid, doc_id, round(d01, 6) AS d01, round(l01, 6) AS l01 FROM s01")
_add("win08_range_per_query", lambda s, d: both_of(s, d).groupBy("qid").agg(F.min("dense").alias("d0"), F.max("dense").alias("d1"), F.min("lex").alias("l0"), F.max("lex").alias("l1")), _SCALED + "SELECT DISTINCT qid, d0, d1, l0, l1 FROM s01")
_add("mth07_weighted", lambda s, d: retrieve.weighted(both_of(s, d), [0.7]).select("qid", "doc_id", F.col("`alpha_0.7`").alias("fused")), _SCALED + "SELECT qid, doc_id, round(CAST(0.7 AS DOUBLE) * d01 + (CAST(1 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * l01, 6) AS fused FROM s01")


def _scaled(s, d):
    return retrieve.scaled(both_of(s, d))


def hits_of(s, d, mode="hybrid"):
    return retrieve.retrieve(docs_of(s, d), items_of(s, d), mode)


_add("top05_hybrid_hits", lambda s, d: hits_of(s, d)[0].select("qid", *_long("rank"), "doc_id", "parent", "score", "lex"), HITS + "SELECT qid, rank, doc_id, parent, score, lex FROM hits")
_add("agg14_gate_score", lambda s, d: retrieve.gate_scores(both_of(s, d)), HITS + "SELECT qid, gate_score FROM gate")
_add("flt07_score_gate", lambda s, d: retrieve.gate_scores(both_of(s, d)).select("qid", guardrails.score_gate(F.col("gate_score")).alias("ok"), F.lit(guardrails.MIN_SCORE).alias("threshold")), HITS + "SELECT qid, gate_score >= CAST(0.8167 AS DOUBLE) AS ok, CAST(0.8167 AS DOUBLE) AS threshold FROM gate")
_CTX = f"{q.HITS}, ctx AS (SELECT h.qid, list(coalesce(d.text, '') ORDER BY rank) AS contexts, list(h.doc_id ORDER BY rank) AS ids FROM hits h JOIN documents d USING (doc_id) GROUP BY h.qid)"


def contexts_of(s, d):
    return answer.contexts(hits_of(s, d)[0], docs_of(s, d))


_add("agg24_contexts", lambda s, d: contexts_of(s, d).select("qid", F.md5(F.array_join("contexts", "|").cast("binary")).alias("contexts")), f"WITH {_CTX} SELECT qid, md5(array_to_string(contexts, '|')) AS contexts FROM ctx")
_add("str14_prompt", lambda s, d: answer.prompts(hits_of(s, d)[0], corpus.corpus(table(s, d, "documents")), items_of(s, d)).select("qid", F.md5(F.col("prompt").cast("binary")).alias("prompt")), f"WITH {q.HITS}, {q.CORPUS}, p AS (SELECT h.qid, string_agg('[' || rank || '] doc_id=' || h.doc_id || ' | ' || c.title || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank) AS ctx FROM hits h JOIN corpus c USING (doc_id) GROUP BY h.qid) SELECT qid, md5('CONTEXT PASSAGES' || chr(10) || ctx || chr(10) || chr(10) || 'QUESTION' || chr(10) || b.text) AS prompt FROM p JOIN benchmark b ON b.item_id = p.qid")
_add("udf08_extractive", lambda s, d: hits_of(s, d)[0].where("rank = 1").join(docs_of(s, d).select("doc_id", "text"), "doc_id").select("qid", "doc_id", F.md5(F.col("text").cast("binary")).alias("answer")), HITS + "SELECT qid, doc_id, md5(coalesce(text, '')) AS answer FROM hits JOIN documents USING (doc_id) WHERE rank = 1")

# Gates.
CONV = "(SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')"


def _scope_sql(x):
    s = q.strip(x)
    asks = " OR ".join(f"regexp_matches({s}, {q.lit(p)})" for p in t.IMPERATIVE)
    return f"CASE WHEN {s} = '' THEN 'empty_query' WHEN length({s}) > 500 THEN 'query_too_long' WHEN {asks} THEN 'out_of_scope_instruction' ELSE 'in_scope' END"


def _user(s, d):
    return table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


_add("flt05_scope_gate", lambda s, d: _user(s, d).select("conv_id", "turn", guardrails.scope(F.col("text")).alias("verdict")), f"SELECT conv_id, turn, {_scope_sql('text')} AS verdict FROM {CONV}")
_MISS = f"""mt AS (SELECT b.item_id AS qid, {q.checkable('b.text')} AS mine, {q.checkable("lower(array_to_string(contexts, ' ' || chr(10) || ' '))")} AS theirs, b.text FROM benchmark b JOIN ctx ON ctx.qid = b.item_id),
gr AS (SELECT qid, len(mine) AS checked, list_sort(list_filter(mine, lambda v: NOT list_contains(theirs, v))) AS missing, regexp_matches({q.ascii_words('text')}, {q.lit(t.HEDGE)}) AS hedge FROM mt)"""
_GR = f"WITH {_CTX}, {_MISS} "


def grounded_of(s, d):
    """Each item's text, as if it were the answer, against what it retrieves."""
    x = contexts_of(s, d).join(items_of(s, d).withColumnRenamed("item_id", "qid"), "qid")
    return x.select("qid", guardrails.grounded(F.col("text"), F.col("contexts")).alias("g"))


_REASON = "CASE WHEN checked = 0 AND hedge THEN 'refusal_no_claims' WHEN checked = 0 THEN 'no_checkable_claims' WHEN len(missing) > 0 THEN 'ungrounded_specifics' ELSE 'grounded' END"
_add("flt08_groundedness", lambda s, d: grounded_of(s, d).select("qid", F.col("g.checked").cast("long").alias("checked"), F.col("g.n_unsupported").cast("long").alias("n_unsupported"), "g.reason"), _GR + f"SELECT qid, checked, len(missing) AS n_unsupported, {_REASON} AS reason FROM gr")
_add("top06_unsupported", lambda s, d: grounded_of(s, d).select("qid", F.array_join("g.unsupported", "|").alias("unsupported")), _GR + "SELECT qid, coalesce(array_to_string(missing[1:10], '|'), '') AS unsupported FROM gr")
_add("j07_missing_tokens", lambda s, d: grounded_of(s, d).select("qid", F.explode("g.unsupported").alias("token")), _GR + "SELECT qid, unnest(missing[1:10]) AS token FROM gr")
_GATES = f"CASE WHEN {_scope_sql('b.text')} <> 'in_scope' THEN 'scope' WHEN term_hits = 0 THEN 'vocabulary' WHEN gate_score < CAST(0.8167 AS DOUBLE) THEN 'score' ELSE 'reaches_generation' END"


def gated_of(s, d):
    results = hits_of(s, d)[1].join(items_of(s, d).withColumnRenamed("item_id", "qid"), "qid")
    return results.select("qid", guardrails.first_gate(F.col("text"), F.col("term_hits"), F.col("gate_score")).alias("first_gate"))


_add("flt10_first_gate", gated_of, HITS + f"SELECT b.item_id AS qid, {_GATES} AS first_gate FROM benchmark b JOIN gate ON gate.qid = b.item_id JOIN overlap ON overlap.qid = b.item_id")
_add("j12_memoised_cases", lambda s, d: answer.memoised(_user(s, d), "text", lambda x: x.select("text", guardrails.scope(F.col("text")).alias("verdict"))).select("conv_id", "turn", "verdict"), f"SELECT conv_id, turn, {_scope_sql('text')} AS verdict FROM {CONV}")
_DECIDE = f"CASE WHEN {_scope_sql('b.text')} <> 'in_scope' THEN {_scope_sql('b.text')} WHEN term_hits = 0 THEN 'no_corpus_vocabulary' WHEN gate_score < CAST(0.8167 AS DOUBLE) THEN 'below_retrieval_threshold' ELSE '' END"
_add("udf09_decision", lambda s, d: answer.ask(docs_of(s, d), items_of(s, d)).select("qid", "mode", "answered", F.coalesce("refusal_reason", F.lit("")).alias("refusal_reason")), HITS + f"SELECT qid, CASE WHEN r = '' THEN 'extractive' ELSE 'refused' END AS mode, r = '' AS answered, r AS refusal_reason FROM (SELECT b.item_id AS qid, {_DECIDE} AS r FROM benchmark b JOIN gate ON gate.qid = b.item_id JOIN overlap ON overlap.qid = b.item_id)")
_RESPONSES = HITS + f"""SELECT qid, '{{"mode":"' || CASE WHEN r = '' THEN 'extractive","answered":true' ELSE 'refused","answered":false,"refusal_reason":"' || r || '"' END || ',"citations":[' || CASE WHEN s <> 'in_scope' OR r = 'no_corpus_vocabulary' THEN '' ELSE coalesce(ids, '') END || ']}}' AS response
FROM (SELECT b.item_id AS qid, {_DECIDE} AS r, {_scope_sql('b.text')} AS s, (SELECT string_agg(h.doc_id, ',' ORDER BY h.rank) FROM hits h WHERE h.qid = b.item_id) AS ids FROM benchmark b JOIN gate ON gate.qid = b.item_id JOIN overlap ON overlap.qid = b.item_id)"""
_add("snk07_responses", lambda s, d: answer.ask(docs_of(s, d), items_of(s, d)).select("qid", F.to_json(F.struct("mode", "answered", "refusal_reason", "citations")).alias("response")), _RESPONSES)
_ERR = "CASE WHEN user_id % 7 = 0 THEN 429 WHEN user_id % 7 = 1 THEN 503 WHEN user_id % 7 = 2 THEN 401 WHEN user_id % 7 = 3 THEN 404 END"
_add("udf06_error_kinds", lambda s, d: table(s, d, "events").select("event_id", guardrails.error_kind(F.expr(_ERR), F.when(F.col("user_id") % 7 == 4, F.lit("Deadline exceeded")).when(F.col("user_id") % 7 == 5, F.lit("Quota hit")).otherwise(F.lit("x"))).alias("k")).groupBy("k.kind", "k.retryable").agg(F.count("*").alias("n")), f"SELECT kind, kind IN ('rate_limited', 'server_error', 'timeout') AS retryable, count(*) AS n FROM (SELECT CASE WHEN user_id % 7 IN (0, 5) THEN 'rate_limited' WHEN user_id % 7 = 1 THEN 'server_error' WHEN user_id % 7 = 4 THEN 'timeout' WHEN user_id % 7 = 2 THEN 'client_error' ELSE 'unknown_error' END AS kind FROM events) GROUP BY 1, 2")
_add("udf01_passage_embedding", lambda s, d: dense.embed(docs_of(s, d).select("doc_id", "text"), answer.hashing_embedder()).select("doc_id", F.size("embedding").alias("dim"), F.round(t.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm")), f"SELECT doc_id, 64 AS dim, CASE WHEN {q.strip("coalesce(text, '')")} = '' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS norm FROM documents")
_add("udf02_query_embedding", lambda s, d: dense.embed(items_of(s, d), answer.hashing_embedder("query: ")).select("item_id", F.size("embedding").alias("dim"), F.round(t.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm")), "SELECT item_id, 64 AS dim, CAST(1 AS DOUBLE) AS norm FROM benchmark")
_add("udf04_generation", lambda s, d: answer.generate(answer.prompts(hits_of(s, d)[0], corpus.corpus(table(s, d, "documents")), items_of(s, d)), answer.first_passage).drop("error", "cited_doc_ids", "confidence"), HITS + "SELECT qid, true AS ok, true AS answerable, coalesce(text, '') AS answer FROM hits JOIN documents USING (doc_id) WHERE rank = 1")

# Chunks: the same path over the engine's own chunks, found by string ids, collapsed to their documents and read by context.
CHUNKED = f"""{q.PC}, chunked AS (SELECT chunk_id AS doc_id, embed_text AS text, CAST(doc_id AS VARCHAR) AS source, context_text FROM pc)"""
CHUNK_HITS = f"WITH {CHUNKED}, {q.HITS.replace('documents', 'chunked')} "


def passages_of(s, d):
    """Child chunks, cut once and written, without the texts of their documents."""
    return kept(retrieve.passages(chunking.parent_child(corpus.corpus(table(s, d, "documents"))), context=False), "passages")


def parents_of(s, d):
    return corpus.corpus(table(s, d, "documents")).select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text")


def chunk_hits_of(s, d):
    return retrieve.retrieve(passages_of(s, d), items_of(s, d))


def _chunk_contexts(s, d):
    return answer.contexts(chunk_hits_of(s, d)[0].withColumn("doc_id", F.col("parent")), parents_of(s, d))


def _chunk_answers(s, d):
    return answer.ask(passages_of(s, d), items_of(s, d), read=parents_of(s, d))


_add("top04_chunk_hits", lambda s, d: chunk_hits_of(s, d)[0].select("qid", *_long("rank"), "doc_id", "parent", "score", "lex"), CHUNK_HITS + "SELECT qid, rank, doc_id, parent, score, lex FROM hits")
_add("j02_chunk_contexts", lambda s, d: _chunk_contexts(s, d).select("qid", F.array_join("ids", ",").alias("cited"), F.md5(F.array_join("contexts", "|").cast("binary")).alias("contexts")), CHUNK_HITS + "SELECT qid, string_agg(parent, ',' ORDER BY rank) AS cited, md5(string_agg(context_text, '|' ORDER BY rank)) AS contexts FROM hits JOIN chunked USING (doc_id) GROUP BY qid")
_CHUNK_DECIDED = f"""(SELECT b.item_id AS qid, {_DECIDE} AS r, {_scope_sql('b.text')} AS s FROM benchmark b JOIN gate ON gate.qid = b.item_id JOIN overlap ON overlap.qid = b.item_id)"""
_add("udf09_chunk_answers", lambda s, d: _chunk_answers(s, d).select("qid", "mode", "answered", F.coalesce("refusal_reason", F.lit("")).alias("refusal_reason"), F.array_join("citations", ",").alias("citations"), F.md5(F.coalesce("answer", F.lit("")).cast("binary")).alias("answer")), CHUNK_HITS + f"""SELECT qid, CASE WHEN r = '' THEN 'extractive' ELSE 'refused' END AS mode, r = '' AS answered, r AS refusal_reason,
 CASE WHEN s <> 'in_scope' OR r = 'no_corpus_vocabulary' THEN '' ELSE coalesce((SELECT string_agg(h.parent, ',' ORDER BY h.rank) FROM hits h WHERE h.qid = x.qid), '') END AS citations,
 md5(CASE WHEN r = '' THEN (SELECT c.context_text FROM hits h JOIN chunked c USING (doc_id) WHERE h.qid = x.qid AND h.rank = 1) ELSE '' END) AS answer FROM {_CHUNK_DECIDED} x""")
_CHUNK_CTX = f"""{CHUNK_HITS}, ctx AS (SELECT h.qid, list(context_text ORDER BY rank) AS contexts FROM hits h JOIN chunked USING (doc_id) GROUP BY h.qid), {_MISS} """


def _chunk_grounded(s, d):
    x = _chunk_contexts(s, d).join(items_of(s, d).withColumnRenamed("item_id", "qid"), "qid")
    return x.select("qid", guardrails.grounded(F.col("text"), F.col("contexts")).alias("g")).select("qid", F.col("g.checked").cast("long").alias("checked"), F.col("g.n_unsupported").cast("long").alias("n_unsupported"), "g.reason")


_add("flt08_chunk_groundedness", _chunk_grounded, _CHUNK_CTX + f"SELECT qid, checked, len(missing) AS n_unsupported, {_REASON} AS reason FROM gr")

# Cases that ask the same are answered once.
ASKED = f"asked AS (SELECT DISTINCT md5(text) AS item_id, text FROM {CONV})"


def _memoised(s, d):
    def contexts(keys):
        hits = retrieve.retrieve(docs_of(s, d), keys.select(F.md5(F.col("text").cast("binary")).alias("item_id"), "text"))[0]
        # What is asked for are the ids: no text is shuffled with the hits.
        cited = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))).alias("k"))
        found = cited.select("qid", F.array_join("k.doc_id", ",").alias("ids"))
        return keys.withColumn("qid", F.md5(F.col("text").cast("binary"))).join(found, "qid").select("text", "ids")

    return answer.memoised(_user(s, d), "text", contexts).select("conv_id", "turn", "ids")


_add("j12_memoised_contexts", _memoised, f"WITH {ASKED}, {q.HITS.replace('benchmark', 'asked')}, ids AS (SELECT qid, string_agg(doc_id, ',' ORDER BY rank) AS ids FROM hits GROUP BY qid) SELECT conv_id, turn, ids FROM {CONV} c JOIN ids ON ids.qid = md5(c.text)")
