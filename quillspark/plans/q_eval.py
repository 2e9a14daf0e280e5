"""Queries over evaluation: metrics of the rankers, calibration, AUC, bootstrap, paired comparison and rollups.

A benchmark item's gold documents are those that hold its whole text; items without any must be refused.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as t
from quillspark.operators import answer, corpus, dense, latency, lexical, reports, retrieve
from quillspark.operators import evaluate as e
from quillspark.sources.files import kept, scratch
from quillspark.sources.tables import table

from . import q_retrieval as r
from . import sql as q

QUERIES, ORACLES = {}, {}


def _add(name, build, oracle=None):
    QUERIES[name] = build
    if oracle:
        ORACLES[name] = oracle


def gold_of(s, d):
    items = table(s, d, "benchmark")
    asked = items.select(F.col("item_id").alias("qid"), "text")
    found = corpus.holding(table(s, d, "documents").select("doc_id", "text"), asked).groupBy("qid").agg(F.array_sort(F.collect_list("doc_id")).alias("g"))
    k = F.col("item_id") % 3
    rows = items.select(F.col("item_id").alias("qid"), F.when(k == 0, "a").when(k == 1, "b").otherwise("c").alias("category")).join(found, "qid", "left")
    return rows.select("qid", "category", F.coalesce("g", F.array().cast("array<bigint>")).alias("gold"), F.when(F.col("g").isNull(), "refuse").otherwise("answer").alias("expect"))


def _hits(s, d):
    return dense.top_k(r._bm25(s, d, 5), 5, "doc_id").drop("n_terms").withColumnRenamed("doc_id", "got")


def _ranks(s, d):
    return e.first_gold_rank(_hits(s, d), gold_of(s, d))


TOP = f"{q.BM25}, hits AS (SELECT qid, doc_id AS got, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 5), {q.GOLD}"
RANK = f"{TOP}, ranks AS (SELECT e.qid, category, expect, coalesce(min(rank) FILTER (list_contains(gold, got)), 0) AS rank FROM evalq e LEFT JOIN hits h USING (qid) GROUP BY ALL)"
QUALITY = "count(*) AS n, round(avg(CAST(rank > 0 AS DOUBLE)), 4) AS recall, round(avg(CAST(rank = 1 AS DOUBLE)), 4) AS prec1, round(avg(CASE WHEN rank > 0 THEN 1 / CAST(rank AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS mrr"
_add("flt11_populations", lambda s, d: gold_of(s, d).groupBy("expect").agg(F.count("*").alias("n")), f"WITH {q.GOLD} SELECT expect, count(*) AS n FROM evalq GROUP BY expect")
_add("j06_hits_gold", lambda s, d: _hits(s, d).join(gold_of(s, d), "qid").select("qid", F.col("rank").cast("long").alias("rank"), F.array_contains("gold", F.col("got")).alias("is_gold")), f"WITH {TOP} SELECT qid, rank, list_contains(gold, got) AS is_gold FROM hits JOIN evalq USING (qid)")
_add("win06_first_gold_rank", lambda s, d: _ranks(s, d).select("qid", "category", "expect", F.col("rank").cast("long").alias("rank"), "hit"), f"WITH {RANK} SELECT qid, category, expect, rank, rank > 0 AS hit FROM ranks")
_add("agg10_quality", lambda s, d: e.quality(_ranks(s, d)), f"WITH {RANK} SELECT {QUALITY} FROM ranks WHERE expect = 'answer'")
_add("agg11_by_category", lambda s, d: e.quality(_ranks(s, d), "category"), f"WITH {RANK} SELECT category, {QUALITY} FROM ranks WHERE expect = 'answer' GROUP BY category")
_ATT = f"WITH {TOP}, a AS (SELECT got, count(*) AS n_first, count(*) FILTER (NOT list_contains(gold, got)) AS n_wrong, round(count(*) / CAST((SELECT count(*) FROM evalq) AS DOUBLE), 4) AS share FROM hits JOIN evalq USING (qid) WHERE rank = 1 GROUP BY got) SELECT * FROM a"
_add("agg13_attractors", lambda s, d: e.attractors(_hits(s, d), gold_of(s, d)), _ATT)
_add("flt12_attractors", lambda s, d: e.attractors(_hits(s, d), gold_of(s, d), e.ATTRACTOR_MIN), _ATT + " WHERE n_first >= 3")
_add("top05_attractor_order", lambda s, d: e.attractors(_hits(s, d), gold_of(s, d)).orderBy(F.col("n_first").desc(), "got").select("got", "n_first"), _ATT.replace("SELECT * FROM a", "SELECT got, n_first FROM a"))
_add("agg25_covers_all_gold", lambda s, d: _hits(s, d).groupBy("qid").agg(F.collect_set("got").alias("k")).join(gold_of(s, d), "qid").select("qid", (F.size(F.array_except("gold", "k")) == 0).alias("covers")), f"WITH {TOP} SELECT qid, len(list_filter(any_value(gold), lambda x: NOT list_contains(list(got), x))) = 0 AS covers FROM hits JOIN evalq USING (qid) GROUP BY qid".replace("any_value(gold), lambda x: NOT list_contains(list(got), x)", "g, lambda x: NOT list_contains(k, x)").replace("FROM hits JOIN evalq USING (qid) GROUP BY qid", "FROM (SELECT qid, any_value(gold) AS g, list(got) AS k FROM hits JOIN evalq USING (qid) GROUP BY qid)"))

# Percentiles of event values.
_IDX = "greatest(0, least(n - 1, CAST(round_even(CAST({p} AS DOUBLE) * n + CAST(0.5 AS DOUBLE), 0) AS BIGINT) - 1))"
_EV = "WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) "
_add("agg12_percentiles", lambda s, d: e.percentile(table(s, d, "events"), "value", 50, "event_type").withColumnRenamed("value", "p50").join(e.percentile(table(s, d, "events"), "value", 95, "event_type").withColumnRenamed("value", "p95"), "event_type").join(e.percentile(table(s, d, "events"), "value", 100, "event_type").withColumnRenamed("value", "p100"), "event_type").join(e.middle(table(s, d, "events"), "value", "event_type").withColumnRenamed("value", "middle"), "event_type"), _EV + f"SELECT event_type, max(value) FILTER (i = {_IDX.format(p='0.5')}) AS p50, max(value) FILTER (i = {_IDX.format(p='0.95')}) AS p95, max(value) AS p100, max(value) FILTER (i = n // 2) AS middle FROM v GROUP BY event_type")


def _samples(s, d):
    """Three timed turns of two stages and their total; times differ from run to run, how many there are does not.

    What is timed is the scoring of all questions: the documents' terms are counted and written once, before any turn.
    """
    index = lexical.counted(r.docs_of(s, d), r.items_of(s, d))
    stages = {"lexical": lambda: lexical.bm25(index), "dense": lambda: r._scored(s, d, 5)}
    timed = latency.samples(s, stages, repeats=3)
    return timed.groupBy("stage").agg(F.count("*").alias("n"), (F.min("ms") > 0).alias("positive"))


_add("har01_latency_samples", _samples, "SELECT * FROM (VALUES ('dense', 3, true), ('lexical', 3, true), ('total', 3, true)) t(stage, n, positive)")



def _stage_report(s, d):
    """Three passes of all items through the whole path, each a micro-batch; what stages take differs from run to run."""
    index = retrieve.build_index(r.docs_of(s, d))
    run = lambda batch, timings: answer.ask(r.docs_of(s, d), batch, index=index, timings=timings)
    found = latency.report(latency.micro_batches(s, [r.items_of(s, d)] * 3, run))
    return found.select("stage", "n", ((F.col("p50") > 0) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("max"))).alias("ordered"))


_add("har01_stage_report", _stage_report)

# Calibration: document quality labels against a length signal.
LAB = "lab AS (SELECT l.doc_id, l.quality = 1 AS pos, l.toxic = 1 AS toxic, round(least(CAST(1 AS DOUBLE), length(coalesce(d.text, '')) / CAST(5000 AS DOUBLE)), 4) AS v FROM labels l JOIN documents d USING (doc_id))"


def labelled(s, d):
    docs = table(s, d, "documents").select("doc_id", F.round(F.least(F.lit(1.0), F.length(F.coalesce("text", F.lit(""))) / 5000.0), 4).alias("v"))
    return table(s, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") == 1).alias("pos"), "v")


def _table(s, d):
    return e.value_table(labelled(s, d), "v", F.col("pos"))


_AUC = f"WITH {LAB} SELECT round(avg(CASE WHEN a.v > b.v THEN CAST(1 AS DOUBLE) WHEN a.v = b.v THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS auc FROM lab a, lab b WHERE a.pos AND NOT b.pos"
_add("agg19_auc", lambda s, d: e.auc(_table(s, d)), _AUC)
_add("j08_positives_by_negatives", lambda s, d: e.pair_counts(_table(s, d)), f"WITH {LAB} SELECT count(*) FILTER (a.v > b.v) AS won, count(*) FILTER (a.v = b.v) AS tied, count(*) FILTER (a.v < b.v) AS lost FROM lab a, lab b WHERE a.pos AND NOT b.pos")
SWEEP = f"{LAB}, vals AS (SELECT DISTINCT v FROM lab), mid AS (SELECT (v + nx) / 2 AS cutoff FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM vals) WHERE nx IS NOT NULL), sw AS (SELECT cutoff, count(*) FILTER (pos AND v >= cutoff) AS kept, count(*) FILTER (NOT pos AND v < cutoff) AS blocked, count(*) FILTER (pos) AS of_pos, count(*) FILTER (NOT pos) AS of_neg FROM mid, lab GROUP BY cutoff)"
_sweep = lambda s, d: e.sweep(_table(s, d)).select("cutoff", "kept", "blocked")
_add("j10_scores_by_cutoffs", _sweep, f"WITH {SWEEP} SELECT cutoff, kept, blocked FROM sw")
_add("win07_midpoints", lambda s, d: e.sweep(_table(s, d)).select("cutoff"), f"WITH {SWEEP} SELECT cutoff FROM mid")
_BEST = "SELECT round(cutoff, 4) AS cutoff, round((kept + blocked) / CAST(of_pos + of_neg AS DOUBLE), 4) AS accuracy, kept, blocked, of_pos - kept AS false_refusals, of_neg - blocked AS hallucination_risk FROM {} ORDER BY round((kept + blocked) / CAST(of_pos + of_neg AS DOUBLE), 10) DESC, {}.cutoff LIMIT 1"
_add("agg17_best_cutoff", lambda s, d: e.best_cutoff(e.sweep(_table(s, d))), f"WITH {SWEEP} " + _BEST.format("sw", "sw"))
COARSE = f"{LAB}, sw AS (SELECT i / CAST(100 AS DOUBLE) AS cutoff, count(*) FILTER (pos AND v >= i / CAST(100 AS DOUBLE)) AS kept, count(*) FILTER (NOT pos AND v < i / CAST(100 AS DOUBLE)) AS blocked, count(*) FILTER (pos) AS of_pos, count(*) FILTER (NOT pos) AS of_neg FROM (SELECT unnest(range(20, 96)) AS i), lab GROUP BY i)"
_add("agg16_coarse_sweep", lambda s, d: e.coarse_sweep(_table(s, d)), f"WITH {COARSE} SELECT * FROM sw")
_add("agg16_coarse_best", lambda s, d: e.best_cutoff(e.coarse_sweep(_table(s, d))), f"WITH {COARSE} " + _BEST.format("sw", "sw"))
POINTS = f"{SWEEP}, pts AS (SELECT round(min(cutoff), 4) AS cutoff, kept, of_pos, blocked, of_neg, of_neg - blocked AS leaks FROM sw GROUP BY kept, blocked, of_pos, of_neg)"
_add("agg18_operating_points", lambda s, d: e.operating_points(e.sweep(_table(s, d))), f"WITH {POINTS} SELECT * FROM pts")
_add("flt13_least_leaks", lambda s, d: e.least_leaks(e.operating_points(e.sweep(_table(s, d))), labelled(s, d).where("not pos")), f"WITH {POINTS} SELECT coalesce(min(leaks) FILTER (kept >= of_pos * CAST(0.95 AS DOUBLE)), (SELECT count(*) FROM lab WHERE NOT pos)) AS min_leaks FROM pts")


def _leaks(s, d):
    cut = e.best_cutoff(e.sweep(_table(s, d))).select("cutoff")
    return labelled(s, d).where("not pos").crossJoin(F.broadcast(cut)).where("v >= cutoff").select("doc_id", "v")


_add("flt16_leaks", _leaks, f"WITH {SWEEP}, b AS ({_BEST.format('sw', 'sw')}) SELECT doc_id, v FROM lab, b WHERE NOT pos AND v >= b.cutoff")
_SUM = "WITH " + LAB + ", p AS (SELECT v, pos, row_number() OVER (PARTITION BY pos ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY pos) AS n FROM lab) "


def _summary(s, d):
    pos, neg = labelled(s, d).where("pos"), labelled(s, d).where("not pos")
    a = pos.agg(F.min("v").alias("answer_min"), F.round(F.median("v"), 4).alias("answer_median"))
    b = neg.agg(F.round(F.median("v"), 4).alias("refuse_median"), F.max("v").alias("refuse_max"))
    p10 = e.percentile(pos, "v", 10).withColumnRenamed("value", "answer_p10")
    p90 = e.percentile(neg, "v", 90).withColumnRenamed("value", "refuse_p90")
    return a.crossJoin(b).crossJoin(p10).crossJoin(p90).withColumn("separation", F.round(F.col("answer_min") - F.col("refuse_max"), 4))


_add("agg20_populations", _summary, _SUM + f"SELECT min(v) FILTER (pos) AS answer_min, round(median(v) FILTER (pos), 4) AS answer_median, round(median(v) FILTER (NOT pos), 4) AS refuse_median, max(v) FILTER (NOT pos) AS refuse_max, max(v) FILTER (pos AND i = {_IDX.format(p='0.1')}) AS answer_p10, max(v) FILTER (NOT pos AND i = {_IDX.format(p='0.9')}) AS refuse_p90, round(min(v) FILTER (pos) - max(v) FILTER (NOT pos), 4) AS separation FROM p")
SIG = r.VEC + ", h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5), f AS (SELECT qid, max(score) FILTER (rank = 1) AS top1, max(score) FILTER (rank = 2) AS second, avg(score) FILTER (rank > 1) AS rest, max(score) AS high, min(score) AS low FROM h GROUP BY qid), sig AS (SELECT qid, round(top1, 4) + 0 AS top1, round(top1 - coalesce(second, top1), 4) + 0 AS margin_12, round(top1 - coalesce(rest, top1), 4) + 0 AS margin_1k, round(CASE WHEN coalesce(rest, top1) <> 0 THEN top1 / coalesce(rest, top1) ELSE CAST(0 AS DOUBLE) END, 4) + 0 AS ratio_1k, round(high - low, 4) + 0 AS spread FROM f) "


def _signals(s, d):
    return e.signals(dense.top_k(r._scored(s, d, 5), 5))


_add("mth08_signals", _signals, SIG + "SELECT * FROM sig")
_add("mth09_rounding", lambda s, d: table(s, d, "events").select("event_id", F.round("value", 4).alias("rounded")), "SELECT event_id, round(value, 4) AS rounded FROM events")


def _signal_aucs(s, d):
    long = _signals(s, d).unpivot("qid", e.SIGNALS, "signal", "v")
    return e.auc(e.value_table(long, "v", F.col("qid") % 40 == 0, "signal"), "signal")


_SIGAUC = SIG + ", l AS (" + " UNION ALL ".join(f"SELECT qid, '{x}' AS signal, {x} AS v FROM sig" for x in e.SIGNALS) + "), au AS (SELECT a.signal, round(avg(CASE WHEN a.v > b.v THEN CAST(1 AS DOUBLE) WHEN a.v = b.v THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 4) AS auc FROM l a JOIN l b ON a.signal = b.signal WHERE a.qid % 40 = 0 AND b.qid % 40 <> 0 GROUP BY a.signal) "
_add("agg19_signal_aucs", _signal_aucs, _SIGAUC + "SELECT * FROM au")
_SIGACC = """, mids AS (SELECT signal, (v + nx) / 2 AS cutoff FROM (SELECT signal, v, lead(v) OVER (PARTITION BY signal ORDER BY v) AS nx FROM (SELECT DISTINCT signal, v FROM l)) WHERE nx IS NOT NULL),
 lone AS (SELECT signal, count(*) FILTER (qid % 40 = 0) / CAST(count(*) AS DOUBLE) AS a FROM l GROUP BY signal HAVING count(DISTINCT v) = 1),
 points AS (SELECT signal, cutoff, count(*) FILTER (qid % 40 = 0 AND v >= cutoff) + count(*) FILTER (qid % 40 <> 0 AND v < cutoff) AS ok, count(*) AS n FROM mids JOIN l USING (signal) GROUP BY signal, cutoff),
 acc AS (SELECT signal, round(max(ok / CAST(n AS DOUBLE)), 4) AS accuracy FROM points GROUP BY signal UNION ALL SELECT signal, round(a, 4) FROM lone) """


def _best_signal(s, d):
    long = _signals(s, d).unpivot("qid", e.SIGNALS, "signal", "v")
    values = e.value_table(long, "v", F.col("qid") % 40 == 0, "signal")
    return e.best_signal(e.auc(values, "signal"), e.best_cutoff(e.sweep(values, "signal"), "signal"))


_add("agg27_best_signal", _best_signal, _SIGAUC + _SIGACC + "SELECT signal, auc, accuracy FROM au JOIN acc USING (signal) ORDER BY auc DESC, accuracy DESC, signal DESC LIMIT 1")

# Rankers compared over collapsed parents.
FAMILY = f"""{q.RANKS}, m AS (SELECT *, min(dense) OVER w AS d0, max(dense) OVER w AS d1, min(lex) OVER w AS l0, max(lex) OVER w AS l1 FROM ranks WINDOW w AS (PARTITION BY qid)),
s01 AS (SELECT *, CASE WHEN d1 > d0 THEN (dense - d0) / (d1 - d0) ELSE CAST(0 AS DOUBLE) END AS d01, CASE WHEN l1 > l0 THEN (lex - l0) / (l1 - l0) ELSE CAST(0 AS DOUBLE) END AS l01 FROM m),
fam AS (SELECT qid, doc_id, parent, 'dense' AS ranker, dense AS f FROM s01 UNION ALL SELECT qid, doc_id, parent, 'bm25', lex FROM s01
 UNION ALL SELECT qid, doc_id, parent, 'rrf_10', round(1 / CAST(10 + rd AS DOUBLE) + 1 / CAST(10 + rl AS DOUBLE), 9) FROM s01 UNION ALL SELECT qid, doc_id, parent, 'rrf_60', round(1 / CAST(60 + rd AS DOUBLE) + 1 / CAST(60 + rl AS DOUBLE), 9) FROM s01
 {' '.join(f"UNION ALL SELECT qid, doc_id, parent, 'alpha_{a}', round(CAST({a} AS DOUBLE) * d01 + (CAST(1 AS DOUBLE) - CAST({a} AS DOUBLE)) * l01, 6) FROM s01" for a in retrieve.ALPHAS)}),
fr AS (SELECT *, row_number() OVER (PARTITION BY ranker, qid ORDER BY f DESC, doc_id) AS r FROM fam), fk AS (SELECT *, row_number() OVER (PARTITION BY ranker, qid, parent ORDER BY r) AS k FROM fr WHERE r <= 20),
fh AS (SELECT ranker, qid, doc_id AS got, row_number() OVER (PARTITION BY ranker, qid ORDER BY r) AS rank FROM fk WHERE k = 1 QUALIFY rank <= 5), {q.GOLD},
frank AS (SELECT n.ranker, e.qid, category, expect, coalesce(min(rank) FILTER (list_contains(gold, got)), 0) AS rank FROM evalq e CROSS JOIN (SELECT DISTINCT ranker FROM fam) n LEFT JOIN fh h ON h.qid = e.qid AND h.ranker = n.ranker GROUP BY ALL)"""


def family_ranks(s, d):
    """ranker, qid, expect, rank: each ranker's first gold rank, from the few candidates that may be its first."""
    few = retrieve.family(retrieve.build_index(r.docs_of(s, d)), r.items_of(s, d))
    gold, out = kept(gold_of(s, d), "gold"), None
    for name in RANKERS:
        hits = retrieve.collapse(few.where(F.col("ranker") == name), F.col("f")).withColumnRenamed("doc_id", "got").drop("ranker")
        one = e.first_gold_rank(hits, gold).withColumn("ranker", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


_add("har02_ranker_family", lambda s, d: e.quality(family_ranks(s, d), "ranker"), f"WITH {FAMILY} SELECT ranker, {QUALITY} FROM frank WHERE expect = 'answer' GROUP BY ranker")
_PAIRED = f"WITH {FAMILY} SELECT v.ranker, count(*) FILTER (v.rank = 1 AND b.rank <> 1) AS fixed, count(*) FILTER (v.rank <> 1 AND b.rank = 1) AS broken, count(*) FILTER (v.rank = 1 AND b.rank <> 1) - count(*) FILTER (v.rank <> 1 AND b.rank = 1) AS net FROM frank v JOIN frank b ON v.qid = b.qid AND b.ranker = 'dense' WHERE v.ranker <> 'dense' AND v.expect = 'answer' GROUP BY v.ranker"
_add("agg22_paired", lambda s, d: e.paired(family_ranks(s, d), "dense"), _PAIRED)
_add("j11_paired_join", lambda s, d: e.side_by_side(family_ranks(s, d), "dense"), f"WITH {FAMILY} SELECT v.ranker, v.qid, v.rank = 1 AS ok, b.rank = 1 AS base_ok FROM frank v JOIN frank b ON v.qid = b.qid AND b.ranker = 'dense' WHERE v.ranker <> 'dense' AND v.expect = 'answer'")
RANKERS = ["dense", "bm25", "rrf_10", "rrf_60", *(f"alpha_{a}" for a in retrieve.ALPHAS)]


def _best_ranker(s, d):
    """Of equal precision the ranker of the least cost wins; the cost here is its place in the family, not a time."""
    cost = F.array_position(F.array(*[F.lit(x) for x in RANKERS]), F.col("ranker"))
    results = e.quality(family_ranks(s, d), "ranker").withColumn("cost", cost)
    return e.best_ranker(results, "cost", "prec1").select("ranker", "prec1", "recall")


_add("agg26_best_ranker", _best_ranker, f"WITH {FAMILY}, z AS (SELECT ranker, {QUALITY} FROM frank WHERE expect = 'answer' GROUP BY ranker) SELECT ranker, prec1, recall FROM z ORDER BY prec1 DESC, list_position({RANKERS}, ranker) LIMIT 1")
BOOT = f"""WITH {RANK}, o AS (SELECT CAST(rank = 1 AS DOUBLE) AS x, row_number() OVER (ORDER BY qid) - 1 AS i, count(*) OVER () AS n FROM ranks WHERE expect = 'answer'),
dr AS (SELECT b, CAST('0x' || substr(md5(b || ':' || j), 1, 8) AS BIGINT) % n AS i FROM (SELECT b, n, unnest(range(n)) AS j FROM (SELECT unnest(range(2000)) AS b), (SELECT DISTINCT n FROM o))),
bm2 AS (SELECT b, round(avg(x), 9) AS m FROM dr JOIN o USING (i) GROUP BY b), ord AS (SELECT m, row_number() OVER (ORDER BY m, b) AS r FROM bm2)
SELECT 'bm25' AS ranker, (SELECT round(avg(x), 4) FROM o) AS mean, max(round(m, 4)) FILTER (r = 51) AS low, max(round(m, 4)) FILTER (r = 1951) AS high FROM ord"""


def _outcomes(s, d):
    return _ranks(s, d).where("expect = 'answer'").select(F.lit("bm25").alias("ranker"), "qid", (F.col("rank") == 1).cast("int").alias("ok"))


_add("agg21_bootstrap", lambda s, d: e.bootstrap(_outcomes(s, d), "ok", "ranker", "qid"), BOOT)
_add("j13_resamples", lambda s, d: e.resampled(_outcomes(s, d), "ok", "ranker", "qid"), BOOT.split(", ord AS")[0] + " SELECT 'bm25' AS ranker, b, m FROM bm2")
#: Hits of a resample by one draw each: the chances of their number, from ratios of neighbouring weights.
BY_COUNTS = f"""WITH {RANK}, z AS (SELECT 'bm25' AS ranker, count(*) AS n, CAST(coalesce(sum(CAST(rank = 1 AS INTEGER)), 0) AS BIGINT) AS hits FROM ranks WHERE expect = 'answer' HAVING count(*) > 0),
sp AS (SELECT *, CAST(ceil(12 * sqrt(hits * (1 - hits / CAST(n AS DOUBLE))) + 12) AS BIGINT) AS d FROM z),
ks AS (SELECT ranker, n, hits, unnest(CASE WHEN hits > 0 AND hits < n THEN range(greatest(0, hits - d), least(n, hits + d) + 1) ELSE [hits] END) AS k FROM sp),
lg AS (SELECT *, sum(CASE WHEN first THEN CAST(0 AS DOUBLE) ELSE ln((n - k + 1) / CAST(k AS DOUBLE) * (hits / CAST(n - hits AS DOUBLE))) END) OVER (PARTITION BY ranker ORDER BY k) AS l FROM (SELECT *, row_number() OVER (PARTITION BY ranker ORDER BY k) = 1 AS first FROM ks)),
wt AS (SELECT *, exp(l - max(l) OVER (PARTITION BY ranker)) AS x FROM lg),
cd AS (SELECT ranker, n, k, sum(x) OVER (PARTITION BY ranker ORDER BY k) / sum(x) OVER (PARTITION BY ranker) AS cdf FROM wt),
gr AS (SELECT ranker, any_value(n) AS n, min(k) AS low, max(k) AS high FROM cd GROUP BY ranker),
dw AS (SELECT *, (CAST('0x' || substr(md5(b || ':' || ranker), 1, 12) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u FROM gr, (SELECT unnest(range(2000)) AS b)),
rs AS (SELECT ranker, b, round(least(low + (SELECT count(*) FROM cd WHERE cd.ranker = dw.ranker AND cd.cdf < dw.u), high) / CAST(n AS DOUBLE), 9) AS m FROM dw)"""
_add("j13_resamples_by_counts", lambda s, d: e.resampled_by_counts(_outcomes(s, d), "ok", "ranker"), BY_COUNTS + " SELECT ranker, b, m FROM rs")
_add("agg21_bootstrap_by_counts", lambda s, d: e.bootstrap_by_counts(_outcomes(s, d), "ok", "ranker"), BY_COUNTS + ", ord AS (SELECT m, row_number() OVER (ORDER BY m, b) AS r FROM rs) SELECT 'bm25' AS ranker, (SELECT round(hits / CAST(n AS DOUBLE), 4) FROM z) AS mean, max(round(m, 4)) FILTER (r = 51) AS low, max(round(m, 4)) FILTER (r = 1951) AS high FROM ord")
_CASES = f"""WITH {q.HITS}, cs AS (SELECT g.qid AS id, g.qid % 5 = 0 AS known_limit, CASE WHEN g.qid % 2 = 0 THEN 'pass' ELSE 'block' END AS expect, {r._GATES} AS first_gate FROM benchmark b JOIN gate g ON g.qid = b.item_id JOIN overlap o ON o.qid = b.item_id),
cc AS (SELECT *, (first_gate = 'reaches_generation') = (expect = 'pass') AS correct FROM cs)
SELECT count(*) FILTER (NOT known_limit) AS scored, count(*) FILTER (NOT known_limit AND correct) AS passed, count(*) FILTER (known_limit) AS limits, count(*) FILTER (NOT known_limit AND NOT correct) AS regressions, count(*) FILTER (known_limit AND correct) AS limits_passing, count(*) FILTER (first_gate <> 'reaches_generation') AS blocked_earlier, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (NOT known_limit AND NOT correct), '') AS regressed FROM cc"""


def _cases(s, d):
    x = r.gated_of(s, d).select(F.col("qid").alias("id"), (F.col("qid") % 5 == 0).alias("known_limit"), "first_gate", F.when(F.col("qid") % 2 == 0, "pass").otherwise("block").alias("expect"))
    return x.withColumn("correct", (F.col("first_gate") == "reaches_generation") == (F.col("expect") == "pass"))


_add("agg23_rollup", lambda s, d: e.rollup(_cases(s, d)), _CASES)


def _report(s, d):
    """The guardrail report, written and read again."""
    cases = _cases(s, d)
    path = scratch(s, "report")
    reports.write_report(s, path, reports.guardrail_report(cases, e.rollup(cases), strategy="documents"))
    found = reports.read_report(s, path)
    row = (found["n_cases"], found["scored_correct"], found["scored_total"], found["documented_limits"], len(found["undocumented_failures"]), len(found["results"]))
    return s.createDataFrame([row], "n_cases long, scored_correct long, scored_total long, documented_limits long, failures long, n_results long")


_add("snk05_guardrail_report", _report, f"SELECT scored + limits AS n_cases, passed AS scored_correct, scored AS scored_total, limits AS documented_limits, regressions AS failures, scored + limits AS n_results FROM ({_CASES})")
_add("har03_exit_status", lambda s, d: s.createDataFrame([(reports.exit_status(e.rollup(_cases(s, d))),)], "status long"), f"SELECT CAST(regressions > 0 AS BIGINT) AS status FROM ({_CASES})")
