"""The four gates as columns, and the decision they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as t

# Limits of the gates.
MAX_QUERY, MIN_SCORE = 500, 0.8167
# End of fixed values.


def scope(query: Column) -> Column:
    """Why a query is out of scope, or in_scope: the first rule that applies to what is left of it when stripped."""
    q = t.strip(F.coalesce(query, F.lit("")))
    asks = F.lit(False)
    for pattern in t.IMPERATIVE:
        asks = asks | q.rlike(t.unicode(pattern))
    return F.when(q == "", "empty_query").when(F.length(q) > MAX_QUERY, "query_too_long").when(asks, "out_of_scope_instruction").otherwise("in_scope")


def vocabulary(term_hits: Column) -> Column:
    """Whether a query shares any term with the index. A query without terms shares none."""
    return term_hits > 0


def score_gate(gate_score: Column, threshold: float = MIN_SCORE) -> Column:
    return gate_score >= F.lit(threshold)


def grounded(answer: Column, contexts: Column) -> Column:
    """checked, unsupported (first ten, sorted), n_unsupported and reason of an answer against its contexts.

    Contexts are lower-cased before their specifics are taken, the answer is not.
    """
    mine, theirs = t.checkable(answer), t.checkable(F.lower(F.array_join(contexts, " \n ")))
    missing = F.array_sort(F.array_except(mine, theirs))
    reason = F.when((F.size(mine) == 0) & answer.rlike(t.unicode(t.HEDGE)), "refusal_no_claims").when(F.size(mine) == 0, "no_checkable_claims").when(F.size(missing) > 0, "ungrounded_specifics").otherwise("grounded")
    return F.struct(F.size(mine).alias("checked"), F.slice(missing, 1, 10).alias("unsupported"), F.size(missing).alias("n_unsupported"), reason.alias("reason"))


def first_gate(query: Column, term_hits: Column, gate_score: Column, threshold: float = MIN_SCORE) -> Column:
    """The first gate that stops a query, or reaches_generation."""
    return F.when(scope(query) != "in_scope", "scope").when(~vocabulary(term_hits), "vocabulary").when(~score_gate(gate_score, threshold), "score").otherwise("reaches_generation")


def decide(asked: DataFrame, threshold: float = MIN_SCORE) -> DataFrame:
    """mode, answered, refusal_reason and answer of each query.

    asked: query, n_hits, term_hits, gate_score, top_context, and generated (ok, answerable, answer, grounded; null
    without a generator). Cheap gates come first; without a usable generation the best hit's context is the answer, and
    only a generated answer is refused for what it does not ground.
    """
    g = F.col("generated")
    ok = g.isNotNull() & F.coalesce(g["ok"], F.lit(False))
    reason = (
        F.when(scope(F.col("query")) != "in_scope", scope(F.col("query")))
        .when(F.col("n_hits") == 0, "no_results")
        .when(~vocabulary(F.col("term_hits")), "no_corpus_vocabulary")
        .when(~score_gate(F.col("gate_score"), threshold), "below_retrieval_threshold")
        .when(ok & ~g["answerable"], "model_reported_unanswerable")
        .when(ok & ~g["grounded"], "ungrounded_answer")
    )
    out = asked.withColumn("refusal_reason", reason)
    mode = F.when(F.col("refusal_reason").isNotNull(), "refused").when(ok, "generated").otherwise("extractive")
    out = out.withColumn("mode", mode).withColumn("answered", F.col("refusal_reason").isNull())
    return out.withColumn("answer", F.when(F.col("mode") == "generated", g["answer"]).when(F.col("mode") == "extractive", F.col("top_context")))


def error_kind(code: Column, message: Column) -> Column:
    """(retryable, kind) of a generator's failure."""
    m = F.lower(message)

    def says(*words: str) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(m, w))

    kind = F.when(F.coalesce(code == 429, F.lit(False)) | says("resource_exhausted", "rate limit", "quota"), "rate_limited").when(code.between(500, 599), "server_error").when(says("timeout", "deadline"), "timeout").when(code.isin(400, 401, 403), "client_error").otherwise("unknown_error")
    return F.struct(kind.isin("rate_limited", "server_error", "timeout").alias("retryable"), kind.alias("kind"))
