"""Evaluation: retrieval metrics, percentiles, calibration of thresholds, AUC, bootstrap and paired comparison.

What sweeps over scores does so over the table of distinct values with their counts. Scores are rounded, so that table
stays small however many rows stand behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes of the reports.
RESAMPLES, ATTRACTOR_MIN, SAFE_SHARE = 2000, 3, 0.95
SIGNALS = ["top1", "margin_12", "margin_1k", "ratio_1k", "spread"]
# End of fixed values.


def first_gold_rank(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """qid, category, expect, hit and rank (0 without a hit) of the first of each query's gold ids in its first k hits.

    hits: qid, rank, got; gold: qid, category, expect, gold.
    """
    joined = gold.join(hits.where(F.col("rank") <= k), "qid", "left")
    rank = F.coalesce(F.min(F.when(F.array_contains("gold", F.col("got")), F.col("rank"))), F.lit(0))
    return joined.groupBy("qid", "category", "expect").agg(rank.alias("rank")).withColumn("hit", F.col("rank") > 0)


def quality(ranks: DataFrame, *by: str) -> DataFrame:
    """n, recall, prec1 and mrr over the answerable queries."""
    rr = F.when(F.col("rank") > 0, 1 / F.col("rank").cast("double")).otherwise(F.lit(0.0))
    return ranks.where("expect = 'answer'").groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall"), F.round(F.avg((F.col("rank") == 1).cast("double")), 4).alias("prec1"), F.round(F.avg(rr), 4).alias("mrr"))


def attractors(hits: DataFrame, gold: DataFrame, least: int = 1) -> DataFrame:
    """How often each document comes first, how often wrongly, and its share of all queries; at least `least` times."""
    tops = hits.where("rank = 1").join(gold, "qid")
    n = gold.agg(F.count("*").alias("_n"))
    out = tops.groupBy("got").agg(F.count("*").alias("n_first"), F.count_if(~F.array_contains("gold", F.col("got"))).alias("n_wrong"))
    return out.where(F.col("n_first") >= least).crossJoin(F.broadcast(n)).select("got", "n_first", "n_wrong", F.round(F.col("n_first") / F.col("_n"), 4).alias("share"))


def percentile(df: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """The value at index min(n - 1, round(p / 100 * n + 0.5) - 1), halves to even, of the ascending values.

    Without columns in `by`, no values at all have 0.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    through = counts.withColumn("through", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.bround(F.lit(p / 100) * F.col("n") + 0.5).cast("long") - 1)) if p < 100 else F.col("n") - 1
    found = through.where(F.col("through") > at).groupBy(*by).agg(F.min("v").alias("value"))
    return found if by else found.select(F.coalesce("value", F.lit(0.0)).alias("value"))


def middle(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The value at index n // 2 of the ascending values: the other report's median."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    through = counts.withColumn("through", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    found = through.where(F.col("through") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min("v").alias("value"))
    return found if by else found.select(F.coalesce("value", F.lit(0.0)).alias("value"))


def signals(hits: DataFrame, k: int = 5) -> DataFrame:
    """Each query's candidate signals for a gate, from its first k scores, to 4 places."""
    s, r = F.col("score"), F.col("rank")
    few = hits.where(r <= k).groupBy("qid").agg(F.max(F.when(r == 1, s)).alias("top1"), F.max(F.when(r == 2, s)).alias("second"), F.avg(F.when(r > 1, s)).alias("rest"), F.max(s).alias("high"), F.min(s).alias("low"))
    top, rest = F.col("top1"), F.coalesce("rest", "top1")
    named = {"top1": top, "margin_12": top - F.coalesce("second", "top1"), "margin_1k": top - rest, "ratio_1k": F.when(rest != 0, top / rest).otherwise(F.lit(0.0)), "spread": F.col("high") - F.col("low")}
    return few.select("qid", *[(F.round(c, 4) + 0.0).alias(name) for name, c in named.items()])


def value_table(df: DataFrame, value: str, positive: Column, *by: str) -> DataFrame:
    """v, pos and neg: how many of each population have each value."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))


def auc(table: DataFrame, *by: str) -> DataFrame:
    """Probability that a positive's value exceeds a negative's, ties counting half; 0 without both."""
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = table.withColumn("won", F.col("pos") * (below + 0.5 * F.col("neg")))
    sums = won.groupBy(*by).agg(F.sum("won").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*by, F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("w") / (F.col("p") * F.col("n")), 4)).otherwise(F.lit(0.0)).alias("auc"))


def pair_counts(table: DataFrame, *by: str) -> DataFrame:
    """How many pairs of a positive and a negative the positive wins, ties and loses; no pair is ever made."""
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = table.select(*by, "pos", "neg", (F.col("pos") * below).alias("won"), (F.col("pos") * F.col("neg")).alias("tied"))
    sums = rows.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("won", "tied", "pos", "neg")])
    return sums.select(*by, "won", "tied", (F.col("pos") * F.col("neg") - F.col("won") - F.col("tied")).alias("lost"))


def sweep(table: DataFrame, *by: str) -> DataFrame:
    """cutoff (midpoint of neighbouring values; a lone value itself), kept, blocked, of_pos and of_neg."""
    w = Window.partitionBy(*by)
    up = w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = table.select(*by, "v", F.lead("v").over(w.orderBy("v")).alias("next"), F.sum("pos").over(w).alias("of_pos"), F.sum("neg").over(w).alias("of_neg"), F.sum("pos").over(up).alias("p"), F.sum("neg").over(up).alias("blocked"), F.count("*").over(w).alias("values"))
    lone = F.col("values") == 1
    cutoff = F.when(lone, F.col("v").cast("double")).otherwise((F.col("v") + F.col("next")) / 2)
    kept, blocked = F.when(lone, F.col("of_pos")).otherwise(F.col("of_pos") - F.col("p")), F.when(lone, F.lit(0).cast("long")).otherwise(F.col("blocked"))
    return rows.where(F.col("next").isNotNull() | lone).select(*by, cutoff.alias("cutoff"), kept.alias("kept"), blocked.alias("blocked"), "of_pos", "of_neg")


def coarse_sweep(table: DataFrame) -> DataFrame:
    """The same at the fixed cutoffs 0.20 to 0.95; the table is joined by the first cutoff above each value."""
    step = F.greatest(F.lit(20), F.least(F.lit(96), F.floor(F.col("v") * 100).cast("int") + 1))
    # Steps are found by comparison with i / 100 itself, as the product may round either way.
    step = F.when(F.col("v") < (step - 1) / 100, step - 1).when(F.col("v") >= step / 100, step + 1).otherwise(step)
    counts = table.groupBy(F.greatest(F.lit(20), step).alias("i")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = table.sparkSession.range(20, 98).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").fillna(0)
    w = Window.orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = every.select("i", F.sum("pos").over(Window.partitionBy()).alias("of_pos"), F.sum("neg").over(Window.partitionBy()).alias("of_neg"), F.sum("pos").over(up).alias("p"), F.sum("neg").over(up).alias("blocked"))
    return rows.where(F.col("i") < 96).select((F.col("i") / 100).alias("cutoff"), (F.col("of_pos") - F.col("p")).alias("kept"), "blocked", "of_pos", "of_neg")


def best_cutoff(swept: DataFrame, *by: str) -> DataFrame:
    """The cutoff of the highest accuracy; of several, the lowest."""
    accuracy = F.round((F.col("kept") + F.col("blocked")) / (F.col("of_pos") + F.col("of_neg")), 10)
    rows = swept.withColumn("a", accuracy)
    best = rows.groupBy(*by).agg(F.min(F.struct((-F.col("a")).alias("a"), "cutoff", "kept", "blocked", "of_pos", "of_neg")).alias("b"))
    return best.select(*by, F.round("b.cutoff", 4).alias("cutoff"), F.round(-F.col("b.a"), 4).alias("accuracy"), "b.kept", "b.blocked", (F.col("b.of_pos") - F.col("b.kept")).alias("false_refusals"), (F.col("b.of_neg") - F.col("b.blocked")).alias("hallucination_risk"))


def operating_points(swept: DataFrame, *by: str) -> DataFrame:
    """One row for each (kept, blocked), at its lowest cutoff."""
    rows = swept.groupBy(*by, "kept", "blocked", "of_pos", "of_neg").agg(F.min("cutoff").alias("cutoff"))
    return rows.select(*by, F.round("cutoff", 4).alias("cutoff"), "kept", "of_pos", "blocked", "of_neg", (F.col("of_neg") - F.col("blocked")).alias("leaks"))


def least_leaks(points: DataFrame, negatives: DataFrame) -> DataFrame:
    """The fewest leaks of any point that keeps enough of the positives; all negatives, if none does."""
    safe = points.where(F.col("kept") >= F.col("of_pos") * SAFE_SHARE).agg(F.min("leaks").alias("m"))
    return safe.crossJoin(negatives.agg(F.count("*").alias("n"))).select(F.coalesce("m", "n").alias("min_leaks"))


def resampled(outcomes: DataFrame, value: str, by: str, order: str, resamples: int = RESAMPLES) -> DataFrame:
    """by, b and m: the mean of each resample of each group's values; draws are hashes of (resample, place)."""
    w = Window.partitionBy(by)
    placed = outcomes.select(by, F.col(value).cast("double").alias("x"), (F.row_number().over(w.orderBy(order)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    sizes = placed.select("n").distinct()
    draws = placed.sparkSession.range(resamples).select(F.col("id").alias("b")).crossJoin(F.broadcast(sizes)).select("b", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    draws = draws.select("b", "n", (F.conv(F.substring(F.md5(F.concat_ws(":", "b", "j").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")).alias("i"))
    return draws.join(placed, ["n", "i"]).groupBy(by, "b").agg(F.round(F.avg("x"), 9).alias("m"))


def bootstrap(outcomes: DataFrame, value: str, by: str, order: str, resamples: int = RESAMPLES) -> DataFrame:
    """mean, low and high (95 %) of each group's values, from resampled()."""
    ends = interval(resampled(outcomes, value, by, order, resamples), by, resamples)
    return outcomes.groupBy(by).agg(F.round(F.avg(F.col(value).cast("double")), 4).alias("mean")).join(ends, by)


#: Numbers of hits further from the mean than so many standard deviations are never drawn.
REACH = 12


def hit_table(outcomes: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, hits, k and cdf: the chance of at most k hits in a resample of a group's n outcomes of 0 or 1.

    Weights grow from one k to the next by a known ratio, so they are running sums of logarithms, scaled by the largest.
    Only numbers within REACH deviations of the mean have a row: some 24 times the root of n, not n.
    """
    w = Window.partitionBy(by).orderBy("k")
    sizes = outcomes.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("long")).alias("hits"))
    p = F.col("hits") / F.col("n")
    spread = F.ceil(REACH * F.sqrt(F.col("hits") * (1 - p)) + REACH).cast("long")
    ks = F.sequence(F.greatest(F.lit(0).cast("long"), F.col("hits") - spread), F.least(F.col("n"), F.col("hits") + spread))
    mixed = (F.col("hits") > 0) & (F.col("hits") < F.col("n"))
    rows = sizes.select(by, "n", "hits", F.explode(F.when(mixed, ks).otherwise(F.array("hits"))).alias("k"))
    step = F.log((F.col("n") - F.col("k") + 1) / F.col("k") * (F.col("hits") / (F.col("n") - F.col("hits"))))
    first = F.row_number().over(w) == 1
    logs = rows.withColumn("l", F.sum(F.when(first, F.lit(0.0)).otherwise(step)).over(w))
    weights = logs.withColumn("x", F.exp(F.col("l") - F.max("l").over(Window.partitionBy(by))))
    return weights.select(by, "n", "hits", "k", (F.sum("x").over(w) / F.sum("x").over(Window.partitionBy(by))).alias("cdf"))


def resampled_by_counts(outcomes: DataFrame, value: str, by: str, resamples: int = RESAMPLES) -> DataFrame:
    """by, b and m: the mean of each resample of each group's outcomes, which are 0 or 1.

    A resample of n such outcomes is told by its number of hits, which is binomial; so one draw, a hash of the group and
    the resample, gives it. Draws and the table of chances are put in one order, and a draw gets as many hits as there
    are numbers whose chance it exceeds: B rows a group, whatever n.
    """
    table = hit_table(outcomes, value, by)
    groups = table.groupBy(by).agg(F.first("n").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    draws = groups.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long"))))
    code = F.conv(F.substring(F.md5(F.concat_ws(":", "b", F.col(by).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    points = draws.select(by, "n", "low", "high", "b", ((code + 0.5) / float(1 << 48)).alias("u"))
    marks = table.select(by, F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("b"), F.col("cdf").alias("u"))
    # A mark comes before a draw of the same chance only if the draw exceeds it; draws go first among equals.
    below = F.count(F.when(F.col("b").isNull(), 1)).over(Window.partitionBy(by).orderBy("u", F.col("b").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = points.unionByName(marks).withColumn("below", below).where(F.col("b").isNotNull())
    return found.select(by, "b", F.round(F.least(F.col("low") + F.col("below"), F.col("high")) / F.col("n"), 9).alias("m"))


def interval(means: DataFrame, by: str, resamples: int = RESAMPLES) -> DataFrame:
    """by, low and high: the ends of the middle 95 % of resampled means."""
    nth = means.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("m", "b")))
    low, high = int(resamples * 0.025) + 1, int(resamples * 0.975) + 1
    return nth.groupBy(by).agg(F.max(F.when(F.col("r") == low, F.round("m", 4))).alias("low"), F.max(F.when(F.col("r") == high, F.round("m", 4))).alias("high"))


def bootstrap_by_counts(outcomes: DataFrame, value: str, by: str, resamples: int = RESAMPLES) -> DataFrame:
    """mean, low and high (95 %) of each group's outcomes of 0 or 1, from resampled_by_counts()."""
    means = outcomes.groupBy(by).agg(F.round(F.avg(F.col(value).cast("double")), 4).alias("mean"))
    return means.join(interval(resampled_by_counts(outcomes, value, by, resamples), by, resamples), by)


def best_ranker(results: DataFrame, cost: str, *metrics: str) -> DataFrame:
    """The row of the highest metrics, in order; of equals the one of the least cost, such as a median latency, then by name."""
    order = [*[F.col(m).desc() for m in metrics], F.col(cost).asc(), F.col("ranker").asc()]
    return results.orderBy(*order).limit(1)


def best_signal(aucs: DataFrame, accuracies: DataFrame) -> DataFrame:
    """signal, auc, accuracy: the highest auc; of equals the highest accuracy, then the last by name."""
    joined = aucs.join(accuracies.select("signal", "accuracy"), "signal")
    return joined.agg(F.max(F.struct("auc", "accuracy", "signal")).alias("m")).select("m.signal", "m.auc", "m.accuracy")


def side_by_side(ranks: DataFrame, base: str, by: str = "ranker") -> DataFrame:
    """by, qid, ok, base_ok: whether each variant, and the base, puts a gold document first, query by query."""
    won = ranks.where("expect = 'answer'").select(by, "qid", (F.col("rank") == 1).alias("ok"))
    ours = won.where(F.col(by) == base).select("qid", F.col("ok").alias("base_ok"))
    return won.where(F.col(by) != base).join(ours, "qid").select(by, "qid", "ok", "base_ok")


def paired(ranks: DataFrame, base: str, by: str = "ranker") -> DataFrame:
    """For each variant against the base, query by query: fixed, broken and net first places."""
    fixed, broken = F.count_if(F.col("ok") & ~F.col("base_ok")), F.count_if(~F.col("ok") & F.col("base_ok"))
    return side_by_side(ranks, base, by).groupBy(by).agg(fixed.alias("fixed"), broken.alias("broken"), (fixed - broken).alias("net"))


def rollup(cases: DataFrame) -> DataFrame:
    """Totals of a guardrail run. cases: id, correct, known_limit, first_gate."""
    limit, right = F.col("known_limit"), F.col("correct")
    ids = F.array_join(F.array_sort(F.collect_list(F.when(~limit & ~right, F.col("id")))), ",")
    return cases.agg(F.count_if(~limit).alias("scored"), F.count_if(~limit & right).alias("passed"), F.count_if(limit).alias("limits"), F.count_if(~limit & ~right).alias("regressions"), F.count_if(limit & right).alias("limits_passing"), F.count_if(F.col("first_gate") != "reaches_generation").alias("blocked_earlier"), ids.alias("regressed"))
