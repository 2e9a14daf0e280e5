"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue in a fixed random order, up to REPEATS times over. A document's virtual finish time is the
tokens of its source up to and including it, divided by the source's target. The queue of all sources is sorted by that
time and cut where the total budget is spent, so every source ends near its target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, buckets_for, keep, running_sum, shuffled_key, words_in

REPEATS = 3
WEIGHTS = (1, 2, 3)


def targets(sizes: DataFrame, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source, from its source and size rows.

    Sources in order of code points, null last, take the weights in turn and share the sum of all sizes. A target stops
    at `repeats` times its source's size; what is over is shared by weight among the others until none is above. Sorted
    by size over weight the capped sources come first, so one running sum finds the final share.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    cap = (F.lit(repeats) * F.col("source_size")).cast("double")
    rows = total.withColumn("w", w).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("share", (F.sum("source_size").over(everything) - (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("ratio") > F.col("share"), F.col("share"))).over(everything)
    return rows.select("source", "source_size", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap")).alias("target"))


def _queue(docs: DataFrame, carry: list[str], buckets: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = shuffled_key(seed, F.col(id_col))
    out = docs.select(*[F.col(c).alias(f"c_{c}") for c in carry], F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("tie"))
    return out.withColumn("bucket", bucket_of(F.col("key"), buckets))


def mix(docs: DataFrame, carry: list[str] | None = None, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of docs: the columns in carry (all, if not given), size, source_size, target and times.

    times: how often the mix takes the document, 0 to `repeats`. Null texts and texts without words have size 0 and are
    never taken; a null source is a source of its own; documents of one id queue by size and text. Columns of docs that
    clash with the results' names are replaced; an empty table gives no rows.
    """
    mine = ["size", "source_size", "target", "times"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in mine]
    buckets = buckets_for(docs.count())
    slim = keep(_queue(docs, [], buckets, seed, id_col, text_col, source_col), "queue")
    goal = keep(targets(slim, repeats, weights), "targets").select(F.col("source").alias("_source"), "source_size", "target")
    order = [F.col("key"), F.col("size"), F.col("tie")]
    placed = keep(running_sum(slim, "source", "bucket", order, "size", "upto"), "placed")

    turns = placed.where("size > 0").join(goal, F.col("source").eqNullSafe(F.col("_source"))).where("target > 0")
    turns = turns.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("upto", F.col("turn") * F.col("source_size") + F.col("upto"))
    turns = turns.withColumn("finish", F.col("upto").cast("double") / F.col("target"))
    row = slim.agg(F.sum("size").alias("budget"), F.count("*").alias("n")).first()
    budget, bins = row.budget or 0, max(64, min(1 << 20, row.n // 500))
    turns = turns.withColumn("bin", F.floor(F.least(F.col("finish"), F.lit(2.0)) * bins).cast("long"))
    filled = turns.groupBy("bin").agg(F.sum("size").alias("s")).withColumn("through", F.sum("s").over(Window.orderBy("bin")))
    last = filled.where(F.col("through") > budget).orderBy("bin").select("bin", (F.col("through") - F.col("s")).alias("before")).first()
    if last is None:
        taken = turns
    else:
        inner = Window.partitionBy("bin").orderBy("finish", F.col("source").asc_nulls_last(), "turn", *order).rowsBetween(Window.unboundedPreceding, 0)
        edge = turns.where(F.col("bin") == last.bin).withColumn("through", F.lit(last.before) + F.sum("size").over(inner))
        columns = ["_source", "upto"]
        taken = turns.where(F.col("bin") < last.bin).select(*columns).union(edge.where(F.col("through") <= budget).select(*columns))
    limits = keep(taken.groupBy("_source").agg(F.max("upto").alias("limit")), "limits")

    full = running_sum(_queue(docs, carry, buckets, seed, id_col, text_col, source_col), "source", "bucket", order, "size", "upto")
    by = goal.join(limits.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    full = full.join(by, F.col("source").eqNullSafe(F.col("_source")), "left")
    times = sum((F.when((F.col("size") > 0) & (F.lit(e) * F.col("source_size") + F.col("upto") <= F.col("limit")), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    return full.select(*[F.col(f"c_{c}").alias(c) for c in carry], "size", "source_size", "target", times.cast("int").alias("times"))


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as it is taken."""
    return mixed.where("times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*columns)
