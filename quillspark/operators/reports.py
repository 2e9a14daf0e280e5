"""Reports of the bench, of calibration and of the guardrails as JSON, and what they mean for an exit status."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_of(df: DataFrame) -> list[dict]:
    """Rows as dictionaries, in order of what they hold, column by column; for summaries, which are small."""
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: json.dumps(list(r.values()), default=str))


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    """One JSON document, on any file system that Spark writes."""
    text = json.dumps(report, indent=2, default=str)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).where("value <> ''").first().value)


def retrieval_report(results: DataFrame, n_queries: int, **config) -> dict:
    """results: one row a strategy or ranker."""
    return {"config": config, "n_queries": n_queries, "results": rows_of(results)}


def calibration_report(signals: DataFrame, best: DataFrame, populations: DataFrame, points: DataFrame, queries: DataFrame, **config) -> dict:
    """What each signal is worth, the best one, how its populations lie, and every query's own signals."""
    return {"config": config, "signals": rows_of(signals), "best": rows_of(best), "populations": rows_of(populations), "operating_points": rows_of(points), "queries": rows_of(queries)}


def guardrail_report(cases: DataFrame, rollup: DataFrame, **config) -> dict:
    """rollup: as evaluate.rollup() gives it; cases: the rows it sums up."""
    total = rollup.first()
    failures = [x for x in total.regressed.split(",") if x]
    return {**config, "n_cases": total.scored + total.limits, "scored_correct": total.passed, "scored_total": total.scored, "documented_limits": total.limits, "undocumented_failures": failures, "results": rows_of(cases)}


def exit_status(rollup: DataFrame | None = None, invariants: DataFrame | None = None) -> int:
    """1 if any guardrail case has regressed or any invariant of the corpus is broken, else 0."""
    regressed = rollup is not None and rollup.where("regressions > 0").take(1)
    broken = invariants is not None and invariants.where("not ok").take(1)
    return int(bool(regressed or broken))
