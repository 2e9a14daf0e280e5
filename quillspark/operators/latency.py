"""Latency: stage timings, warm-up, and repeated passes over questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import percentile

SAMPLES = "stage string, turn int, ms double"


class Timings:
    """Milliseconds by stage, in the order in which stages end; a stage that comes again adds up."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self.clock, self.ms = clock, {}

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        begin = self.clock()
        try:
            yield
        finally:
            self.ms[name] = self.ms.get(name, 0.0) + 1000 * (self.clock() - begin)

    def total(self) -> dict[str, float]:
        return {**self.ms, "total": sum(self.ms.values())}


def warm_up(spark: SparkSession, embedder: Callable[[list[str]], np.ndarray], tasks: int) -> int:
    """One call of the embedder in each of so many tasks, so that models are loaded before anything is timed; its width."""

    def run(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([np.asarray(embedder(["warm-up"])).shape[1]])], ["dim"])

    return spark.range(tasks, numPartitions=tasks).mapInArrow(run, "dim long").agg({"dim": "max"}).first()[0]


def samples(spark: SparkSession, stages: dict[str, Callable[[], DataFrame]], repeats: int, warm: int = 1, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """stage, turn, ms of each run of each stage, and of their total; `warm` runs come first and are not counted.

    A stage is run as a whole, on all its questions: what Spark answers in one job is timed as one.
    """
    rows = []
    for turn in range(-warm, repeats):
        timings = Timings(clock)
        for name, build in stages.items():
            with timings.stage(name):
                build().write.format("noop").mode("overwrite").save()
        rows += [(name, turn, ms) for name, ms in timings.total().items() if turn >= 0]
    return spark.createDataFrame(rows, SAMPLES)


def micro_batches(spark: SparkSession, batches: Iterable[DataFrame], run: Callable[[DataFrame, Timings], object], clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """stage, turn, ms of each stage that run() times, and of their total, for each micro-batch in turn."""
    rows = []
    for turn, batch in enumerate(batches):
        timings = Timings(clock)
        run(batch, timings)
        rows += [(name, turn, ms) for name, ms in timings.total().items()]
    return spark.createDataFrame(rows, SAMPLES)


def report(samples: DataFrame) -> DataFrame:
    """stage, n, mean, p50, p95 and max of its samples' milliseconds, by the percentile rule of the reports."""
    means = samples.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 3).alias("mean"), F.max("ms").alias("max"))
    for p in (50, 95):
        means = means.join(percentile(samples, "ms", p, "stage").withColumnRenamed("value", f"p{p}"), "stage")
    return means.select("stage", "n", "mean", "p50", "p95", "max")
