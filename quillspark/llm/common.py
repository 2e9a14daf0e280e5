"""What several operators share: tables in the shared folder, and running sums that no key can overload."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HASH_SPACE = 1 << 16
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Paths of the tables that keep() wrote since the innermost keep_alone() began.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set, a folder of this machine, if the master is local."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context._jsc.sc().getCheckpointDir().getOrElse(None)
    if folder is None:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def small_batches(spark: SparkSession) -> None:
    """Lets batches for Python hold BATCH_ROWS rows or BATCH_BYTES at most, unless the session asks for less.

    Batches live outside of the heap, on both sides; ten thousand documents of any length would not be bounded.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < _bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    digits = size.rstrip("bBkKmMgG")
    unit = size[len(digits) :].lower().rstrip("b")
    return int(digits) * 1024 ** " kmg".index(unit or " ")


def keep(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder: computed once, safe from lost executors, and of known size."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if (passing := _PASSING.get()) is not None:
        passing.append(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """keep(make(), name), and the tables that make() kept are deleted, as what it returned has been written.

    make() must hand out no other DataFrame that reads them. If it fails, they last until the driver ends.
    """
    outer = _PASSING.set([])
    try:
        made, passing = make(), _PASSING.get()
    finally:
        _PASSING.reset(outer)
    out, spark = keep(made, name), made.sparkSession
    for path in passing or []:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return out


def words_in(text: Column) -> Column:
    """Number of runs of anything but space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffled_key(seed: str, column: Column) -> Column:
    """A key, as hex, that puts rows in a fixed random order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))).cast("binary"))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket, in order, of a hex key; buckets divides HASH_SPACE."""
    return F.floor(F.conv(F.substring(key, 1, 4), 16, 10).cast("long") / F.lit(HASH_SPACE // buckets)).cast("int")


def buckets_for(rows: int, each: int = 4000) -> int:
    """A power of two of buckets, of about `each` rows."""
    n = 64
    while n < HASH_SPACE and rows > n * each:
        n *= 2
    return n


def running_sum(df: DataFrame, group: str, bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds the sum of value over the group's rows up to each, in order; a group may hold any share of all rows.

    Rows are ordered by bucket first. Sums of (group, bucket) are added up over the few buckets, and only rows of one
    bucket are ever sorted together.
    """
    sums = df.groupBy(F.col(group).alias("_g"), F.col(bucket).alias("_b")).agg(F.sum(value).alias("_s"))
    before = sums.select("_g", "_b", (F.sum("_s").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_s")).alias("_before"))
    before = keep(before, "offsets")
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col(bucket) == F.col("_b")))
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inner)).drop("_g", "_b", "_before")
