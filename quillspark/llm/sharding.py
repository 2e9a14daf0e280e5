"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as they come: each task writes what it holds of an arrival as one small immutable shard, without a
shuffle. Compaction looks at runs (an arrival, or what earlier compactions made of some) by tier, a power of FANOUT of
their size; whenever a tier holds FANOUT runs, the oldest of them merge. A merged run is written once, into files of
about the target size, by joining whole shards, again without a shuffle.

What a store holds is what its manifest of the highest version lists. A manifest is written aside and renamed into place;
the rename fails if that version exists, so of two writers one has to try again, and readers see all of a version or
none. That asks for a file system whose rename is atomic and refuses an existing name, as HDFS's and a local one's do;
plain object stores need a committer of their own. Files that no manifest lists, such as those of a lost writer, are
never read. Sizes are those of the files, and rows come from their footers: nothing is read again to be counted. The
driver holds one short entry for each file that a version lists, which compaction keeps to the data over the target size.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 4
SMALL = 4 << 20
TARGET = 64 << 20
_ARRIVAL = "__arrival__"


@dataclass
class Run:
    """A run: name, bytes of its files, rows, and its files as [path, rows, bytes]."""

    name: str
    bytes: int = 0
    rows: int = 0
    files: list[list] = field(default_factory=list)


def tier(size: int, small: int = SMALL, fanout: int = FANOUT) -> int:
    """0 up to small bytes, then one more for each power of fanout."""
    n, most = 0, small
    while size > most:
        n, most = n + 1, most * fanout
    return n


def plan(runs: list[Run], small: int = SMALL, fanout: int = FANOUT) -> list[list[Run]]:
    """What runs become: lists of runs that merge, or stay if alone. Oldest first; merged runs may merge again."""
    groups = [[r] for r in runs]
    while True:
        by: dict[int, list[int]] = {}
        for i, g in enumerate(groups):
            by.setdefault(tier(sum(r.bytes for r in g), small, fanout), []).append(i)
        full = next((by[t] for t in sorted(by) if len(by[t]) >= fanout), None)
        if full is None:
            return groups
        chosen = full[:fanout]
        merged = [r for i in chosen for r in groups[i]]
        groups = [g for i, g in enumerate(groups) if i not in chosen[1:]]
        groups[chosen[0]] = merged


class ShardStore:
    """A folder of shards and manifests, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/manifest"))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The highest committed version; 0 for a new store."""
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max([0, *(int(n[1:9]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "runs": []}
        stream = self.fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self.manifest(version)["runs"]]

    def commit(self, base: int, schema: str | None, runs: list[Run]) -> int:
        """Makes runs the content of version base + 1; raises if another writer has made that version."""
        aside, final = f"{self.root}/manifest/.{uuid.uuid4().hex}", f"{self.root}/manifest/v{base + 1:08d}.json"
        stream = self.fs.create(self._path(aside), False)
        stream.write(bytearray(json.dumps({"version": base + 1, "schema": schema, "runs": [vars(r) for r in runs]}).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(final).toUri() if "://" in final or final.startswith("file:") else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(self._path(aside), self._path(final), options)
        return base + 1

    def _files(self, read: DataFrame, *by: str) -> list:
        """path, rows and bytes of each file, from footers and names alone."""
        # Paths come escaped, as in an address.
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path")
        return read.groupBy(*by, path).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes")).orderBy(*by, "path").collect()

    def _measured(self, folder: str, name: str, schema: T.StructType) -> Run:
        """The run of all files below a folder, as they are."""
        if not self.fs.globStatus(self._path(f"{folder}/part-*")):
            return Run(name)
        rows = self._files(self.spark.read.schema(schema).parquet(folder))
        return Run(name, sum(r.bytes for r in rows), sum(r.rows for r in rows), [[r.path, r.rows, r.bytes] for r in rows])

    def append(self, df: DataFrame, arrival: Column | None = None) -> int:
        """Adds the rows of df as one run for each value of arrival (one run, if not given); returns the new version."""
        base = self.manifest()
        if base["schema"] and T.StructType.fromJson(json.loads(base["schema"])).names != df.columns:
            raise ValueError("the store holds other columns")
        stem = f"v{base['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/data/{stem}"
        # A null arrival is named apart from any text.
        value = F.lit("all") if arrival is None else F.coalesce(F.concat(F.lit("of-"), arrival.cast("string")), F.lit("null"))
        df.withColumn(_ARRIVAL, value).write.partitionBy(_ARRIVAL).option("compression", "zstd").parquet(folder)
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        runs = []
        if self.fs.globStatus(self._path(f"{folder}/{_ARRIVAL}=*/part-*")):
            read = self.spark.read.schema(T.StructType([*schema, T.StructField(_ARRIVAL, T.StringType())])).parquet(folder)
            rows = self._files(read, _ARRIVAL)
            by: dict[str, Run] = {}
            for r in rows:
                run = by.setdefault(r[_ARRIVAL], Run(f"{stem}/{r[_ARRIVAL]}"))
                run.files.append([r.path, r.rows, r.bytes])
                run.rows, run.bytes = run.rows + r.rows, run.bytes + r.bytes
            runs = list(by.values())
        return self.commit(base["version"], schema.json(), [Run(**r) for r in base["runs"]] + runs)

    def compact(self, target: int = TARGET, small: int = SMALL, fanout: int = FANOUT) -> int:
        """Merges runs as plan() says and commits the result; returns the version, unchanged if there is nothing to do."""
        base = self.manifest()
        groups = plan([Run(**r) for r in base["runs"]], small, fanout)
        if all(len(g) == 1 for g in groups):
            return base["version"]
        schema = T.StructType.fromJson(json.loads(base["schema"]))
        stem = f"v{base['version'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        out = []
        for n, group in enumerate(groups):
            if len(group) == 1:
                out += group
                continue
            paths, size = [f[0] for r in group for f in r.files], sum(r.bytes for r in group)
            folder = f"{self.root}/data/{stem}/merged-{n}"
            self.spark.read.schema(schema).parquet(*paths).coalesce(max(1, -(-size // target))).write.option("compression", "zstd").parquet(folder)
            out.append(self._measured(folder, f"{stem}/merged-{n}", schema))
            if out[-1].rows != sum(r.rows for r in group):
                raise RuntimeError("a merge has lost or doubled rows")
        return self.commit(base["version"], base["schema"], out)

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """All rows of a version (the latest, if not given), and which shard each is in, as version/run/part."""
        manifest = self.manifest(version)
        if not manifest["schema"]:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f[0] for r in manifest["runs"] for f in r["files"]]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit(None).cast("string"))
        path = F.col("_metadata.file_path")
        parts = [F.regexp_extract(path, rf"/data/v0*(\d+)-[0-9a-f]+/(?:{_ARRIVAL}=)?([^/]+)/part-(\d+)", i) for i in (1, 2, 3)]
        return self.spark.read.schema(schema).parquet(*paths).select("*", F.concat_ws("/", *parts).alias(shard))


def shard(docs: DataFrame, root: str, arrival: Column, target: int = TARGET, small: int = SMALL, fanout: int = FANOUT) -> DataFrame:
    """Appends docs by arrival to the store at root, compacts it, and reads back what it holds, with the column shard.

    Rows that repeat stay as often as they come; a null arrival is an arrival of its own; texts may be null; a column of
    docs named shard is replaced in what is read. An empty table makes a version without files and gives no
    rows.
    """
    store = ShardStore(docs.sparkSession, root)
    store.append(docs.drop("shard"), arrival)
    store.compact(target, small, fanout)
    return store.read()
