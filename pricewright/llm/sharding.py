"""Sharding by size-tiered compaction with versioned manifests.

Arrivals are appended as small immutable shards.  Compaction merges runs of shards of one
size tier into files of the target size.  What a version consists of is written as a manifest
table (a row per shard), and a version exists once its commit file does: that file is written under
another name and then renamed without overwriting, so of two writers one fails, and a reader
never sees half a version.

Plans and manifests are tables; the driver handles names of folders (one per append or
compaction that is still in use), never names of shards.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pricewright.llm.scratch import new_path, staged

#: Aimed file size, rows of an arrival shard at most, shards that make a run worth merging.
TARGET_BYTES, ARRIVAL_ROWS, FANOUT = 64 * 1024 * 1024, 2_000, 4
#: Target sizes that one task plans runs for.
RANGE_RUNS = 1_024
#: Shards whose sizes are within this factor are of one tier.
TIER_FACTOR = 4

_MANIFEST = "shard string, shard_rows long, shard_bytes long"


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """Shards of one table below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        folder, fs = self._fs(f"{self.path}/manifest")
        if not fs.exists(folder):
            return 0
        found = (re.fullmatch(r"v(\d+)\.commit", s.getPath().getName()) for s in fs.listStatus(folder))
        return max((int(m[1]) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The shards of a version (the last one by default)."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], _MANIFEST)
        path, fs = self._fs(f"{self.path}/manifest/v{version}.commit")
        stream = fs.open(path)
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{name}")

    def commit(self, shards: DataFrame, after: int) -> int:
        """Makes ``shards`` the version that follows ``after``, or fails as a whole."""
        version = after + 1
        name = f"v{version}-{uuid.uuid4().hex}"
        shards.select("shard", "shard_rows", "shard_bytes").write.parquet(f"{self.path}/manifest/{name}")
        waiting, fs = self._fs(f"{self.path}/manifest/{name}.waiting")
        stream = fs.create(waiting, False)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        self._publish(waiting, f"{self.path}/manifest/v{version}.commit", version)
        return version

    def _publish(self, waiting, target: str, version: int) -> None:
        """Renames a finished file; an existing target is another writer's version."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs
        path = files.Path(target)
        context = files.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        options = gateway.new_array(files.Options.Rename, 1)
        options[0] = files.Options.Rename.NONE
        try:
            context.rename(context.makeQualified(waiting), context.makeQualified(path), options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                context.delete(context.makeQualified(waiting), False)
                raise ConcurrentCommit(f"version {version} exists already") from e
            raise

    def append(self, df: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Adds rows as small shards, written where they are read; returns the new version."""
        before = self.version()
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return self.commit(self.manifest(before).unionByName(self._written(folder)), before)

    def _files(self, folders: list[str]) -> tuple[DataFrame, Column, Column]:
        """Rows of whole folders, with the shard and the file size of each (apart from columns so named)."""
        paths = [f"{self.path}/{f}" for f in folders]
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(*paths)
        file = rows.metadataColumn("_metadata")
        return rows, F.regexp_extract(file["file_path"], "/(data/[^/]+/.*)$", 1), file["file_size"]

    def _written(self, folder: str) -> DataFrame:
        """Manifest rows of the files in a folder; files without rows are left out."""
        rows, shard, size = self._files([folder])
        return rows.select(shard.alias("shard"), size.alias("shard_bytes")).groupBy("shard", "shard_bytes").agg(F.count(F.lit(1)).alias("shard_rows"))

    def _rows(self, shards: DataFrame, names: dict[str, str]) -> DataFrame:
        """Rows of ``shards``: the store's columns under new ``names`` beside those of ``shards``."""
        folders = [r[0] for r in shards.select(F.regexp_extract("shard", "^(data/[^/]+)/", 1)).distinct().collect()]
        if not folders:
            renamed = [F.lit(None).cast(f.dataType).alias(names[f.name]) for f in self.schema.fields]
            return shards.limit(0).select(*renamed, *shards.columns)
        rows, shard, _ = self._files(folders)
        named = rows.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()), shard.alias("shard_of_row"))
        return named.join(shards, F.col("shard_of_row") == F.col("shard")).drop("shard_of_row")

    def plan(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
        """shard, run: runs of similar shards worth merging, numbered from 0.

        Works on manifest rows, not on data.  A tier of more than RANGE_RUNS target sizes is planned
        in ranges, each by a task of its own.
        """
        tier = F.floor(F.log(F.greatest("shard_bytes", F.lit(1))) / F.log(F.lit(float(TIER_FACTOR))))
        small = self.manifest().where(F.col("shard_bytes") < target_bytes / 2).withColumn("tier", tier)
        ranges = small.groupBy("tier").agg(F.ceil(F.sum("shard_bytes") / (float(target_bytes) * RANGE_RUNS)).alias("ranges"))
        dealt = small.join(ranges, "tier").withColumn("part", F.pmod(F.xxhash64("shard"), F.col("ranges")))
        so_far = Window.partitionBy("tier", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        nth = F.floor(F.coalesce(F.sum("shard_bytes").over(so_far), F.lit(0)) / target_bytes)
        runs = dealt.withColumn("nth", nth).groupBy("tier", "part", "nth").agg(F.count(F.lit(1)).alias("n"), F.sum("shard_bytes").alias("size"))
        worth = runs.where((F.col("n") > 1) & ((F.col("n") >= fanout) | (F.col("size") >= target_bytes / 2)))
        # Runs are numbered by range, so only a row per range meets in one place.
        first = worth.groupBy("tier", "part").agg(F.count(F.lit(1)).alias("runs"))
        before = F.coalesce(F.sum("runs").over(Window.orderBy("tier", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = F.row_number().over(Window.partitionBy("tier", "part").orderBy("nth")) - 1
        numbered = worth.withColumn("inside", inside).join(first.withColumn("before", before), ["tier", "part"])
        numbered = numbered.select("tier", "part", "nth", (F.col("before") + F.col("inside")).cast("int").alias("run"))
        return dealt.withColumn("nth", nth).join(numbered, ["tier", "part", "nth"]).select("shard", "run")

    def compact(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> bool:
        """One round of merging; False if there was nothing to merge."""
        before = self.version()
        plan = staged(self.plan(target_bytes, fanout), "plan")
        last = plan.agg(F.max("run")).first()[0]
        if last is None:
            return False
        stored = {f.name: f"c{i}" for i, f in enumerate(self.schema.fields)}
        rows = self._rows(plan, stored)
        run = "run"
        while run.lower() in (n.lower() for n in self.schema.names):
            run += "_"
        dealt = rows.select(*(F.col(new).alias(old) for old, new in stored.items()), F.col("run").alias(run))
        folder = f"data/{uuid.uuid4().hex}"
        # One task and one file for each run.
        dealt.repartitionById(last + 1, F.col(run)).write.partitionBy(run).option("compression", "zstd").parquet(f"{self.path}/{folder}")
        kept = self.manifest(before).join(plan.select("shard"), "shard", "left_anti")
        self.commit(kept.unionByName(self._written(folder)), before)
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of a version with shard, shard_rows, shard_bytes and version (in place of columns so named)."""
        version = self.version() if version is None else version
        stored = {f.name: f"c{i}" for i, f in enumerate(self.schema.fields)}
        rows = self._rows(self.manifest(version), stored)
        own = [n for n in self.schema.names if n.lower() not in ("shard", "shard_rows", "shard_bytes", "version")]
        return rows.select(*(F.col(stored[n]).alias(n) for n in own), "shard", "shard_rows", "shard_bytes", F.lit(version).alias("version"))

    def expire(self) -> int:
        """Deletes data files that the last version doesn't use; returns how many.

        The folders are listed one by one, so the names of one folder are held at a time.
        """
        manifest = self.manifest().withColumn("folder", F.regexp_extract("shard", "^(data/[^/]+)/", 1))
        folder, fs = self._fs(f"{self.path}/data")
        gone = 0
        for status in fs.listStatus(folder):
            name = f"data/{status.getPath().getName()}"
            used = {r["shard"] for r in manifest.where(F.col("folder") == name).select("shard").toLocalIterator()}
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                path = files.next().getPath()
                found = re.search(r"/(data/[^/]+/.*)$", path.toString())
                if found and found[1].endswith(".parquet") and found[1] not in used:
                    gone += bool(fs.delete(path, False))
        return gone


def shard_documents(df: DataFrame, path: str | None = None, target_bytes: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Appends ``df`` to a new store, compacts until nothing is worth merging, and reads it back.

    Every row of ``df``, repeated or not and with whatever nulls, is in one shard; the result
    has its columns with shard, shard_rows, shard_bytes and version.  An empty table gives an
    empty first version.
    """
    store = ShardStore(df.sparkSession, path or new_path(df.sparkSession, "shards"), df.schema)
    store.append(df, arrival_rows)
    while store.compact(target_bytes):
        pass
    return store.read()
