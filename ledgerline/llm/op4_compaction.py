"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as the small Parquet files their tasks write. Compaction takes the
shards of one size tier, where at least ``FANOUT`` have gathered, and rewrites them as
files of about the target size: tasks read several shards and write one file, without a
shuffle. Each change is a new manifest, the full list of live shards, written aside and
committed by an atomic rename to the next version (HDFS and local folders have one; an
object store without needs a file system layer that does); a reader uses one version
throughout, and of two writers of the same version one fails and starts anew. Files that no manifest
names, such as those of failed tasks, are never read and go with ``vacuum``.

All data move through DataFrame readers and writers; the driver only renames and lists.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.workspace import folder

from .scratch import free, written

NAME = "op4_compaction"
TARGET_BYTES = 64 << 20
SMALL_BYTES = 1 << 20
FANOUT = 4
ARRIVALS = 8
MOST_FILES = 10_000
_MANIFEST = "path string, bytes long, rows long, tier int"


class VersionTaken(Exception):
    """Another writer has committed this version first."""


class ShardStore:
    """Shards under a URI. ``version`` is that of the last manifest seen, 0 before any."""

    def __init__(self, spark: SparkSession, uri: str, target: int = TARGET_BYTES, small: int = SMALL_BYTES, fanout: int = FANOUT):
        self.spark, self.uri, self.target, self.small, self.fanout = spark, uri, target, small, fanout
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.version = self.latest()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")

    def latest(self) -> int:
        """The last committed version."""
        where = self._path("manifests")
        fs = where.getFileSystem(self._conf)
        if not fs.exists(where):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return max([int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()], default=0)

    def shards(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: path, bytes, rows, tier."""
        version = self.version if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.uri}/manifests/v{version:08d}")

    def _tier(self):
        level = F.floor(F.log(F.greatest(F.col("bytes") / self.small, F.lit(1.0))) / F.log(F.lit(float(self.fanout))))
        return level.cast("int")

    def _listed(self, place: str, schema) -> DataFrame:
        """The files under a path with their sizes and rows, from the files' footers."""
        files = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(place)
        found = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        found = found.groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return found.select("path", "bytes", "rows", self._tier().alias("tier"))

    def _commit(self, manifest: DataFrame) -> int:
        """The manifest becomes the next version, or VersionTaken is raised and nothing has changed."""
        aside, version = f"manifests/_{uuid.uuid4().hex}", self.version + 1
        manifest.coalesce(1).write.parquet(f"{self.uri}/{aside}")
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        try:
            context.rename(self._path(aside), self._path(f"manifests/v{version:08d}"), options)
        except Exception as e:
            self._path(aside).getFileSystem(self._conf).delete(self._path(aside), True)
            raise VersionTaken(f"version {version} of {self.uri}") from e
        self.version = version
        return version

    def append(self, df: DataFrame) -> int:
        """One arrival, as the files that the tasks of ``df`` write; returns the new version."""
        place = f"{self.uri}/data/{uuid.uuid4().hex}"
        df.write.parquet(place)
        return self._commit(self.shards().unionByName(self._listed(place, df.schema)))

    def append_arrivals(self, df: DataFrame, arrival) -> int:
        """Several arrivals written by one job, told apart by the column ``arrival``; a version for each, in its order."""
        place = f"{self.uri}/data/{uuid.uuid4().hex}"
        (name,) = free(df.columns, "_arrival")
        df.withColumn(name, arrival).write.partitionBy(name).parquet(place)
        listed = written(self._listed(place, df.schema).withColumn("arrival", F.regexp_extract("path", f"/{name}=([^/]*)/", 1).cast("long")), "arrivals")
        for key in sorted(r[0] for r in listed.select("arrival").distinct().collect()):
            self._commit(self.shards().unionByName(listed.where(F.col("arrival") == key).drop("arrival")))
        return self.version

    def compact(self, schema) -> int:
        """Merges tiers with enough shards below the target size until none is left; returns the version."""
        while True:
            small = self.shards().where(F.col("bytes") < self.target / 2)
            tiers = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout).orderBy("tier").collect()
            if not tiers:
                return self.version
            before = self.version
            for t in tiers:
                run = [r.path for r in small.where(F.col("tier") == t.tier).orderBy("bytes", "path").limit(MOST_FILES).collect()]
                share = t.bytes * len(run) / t.n
                files = max(1, round(share / self.target))
                if files >= len(run):
                    continue
                place = f"{self.uri}/data/{uuid.uuid4().hex}"
                self.spark.read.schema(schema).parquet(*run).coalesce(files).write.parquet(place)
                gone = self.spark.createDataFrame([(p,) for p in run], "path string")
                self._commit(self.shards().join(gone, "path", "left_anti").unionByName(self._listed(place, schema)))
            if self.version == before:
                return self.version

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        paths = [r.path for r in self.shards(version).select("path").toLocalIterator()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, age: float = 86_400.0) -> int:
        """Deletes files that none of the last ``keep`` manifests names and that are older than ``age`` seconds, as one may belong to an append that is yet to commit; returns how many."""
        oldest = (time.time() - age) * 1000
        fs = self._path("data").getFileSystem(self._conf)
        live = {r.path.rsplit("/data/", 1)[1] for v in range(max(1, self.version - keep + 1), self.version + 1) for r in self.shards(v).select("path").toLocalIterator()}
        found, gone = fs.listFiles(self._path("data"), True), 0
        while found.hasNext():
            status = found.next()
            path = status.getPath()
            if path.getName().endswith(".parquet") and status.getModificationTime() <= oldest and path.toString().rsplit("/data/", 1)[1] not in live:
                gone += bool(fs.delete(path, False))
        return gone


def round_trip(docs: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """``docs`` after ``arrivals`` appends (by doc_id; without one: the first) and compaction, read from the last version.

    All columns and rows come back as they were, nulls, repeated rows and empty texts
    too; an empty table stays empty, with its schema.
    """
    store = ShardStore(docs.sparkSession, folder(docs.sparkSession, "shards"))
    store.append_arrivals(docs, F.coalesce(F.pmod("doc_id", F.lit(arrivals)), F.lit(0)).cast("int"))
    store.compact(docs.schema)
    return store.read(docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"
