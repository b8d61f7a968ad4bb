"""Writes with the store's rules: fresher wins, unique keys, guarded snapshots, time to live.

Plain Parquet has no MERGE. A table here is a folder of versions; an upsert writes the
merged rows as a new version and commits it with a marker named by the version alone, put
there by a rename that fails if it exists, so readers see the old or the new version and a lost writer leaves only unread files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merged(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``; of equals the fresh one. A keyed maximum over the union: one shuffle, no join."""
    both = stored.withColumn("_f", F.lit(0)).unionByName(fresh.withColumn("_f", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_f")]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, F.col("_f"))).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def overlaid(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: fresh values where they are known, else stored ones; keys of either side."""
    rest = [c for c in stored.columns if c not in keys]
    both = stored.withColumn("_f", F.lit(0)).unionByName(fresh.withColumn("_f", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_f"))).alias(c) for c in rest))


def unique(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows whose key isn't stored, one of each."""
    return fresh.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def live(df: DataFrame, stamped: str, now: Column, seconds: int) -> DataFrame:
    """Cached rows younger than their time to live."""
    return df.where(now - F.col(stamped) < seconds)


class VersionTaken(RuntimeError):
    """Another writer has committed this version first."""


class Table:
    """A versioned table under a URI."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def version(self) -> int:
        where = self._path("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        marker = self._fs.open(self._path(f"commits/{version or self.version():08d}"))
        name = self.spark._jvm.org.apache.commons.io.IOUtils.toString(marker, "UTF-8")
        marker.close()
        return self.spark.read.parquet(f"{self.uri}/data/{name}")

    def _commit(self, version: int, name: str) -> None:
        """The marker, written aside with the data's name, becomes the version's by a rename that fails if there is one."""
        aside = self._path(f"commits/_{name}")
        out = self._fs.create(aside, False)
        out.write(name.encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, self._path(f"commits/{version:08d}"), options)
        except Exception as e:
            self._fs.delete(aside, False)
            raise VersionTaken(f"version {version} of {self.uri} was committed meanwhile") from e

    def publish(self, df: DataFrame, least: float | None = None, after: int | None = None) -> bool:
        """Writes the version after ``after`` (the present one), or raises VersionTaken. With ``least``, only if it has that share of the present rows: a thin snapshot never replaces a full one."""
        name, before = uuid.uuid4().hex, self.version() if after is None else after
        df.write.parquet(f"{self.uri}/data/{name}")
        if least is not None and before:
            new, old = self.spark.read.parquet(f"{self.uri}/data/{name}").count(), self.read(before).count()
            if new < least * old:
                self._fs.delete(self._path(f"data/{name}"), True)
                return False
        self._fs.mkdirs(self._path("commits"))
        self._commit(before + 1, name)
        return True

    def upsert(self, fresh: DataFrame, keys: list[str], order: list[Column]) -> bool:
        """Merges fresh rows into the version that it reads; of two writers that read the same one, one fails."""
        seen = self.version()
        return self.publish(merged(self.read(seen) if seen else fresh.limit(0), fresh, keys, order), after=seen)
