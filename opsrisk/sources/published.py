"""Tables and models in versions: writers add a version beside the live one, then move a pointer to it."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from opsrisk.session import path_exists

# Spark's readers pass over names that start like this
_POINTER = "_live"


def _store(spark: SparkSession, path: str):
    """The file system of a path and the path in it."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Name the live version of what is kept at ``path``.

    The pointer is written beside the old one and renamed over it, which the file
    systems that Spark writes to do as one step: readers see the old version or
    the new one.
    """
    jvm = spark.sparkContext._jvm
    store, fresh = _store(spark, f"{path}/{_POINTER}-{uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fresh.toUri() if fresh.toUri().getScheme() else store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/{_POINTER}"), over)


def published(spark: SparkSession, path: str) -> str | None:
    """The live version of what is kept at ``path``; none before the first is published."""
    pointer = f"{path}/{_POINTER}"
    if not path_exists(spark, pointer):
        return None
    store, found = _store(spark, pointer)
    held = store.open(found)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    held.close()
    return text


def versions(spark: SparkSession, path: str) -> list[str]:
    """The versions that lie at ``path``, live or not."""
    if not path_exists(spark, path):
        return []
    store, found = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(found) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    store, found = _store(spark, path)
    store.delete(found, True)


class VersionedTable:
    """A table that is replaced as a whole, for results that are small and change often.

    Each version is a folder. A version is written, the pointer moved to it, and
    all others removed. After a crash the pointer still names a whole version;
    what lies beside it is removed by the next replacement. There is one writer.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def live(self) -> str | None:
        return published(self.spark, self.path)

    def read(self) -> DataFrame:
        """The live version; empty before the first."""
        live = self.live()
        if live is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{live}")

    def replace(self, rows: DataFrame, version: str) -> None:
        """Make ``rows``, which may come from the live version, the new one."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{version}")
        publish(self.spark, self.path, version)
        for old in versions(self.spark, self.path):
            if old != version:
                remove(self.spark, f"{self.path}/{old}")

    def merge(self, rows: DataFrame, keys: list[str], version: str) -> None:
        """Replace the rows of the same keys and add those of new keys; a version that is live or past is left alone.

        So a micro-batch that is repeated after a failure changes nothing more.
        Keys are compared null-safe.
        """
        live = self.live()
        if live is not None and live >= version:
            return
        kept = self.read()
        same = [kept[key].eqNullSafe(rows[key]) for key in keys]
        self.replace(kept.join(rows, same, "left_anti").unionByName(rows.select(*self.schema.names)), version)
