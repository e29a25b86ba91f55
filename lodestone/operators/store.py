"""Versioned snapshots of keyed tables on plain Parquet: copy on write, then one pointer flips for all of them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", hash_col: str = "content_hash") -> DataFrame:
    """key and change of every key on either side: created, updated, unchanged or deleted. Null hashes compare as equal."""
    before = old.select(key, F.col(hash_col).alias("_old"), F.lit(True).alias("_in_old"))
    after = new.select(key, F.col(hash_col).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "created").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return before.join(after, key, "full_outer").select(key, change.alias("change"))


def changed(old: DataFrame, new: DataFrame, key: str = "id", hash_col: str = "content_hash", force: bool = False) -> DataFrame:
    """The new rows whose key is absent from the old ones or has another hash there (all of them if forced)."""
    if force:
        return new
    before = old.select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"))
    joined = new.join(before, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col("_key").isNull() | ~F.col("_hash").eqNullSafe(F.col(hash_col))).select(*new.columns)


def compared(old: DataFrame, new: DataFrame, within: str, key: str = "id", hash_col: str = "content_hash", force: bool = False) -> DataFrame:
    """The new rows with _created (the key is absent from the old ones) and _changed (created, or of another hash; all if
    forced). `within` is a column that a key determines: who deals by it alone (see `dealt_within`) shuffles no new row that
    has been dealt so."""
    before = old.select(F.col(within).alias("_within"), F.col(key).alias("_key"), F.col(hash_col).alias("_hash"))
    joined = new.join(before, (F.col(within) == F.col("_within")) & (F.col(key) == F.col("_key")), "left")
    marked = joined.withColumn("_created", F.col("_key").isNull())
    return marked.withColumn("_changed", F.lit(True) if force else F.col("_created") | ~F.col("_hash").eqNullSafe(F.col(hash_col))).drop("_within", "_key", "_hash")


@contextmanager
def dealt_within(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside may use rows that are dealt by a part of their keys; the session's setting is restored."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def upserted(old: DataFrame, delta: DataFrame, key: str = "id", removed: DataFrame | None = None) -> DataFrame:
    """The old rows without the delta's keys, and the delta. `removed`, if given, has the keys to leave out, the delta's
    and others."""
    return old.join((delta if removed is None else removed).select(key), key, "left_anti").select(*old.columns).unionByName(delta.select(*old.columns))


def deleted(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The old rows without those keys."""
    return old.join(keys.select(key), key, "left_anti").select(*old.columns)


class SnapshotStore:
    """Tables under one root; a version holds all of them, and CURRENT names the version that readers see.

    Writers make the next version's folder and then replace the pointer by rename, so readers see all tables of one
    version, or the one before. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, T.StructType]) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    @property
    def version(self) -> int:
        """The current version; 0 before the first write."""
        pointer = f"{self.root}/CURRENT"
        if not self._fs.exists(self._path(pointer)):
            return 0
        return int(self.spark.read.text(pointer).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the current version, or of a given one; empty with its schema before the first write.

        Who reads several tables takes `version` once, so that a commit in between doesn't mix two versions.
        """
        version = self.version if version is None else version
        if not version:
            # A filter that lets nothing through tells Spark, before it runs, that joins with the table have no rows.
            return self.spark.createDataFrame([], self.schemas[name]).where(F.lit(False))
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/v{version}/{name}")

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version and make it current; tables not given stay as they are."""
        last = self.version
        version = last + 1
        for name, schema in self.schemas.items():
            df = tables[name] if name in tables else self.read(name, last)
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/v{version}/{name}")
        fresh, pointer = self._path(f"{self.root}/NEXT"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(fresh, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(pointer), options)
        return version

    def staged(self, df: DataFrame) -> DataFrame:
        """The rows, read back from files under the root: what several tables are made of is computed once and is held in no
        executor's memory, and each table reads only the columns that it needs. `unstage` deletes the files."""
        path = f"{self.root}/staged/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def unstage(self) -> None:
        """Delete what was staged; there is one writer at a time."""
        self._fs.delete(self._path(f"{self.root}/staged"), True)

    def clear(self) -> int:
        """An empty version."""
        return self.commit({name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()})
