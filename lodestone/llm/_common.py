"""Helpers shared by the training-data operators: the shared work folder, staged tables, hashes of words."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words in every operator of this subpackage.
SPACE = r"\x20\x09-\x0D"
#: Words whose hashes a Python worker keeps (about 25 MB).
KEPT_WORDS = 1 << 17

#: Folders of staged tables that nobody has deleted yet.
_staged: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only in local mode, as in tests, may it be unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/lodestone/{uuid.uuid4().hex}-{name}"


def compacted(df: DataFrame, bytes_each: int = 16 << 20) -> DataFrame:
    """`df` in fewer partitions, joined without a shuffle, where they are small: about `bytes_each` of the plan's input each,
    two for each core at least. Tables of many tiny files and tasks cost more in files, processes and workers than in work."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // bytes_each))
    return df.coalesce(most) if most < 1 << 20 else df


def staged(df: DataFrame, name: str, rows_a_file: int = 0, counting: Column | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until `dropped` or the end of the driver's program. Rows of megabytes need small files
    (`rows_a_file`), as writers and readers hold a file's part of a column in memory. With `counting`, the rows for which it
    is true are counted while they are written, for `n_rows`: no query of its own counts them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _staged[path] = spark
    seen = Observation() if counting is not None else None
    rows = df.observe(seen, F.count(F.when(counting, 1)).alias("rows")) if seen else df
    compacted(rows).write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    if seen:
        out._lodestone_rows = int(seen.get["rows"])
    return out


def n_rows(df: DataFrame) -> int:
    """What was counted while the table was staged; of other tables, their rows."""
    found = getattr(df, "_lodestone_rows", None)
    return df.count() if found is None else found


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """While it is open, what a query shuffles leaves the disks as soon as the query ends: for large tables that are
    staged, as no later query reads those shuffles."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """While it is open, rows go to Python in Arrow batches of about so many bytes: for staged tables whose rows are of
    megabytes, as else ten thousand rows, that is a task's whole part, are held at once on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_lodestone_path", None)
        if path and path in _staged:
            _delete(_staged.pop(path), path)


@atexit.register
def _drop_all() -> None:
    for path, spark in _staged.items():
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session or its JVM is gone: the folder is cleaned as a whole then
            return


def key_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under their own names: other columns can't clash with results."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


class WordHashes(dict):
    """64-bit hashes of words, made once each; a full table starts anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


#: One table for all operators that run in a Python worker.
word_hashes = WordHashes()
