"""Incremental ingestion of new files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Embedder
from ..operators.store import SnapshotStore
from ..plans.ingest import commit_changes, embedded, staged_chunks
from ..sources.markdown import checked, front_matter, texts_of


def stream_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """path, as `scan_markdown` spells it, and raw text of markdown files as they appear."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return texts_of(spark, files, folder)


def ingest_available(spark: SparkSession, store: SnapshotStore, folder: str, embedder: Embedder, checkpoint: str, max_chunk_tokens: int = 1500) -> StreamingQuery:
    """Bring the chunks of all files with names not seen before into the store, and stop.

    Chunks that the store has of such a file, and the file hasn't, are deleted; a file with a bad header fails the query.
    A file stream tells nothing of removed files, nor of files rewritten under their name: their chunks stay as they are
    until `ingest_folder` or `ingest_incremental`, which name chunks alike and so add none twice.
    """

    def batch(files: DataFrame, _: int) -> None:
        version = store.version
        old = store.read("chunks", version)
        gone = None
        try:
            documents = store.staged(checked(front_matter(files, ends=True)))
            chunks = staged_chunks(store, old, documents, max_chunk_tokens)
            work = embedded(store, chunks, embedder)
            gone = old.join(documents.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id").join(chunks.select("id"), "id", "left_anti").persist()
            if chunks.where("_changed").limit(1).count() or gone.limit(1).count():
                commit_changes(store, version, work, gone)
        finally:
            if gone is not None:
                gone.unpersist()
            store.unstage()

    return stream_markdown(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
