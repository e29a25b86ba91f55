"""Ingestion: a folder of markdown to the current snapshot of chunks, postings and vectors."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.chunker import chunk_documents, last_of_each_id
from ..operators.models import Embedder, given_beside, with_embeddings
from ..operators.sparse import exploded, idf_scores, replaced
from ..operators.store import SnapshotStore, compared, dealt_within, upserted
from ..sources.markdown import list_local, list_markdown, local_root, markdown_files, read_documents, read_listed, read_local, small_files
from .retrieval import Index

TABLES = {"chunks": schemas.STORED_CHUNK, "postings": schemas.POSTING, "indexed": schemas.INDEXED, "colbert": schemas.MULTI_VECTOR, "files": schemas.SOURCE_FILE}


class IngestionError(RuntimeError):
    """A scan that would empty the store."""


@dataclass(frozen=True)
class IngestionStats:
    documents_processed: int
    chunks_created: int
    chunks_updated: int
    chunks_deleted: int
    embedding_time_seconds: float
    indexing_time_seconds: float
    total_time_seconds: float


def open_store(spark: SparkSession, root: str) -> SnapshotStore:
    return SnapshotStore(spark, root, TABLES)


def ingest_full(spark: SparkSession, store: SnapshotStore, source: str, embedder: Embedder, force: bool = False, max_chunk_tokens: int = 1500, allow_empty: bool = False) -> IngestionStats:
    """Bring the store up to date with the folder; see `ingest_documents`."""
    return ingest_documents(spark, store, read_documents(spark, source, ends=True), embedder, force, max_chunk_tokens, allow_empty)


def ingest_incremental(spark: SparkSession, store: SnapshotStore, source: str, embedder: Embedder) -> IngestionStats:
    """The same without force: unchanged chunks are left alone either way."""
    return ingest_full(spark, store, source, embedder)


def ingest_documents(spark: SparkSession, store: SnapshotStore, documents: DataFrame, embedder: Embedder, force: bool = False, max_chunk_tokens: int = 1500, allow_empty: bool = False) -> IngestionStats:
    """Chunk, compare with the stored hashes, embed what changed, and write all tables as one new version.

    Chunks of the store that are not in the folder any more are deleted; a scan without chunks is refused while the
    store has some, unless allow_empty. Of chunks with one id the last in its document counts. With force all chunks
    are embedded anew and counted as updated. Inverse document frequencies follow from the final postings.
    """
    start = time.monotonic()
    version = store.version
    old = store.read("chunks", version)
    gone = None
    try:
        chunks = staged_chunks(store, old, documents, max_chunk_tokens, force)
        created, changed = F.count(F.when(F.col("_created"), 1)), F.count(F.when(F.col("_changed"), 1))
        n_files, n_chunks, n_created, n_todo = chunks.agg(F.countDistinct("file_path"), F.count(F.lit(1)), created, changed).first()
        if not n_chunks and not allow_empty and old.limit(1).count():
            raise IngestionError("The scan found no chunks; nothing was changed")
        begun = time.monotonic()
        work = embedded(store, chunks, embedder)
        done = time.monotonic()
        gone = old.select("id").join(chunks.select("id"), "id", "left_anti").persist()
        n_gone = gone.count()
        if n_todo or n_gone:
            commit_changes(store, version, work, gone)
        end = time.monotonic()
        return IngestionStats(int(n_files), int(n_created), int(n_todo - n_created), int(n_gone), done - begun, end - done, end - start)
    finally:
        if gone is not None:
            gone.unpersist()
        store.unstage()


def staged_chunks(store: SnapshotStore, old: DataFrame, documents: DataFrame, max_chunk_tokens: int = 1500, force: bool = False) -> DataFrame:
    """The documents' chunks, staged, with _created and _changed beside the old ones; unchanged ones without their text."""
    chunks = last_of_each_id(chunk_documents(documents, max_chunk_tokens))
    marked = compared(old, chunks, "file_path", force=force)
    with dealt_within(store.spark):
        return store.staged(marked.withColumn("text", F.when(F.col("_changed"), F.col("text"))))


def embedded(store: SnapshotStore, chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """The changed ones of staged chunks with their embeddings: a model's are staged, as it is asked once; plain expressions
    are left to each table that needs them. No executor keeps vectors, which are many times as large as the texts."""
    work = with_embeddings(embedder, chunks.where("_changed").drop("_created", "_changed"), "id", "text")
    return work if given_beside(embedder) else store.staged(work)


def commit_changes(store: SnapshotStore, version: int, work: DataFrame, gone: DataFrame, files: DataFrame | None = None) -> None:
    """Write the version after `version`: embedded chunks (`work`) in place of those of their ids, without those that are
    gone (id), and with the files that the chunks come from, if they are given."""
    fresh = work.withColumn("dense_vector", F.col("dense").cast("array<float>")).withColumn("ingestion_timestamp", F.current_timestamp())
    ids, lost = work.select(F.col("id").alias("chunk_id")), gone.select(F.col("id").alias("chunk_id"))
    vectors = work.select(F.col("id").alias("chunk_id"), "vecs")
    # What is gone is nothing that is fresh, so each stored table meets both in one join, and fresh rows meet none.
    out = ids.unionByName(lost)
    store.commit({
        "chunks": upserted(store.read("chunks", version), fresh, removed=out.withColumnRenamed("chunk_id", "id")),
        "postings": replaced(store.read("postings", version), exploded(work, "id"), out),
        "indexed": replaced(store.read("indexed", version), ids, out),
        "colbert": replaced(store.read("colbert", version), vectors, out),
        **({} if files is None else {"files": files}),
    })


@dataclass(frozen=True)
class FolderStats:
    files_seen: int
    files_read: int
    files_removed: int
    chunks_created: int
    chunks_updated: int
    chunks_deleted: int


def ingest_folder(spark: SparkSession, store: SnapshotStore, source: str, embedder: Embedder, max_chunk_tokens: int = 1500, allow_empty: bool = False) -> FolderStats:
    """Bring the store up to date with a folder of markdown, and open only files that are new or changed since last time.

    The store keeps each file's time of change and length. A listing, which opens no file, tells which differ or are gone:
    those that differ are read and chunked, and chunks of either that their files don't have any more are deleted. Nothing
    is read or written where nothing differs. The chunks are those of `ingest_full`; a change that keeps a file's time and
    length goes unseen until then. An empty folder is refused while the store has files, unless allow_empty. The folder is
    listed once, and small files are read many to a task. Tasks list and open a local or mounted folder themselves; one of
    another store is listed by Spark's reader, whose driver keeps a record of each file.
    """
    with small_files(spark):
        return _ingest_folder(spark, store, source, embedder, max_chunk_tokens, allow_empty)


def _ingest_folder(spark: SparkSession, store: SnapshotStore, source: str, embedder: Embedder, max_chunk_tokens: int, allow_empty: bool) -> FolderStats:
    version = store.version
    known, old = store.read("files", version), store.read("chunks", version)
    root = local_root(spark, source)
    files = None if root else markdown_files(spark, source)
    listed = (list_local(spark, source, root) if root else list_markdown(spark, source, files)).persist()
    differ, removed, gone = None, None, None
    try:
        differ = listed.join(known, ["path", "modification_time", "length"], "left_anti").persist()
        removed = known.select("path").join(listed.select("path"), "path", "left_anti").persist()
        (n_seen,), (n_read, since), n_removed = listed.agg(F.count(F.lit(1))).first(), differ.agg(F.count(F.lit(1)), F.min("modification_time")).first(), removed.count()
        if not n_seen and n_removed and not allow_empty:
            raise IngestionError("The folder has no files; nothing was changed")
        if not n_read and not n_removed:
            return FolderStats(n_seen, 0, 0, 0, 0, 0)
        # A folder of new files alone is one listing and one pass; `since` keeps older files closed.
        read = read_local(spark, source, root, differ) if root else read_listed(spark, source, differ, since, files)
        documents = store.staged(read if n_read else read.where(F.lit(False)))
        chunks = staged_chunks(store, old, documents, max_chunk_tokens)
        n_created, n_work = chunks.agg(F.count(F.when(F.col("_created"), 1)), F.count(F.when(F.col("_changed"), 1))).first()
        work = embedded(store, chunks, embedder)
        touched = differ.select("path").unionByName(removed).select(F.col("path").alias("file_path"))
        gone = old.join(touched, "file_path", "left_semi").select("id").join(chunks.select("id"), "id", "left_anti").persist()
        n_gone = gone.count()
        commit_changes(store, version, work, gone, listed)
        return FolderStats(n_seen, n_read, n_removed, n_created, n_work - n_created, n_gone)
    finally:
        for df in (listed, differ, removed, gone):
            if df is not None:
                df.unpersist()
        store.unstage()


def open_index(store: SnapshotStore) -> Index:
    """The current snapshot as an index to search."""
    version = store.version
    postings = store.read("postings", version)
    chunks = store.read("chunks", version).withColumnRenamed("id", "chunk_id")
    return Index(chunks, postings, idf_scores(postings, store.read("indexed", version)), store.read("colbert", version))


def table_stats(store: SnapshotStore) -> DataFrame:
    """The number of stored chunks."""
    return store.read("chunks").agg(F.count(F.lit(1)).alias("chunks"))
