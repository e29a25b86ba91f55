"""Keep an inverted index up to date with a table of documents that grows by files, as a stream that stops when it's done.

    python -m jobs.index_documents SOURCE TARGET CHECKPOINT [--config FILE]

SOURCE is a Parquet file or folder. Each run takes only files that the checkpoint hasn't seen, in micro-batches, and
each micro-batch only documents that are new or have another text than before. TARGET holds the tables of
`lodestone.operators.index`: postings in buckets of tokens, and document frequencies that are kept by their changes, so
that no run counts anew what an earlier one has counted. With `removed_column` in the settings, rows that are true there
take their document out of the index.

A micro-batch has its own folders, which it replaces when it is run again, and reads only those of earlier ones. So a run
that failed, or lost executors, is mended by the next one, and a run over an unchanged source writes nothing.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from lodestone.operators.index import PostingIndex

DEFAULTS: dict[str, Any] = {"id_column": "doc_id", "text_column": "text", "removed_column": "", "buckets": 16, "files_per_bucket": 4, "max_files_per_batch": 64}


def open_index(spark: SparkSession, target: str, settings: dict[str, Any] | None = None, id_type: str = "bigint") -> PostingIndex:
    s = {**DEFAULTS, **(settings or {})}
    return PostingIndex(spark, target, id_type, s["buckets"], s["files_per_bucket"])


def update_index(spark: SparkSession, source: str, target: str, checkpoint: str, settings: dict[str, Any] | None = None) -> dict[str, int]:
    """Bring the index under `target` up to date with the files of `source`, and return what all batches read and wrote.

    An empty or unchanged source adds nothing. Files are taken once, as a stream does: a document is replaced by a later
    file that has it with another text.
    """
    s = {**DEFAULTS, **(settings or {})}
    # As a pattern the path may be a file as well as a folder; a stream's plain path must be a folder.
    source = source.rstrip("/")
    pattern = f"{source[:-1]}[{source[-1]}]" if source[-1].isalnum() else source
    fields = {f.name: f.dataType.simpleString() for f in spark.read.parquet(source).schema.fields}
    names = [s["id_column"], s["text_column"], *([s["removed_column"]] if s["removed_column"] else [])]
    # Only these columns are read; the schema is fixed before the stream begins, as streams want it.
    files = spark.readStream.schema(", ".join(f"`{n}` {fields[n]}" for n in names)).option("maxFilesPerTrigger", s["max_files_per_batch"]).parquet(pattern)
    removed = F.coalesce(F.col(s["removed_column"]).cast("boolean"), F.lit(False)) if s["removed_column"] else F.lit(False)
    rows = files.select(F.col(s["id_column"]).alias("chunk_id"), F.col(s["text_column"]).cast("string").alias("text"), removed.alias("gone"))
    index = open_index(spark, target, s, fields[s["id_column"]]).create()
    total: dict[str, int] = {"batches": 0}

    def batch(documents: DataFrame, number: int) -> None:
        counts = index.add(number, documents.where("NOT gone"), documents.where("gone") if s["removed_column"] else None)
        log.info("batch %d of %s: %s", number, source, counts)
        total["batches"] += 1
        for name, n in counts.items():
            total[name] = total.get(name, 0) + n

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s to %s: %s", source, target, total)
    return total


if __name__ == "__main__":
    command_line("index_documents", ["source", "target", "checkpoint"], "index_documents.json", DEFAULTS, update_index)
