"""Incremental ingest: new files of a folder through operators that work on a document at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx


def stream_documents(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """doc_id, text of the files of a folder as they come; a file is read once."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return files.select(F.regexp_replace(stem, "_cleaned$", "").alias("doc_id"), tx.normalise_newlines(F.decode("content", "UTF-8")).alias("text"))


def ingest(documents: DataFrame, operator: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write what operator makes of each batch of new documents below `output`, a folder for each batch, so that a batch that runs again overwrites itself. once: take what is there and end."""

    def save(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
