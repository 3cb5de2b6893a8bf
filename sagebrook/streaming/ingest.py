"""Incremental ingestion: files to chunks to vectors to the store, by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sagebrook.functions.chunkers import Chunker
from sagebrook.models import Embed, embed
from sagebrook.operators.chunking import chunk
from sagebrook.sources.snapshots import ChunkStore, SnapshotTable, from_chunks
from sagebrook.storage import dropped, written


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(source, document) of the text files that arrive in a folder."""
    return spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("document"))


#: What the table of failures holds of a chunk.
FAILED = T.StructType([T.StructField(n, T.StringType()) for n in ("source", "content", "error")] + [T.StructField("start_byte", T.LongType())])


def failures(store: ChunkStore) -> SnapshotTable:
    """Chunks whose embedding failed (source, content, error, start_byte), beside the store."""
    return SnapshotTable(store.spark, f"{store.path}-failed", FAILED, "start_byte")


def ingest(stream: DataFrame, store: ChunkStore, chunker: Chunker, function: Embed, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Chunks and embeds new documents and appends them to the store; each micro-batch is one append.

    Batches are known by checkpoint and number, so one that is run again after a crash is stored once.  Chunks whose embedding failed
    go to the table of :func:`failures`.
    """

    def append(batch: DataFrame, epoch: int) -> None:
        pieces = chunk(batch.select("source", "document"), chunker, "document", ["source"])
        done = written(embed(pieces, function), "embedded")
        failures(store).insert(done.where("error IS NOT NULL"), (checkpoint, epoch))
        store.insert(from_chunks(done.where("error IS NULL").drop("error")), (checkpoint, epoch))
        dropped(done)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
