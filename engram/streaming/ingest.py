"""Continuous ingest, directories that are followed, and access statistics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engram.memory import Memory


def ingest_stream(memory: Memory, docs: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Feed a stream of (text, and perhaps context and path) into ``memory``.

    The content hash makes a batch that is delivered again a no-op, so effects
    are exactly once."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: memory.add_texts(batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def access_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Accesses of each entry in each window of a stream (or table) of (hash, at)."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "hash").agg(F.count("*").alias("n"), F.max("at").alias("last"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(hash, start, end, n, first, last) of the sessions of each entry in a stream (or table) of
    (hash, at): accesses no more than ``gap`` apart.

    The state of a stream holds open sessions alone, keyed by entry; accesses that
    come later than ``late`` behind the latest one are left out.  An access that is delivered again,
    with the same ``id`` if there is such a column, counts once."""
    events = events.withWatermark("at", late)
    if "id" in events.columns:
        events = events.dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else events.dropDuplicates(["id"])
    window = F.session_window("at", gap)
    found = events.groupBy(window.alias("w"), "hash").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return found.select("hash", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "first", "last")


def follow_directory(memory: Memory, directory: str, checkpoint: str, context: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Let ``memory`` follow ``directory`` while files come: each time the stream of new files has
    some, the directory is synchronised as a whole, so changed and removed files are
    followed too.  A batch that is delivered again changes nothing."""
    spark = memory.spark
    arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(directory).select("path")

    def follow(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            memory.add_directory(directory, context)

    writer = arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(follow)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
