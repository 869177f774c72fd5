"""Incremental ingestion of notes: an extension, the rebuild of the service being all or nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode


def follow_notes(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Calls each(notes, batch number) with the notes that are new since the last call, once each, and returns the ended query."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(shape).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    notes = stream.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), decode(F.col("content")).alias("text"))
    query = notes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
