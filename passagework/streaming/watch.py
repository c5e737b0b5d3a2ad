"""Continuous indexing: new and changed files become batches of a store.

`watch` follows a source that only adds files (or rows): Spark remembers what it has
taken. `watch_folder` looks at a folder again and again, and so also sees files that
were changed in place or deleted.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from passagework.functions.text import valid_text
from passagework.plans.incremental import change_set
from passagework.plans.store import Store, commits, stored_before, stream_batch, update, write_batch
from passagework.schemas import BINARY_FILE
from passagework.sources.listing import describe, list_files, read_texts


def folder_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Files below `root` as they appear: path, size_bytes, modified, content."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .load(root)
    )
    return raw.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
        valid_text(F.col("content")).alias("content"),
    )


def last_versions(batch: DataFrame) -> DataFrame:
    """One row per path: the version modified last. Only keys are compared, texts stay where they are."""
    rows = batch.withColumn("_place", F.monotonically_increasing_id())
    version = F.struct("modified", "size_bytes", "_place")
    newest = rows.groupBy("path").agg(F.max(version).alias("_newest")).select("_newest")
    # The place names a row, so one key is enough.
    return rows.join(newest.select(F.col("_newest._place").alias("_place")), "_place", "left_semi").drop("_place")


def not_older(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows that are no older than the stored version of their path."""
    known = stored.select("path", F.col("modified").alias("_was"))
    return rows.join(known, "path", "left").filter("_was is null or modified is null or modified >= _was").drop("_was")


def watch(
    stream: DataFrame, store: Store, checkpoint: str, interval: str | None = None, all_files: bool = False,
    described: bool = False,
) -> StreamingQuery:
    """Write every micro-batch of a file stream into the store, which may hold files already.

    The stream keeps no state. A micro-batch becomes the next batch of the store, whose
    commit names the checkpoint and the micro-batch: one that runs again after a failure
    finds its number and replaces its earlier attempt. A version that arrives after a
    newer one of its path is left out. Without `interval` all files present are taken
    and the query ends. `described` streams carry full file rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = stream_batch(store, spark, checkpoint, number)
        rows = last_versions(batch)
        files = rows if described else describe(rows, datetime.now())
        if any(c.batch < own for c in commits(store, spark)):
            files = not_older(files, stored_before(store, spark, own))
        write_batch(store, files, own, all_files=all_files, stream=checkpoint, epoch=number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def refresh(
    spark: SparkSession, root: str, store: Store, batch: int | None = None, all_files: bool = False, stream: str | None = None,
    epoch: int | None = None,
) -> bool:
    """Bring the store up to date with a folder as batch `batch` or the next one; False if nothing changed."""
    names = list_files(spark, root)
    begun = batch is not None and any(c.batch == batch for c in commits(store, spark))
    if not begun and change_set(stored_before(store, spark, batch), names).filter(F.col("change") != "same").isEmpty():
        return False
    texts = describe(read_texts(spark, root), datetime.now())
    update(store, texts, batch, all_files, names, stream, epoch)
    return True


def watch_folder(
    spark: SparkSession, root: str, store: Store, checkpoint: str, interval: str = "5 seconds", all_files: bool = False
) -> StreamingQuery:
    """Refresh the store from a folder at every interval. The store must hold a batch.

    The ticks of a rate stream name the passes, so a pass that runs again after a
    failure replaces its own batch.
    """

    def look(_: DataFrame, number: int) -> None:
        own = stream_batch(store, spark, checkpoint, number)
        refresh(spark, root, store, own, all_files, checkpoint, number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", "1").load()
    return (
        ticks.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )
