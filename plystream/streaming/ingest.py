"""Resumable ingest: files are taken in micro-batches, and the checkpoint remembers which are done."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, files: int = 100, every: str | None = None) -> None:
    """Appends the new files of a folder of Parquet to ``sink``, exactly once; a second call takes only what came since.

    ``files`` bounds what a batch holds, and so what is lost if one fails. With ``every``, a time such as '30 seconds', the
    query goes on and flushes in that interval; the caller stops it."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    append(stream, sink, checkpoint, every)


def append(stream: DataFrame, sink: str, checkpoint: str, every: str | None = None):
    """Runs a stream into a Parquet folder until what there is is taken, or goes on by an interval and returns the query."""
    return started(stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint), stream.sparkSession, every)


def started(writer: DataStreamWriter, spark: SparkSession, every: str | None = None):
    """Until what there is is taken, only batches with data run: timers by the clock would ask for empty ones for ever, and are
    looked at with the next data. By an interval they run in their time."""
    if every is not None:
        return writer.trigger(processingTime=every).start()
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        query = writer.trigger(availableNow=True).start()  # has a copy of the settings from here on
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a stream's output or progress, in ``spark.checkpoint.dir``; only without one, on one machine, a
    temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        shared = "file://" + tempfile.mkdtemp(prefix="plystream-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
