"""Structured Streaming: windowed metrics with late data, and ingest with the rules of the batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import scratch_dir
from tidewell.sources.storage import is_folder


def windowed(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, their sum and latest time by type and window. Windows are closed, and their state dropped, once the latest
    event is ``late`` ahead of them; rows that come after that are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", length).alias("w"), "event_type")
    out = by.agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("latest"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "total", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


def drained(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is there now, and give the last state of each of its rows, told apart by ``keys``.

    Output is in update mode: each batch writes the rows that changed, under its number, so that a batch that is run again
    after a failure replaces its own. State is bounded by the watermark.
    """
    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, "last.*").select(*stream.columns)


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly metrics of the events table, read as a stream."""
    path = f"{folder}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads folders; a table that is one file is picked out of its folder
    stream = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return drained(windowed(stream), "windows", ["window_start", "event_type"])


def ingest(stream: DataFrame, clean, sink, checkpoint: str) -> object:
    """Start a stream whose batches go through ``clean`` (the batch rules) and then to ``sink(batch, number)``.

    ``checkpoint`` is a folder that outlives the run: a later start goes on where this one ended. ``sink`` may see a batch
    again after a failure and should replace what it wrote under that number.
    """
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: sink(clean(batch), number)).start()
