"""The same plans on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cloakwork.functions.patterns import Registry
from cloakwork.operators.detect import detect, masked


def inbox(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def once(stream: DataFrame, id_col: str = "doc_id", time_col: str = "received_at", within: str = "1 day") -> DataFrame:
    """Rows whose id wasn't seen within the watermark, so a file dropped twice counts once. Rows later than
    that are left out; state is bounded by the watermark."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col])


def redacted(stream: DataFrame, registry: Registry | None = None, least: float | None = 0.60) -> DataFrame:
    """The stream with its texts masked: row by row, without state."""
    return masked(stream, registry=registry, least=least)


def detections(stream: DataFrame, registry: Registry | None = None, keep: tuple[str, ...] = ("doc_id", "received_at")) -> DataFrame:
    return detect(stream, registry=registry, keep=keep)


def hourly(found: DataFrame, time_col: str = "received_at", late: str = "2 hours", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Detections by window and type, tumbling or sliding; windows close when the watermark passes."""
    span = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    grouped = found.withWatermark(time_col, late).groupBy(span, "entity_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "entity_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a document, ts apart by less than the gap, as one session each."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "doc_id").agg(F.count("*").alias("n"))
    return grouped.select("doc_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def start(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """The stream written to parquet until the inbox is empty. each: a plan for whole batches, such as
    de-duplication within documents; a batch that is run again overwrites what it wrote."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is None:
        return writer.format("parquet").outputMode("append").start(path)

    def run(batch: DataFrame, number: int) -> None:
        each(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return writer.foreachBatch(run).start()
