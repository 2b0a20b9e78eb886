"""The scan on streams: it keeps no state, so a stream of documents is scanned as a table is. Windowed counts are an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..operators.scan import detections


def scan_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], cfg: ScanConfig | None = None) -> StreamingQuery:
    """Scan Parquet files as they arrive and append masked detections to ``target``; ends when what is there is done."""
    arriving = spark.readStream.schema(schema).parquet(source)
    writer = detections(arriving, keys, cfg).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(target)


def windowed_counts(events: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type and time window; on a stream the watermark bounds the state."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", length, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by user: events closer than the gap belong together."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
