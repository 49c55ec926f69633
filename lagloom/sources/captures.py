"""Captured stream metadata: a line of JSON for each poll of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "stream string, ts timestamp, content_type string, codec string, format string, bitrate int, sample_rate int, channels int, station string, genre string, "
    "title string, media_sequence bigint, headers map<string, string>, connection_ms bigint, bytes_received bigint, average_bitrate double, buffer_health double"
)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def stream_captures(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream: files that turn up in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
