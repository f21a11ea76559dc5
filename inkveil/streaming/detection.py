"""Detection and masking on streams. Both look at one row at a time, so a stream needs no state and no watermark.

This is an extension: the same columns that serve tables serve streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from inkveil.functions.patterns import Pattern
from inkveil.operators import detect


def document_stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 64) -> DataFrame:
    """Documents of the Parquet files that arrive in folder, at most so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def match_stream(docs: DataFrame, patterns: list[Pattern], text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The matches of each document as it arrives."""
    return detect.matches(docs, patterns, text, keys)


def masked_stream(docs: DataFrame, patterns: list[Pattern], text: str = "text") -> DataFrame:
    """The documents with their matches masked."""
    return detect.masked(docs, patterns, text)


def write_stream(found: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files, each row once, and end when what is there has been read."""
    return found.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
