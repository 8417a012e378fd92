"""Structured Streaming over JSON lines: row operators, rolling rollups, periodic saves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_jsonl(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """New files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def transformed(stream: DataFrame, function: Callable, text_col: str = "text") -> DataFrame:
    """A row operator over a stream; stateless."""
    return stream.withColumn("new_text", function(F.col(text_col)))


def first_seen(stream: DataFrame, keys: list[str], time_col: str, delay: str = "1 hour") -> DataFrame:
    """Each key once; keys older than the watermark are forgotten."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_accuracy(stream: DataFrame, time_col: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Mean score and count per function and time window, for late rows up to ``delay``."""
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, window), "function_name")
        .agg(F.avg("score").alias("accuracy"), F.count("*").alias("examples"))
    )


def saved(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Every batch written once, under its number, so that a repeated batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
