"""Streams: an extension, as batch and stream share the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, moment: str = "ts", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by kind in tumbling windows; on a stream, those later than ``late`` are dropped. The time zone is the session's."""
    e = events.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, late)
    g = e.groupBy(F.window(moment, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str = "user_id", moment: str = "ts", gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a key: its events with less than ``gap`` between them."""
    e = events.withColumn(moment, F.col(moment).cast("timestamp")).withWatermark(moment, late)
    g = e.groupBy(F.session_window(moment, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def new_files(spark: SparkSession, folder: str, schema, kind: str = "parquet") -> DataFrame:
    """Files that arrive in a folder, each read once; with ``trigger(availableNow=True)`` what a rerun skips is already done."""
    return spark.readStream.schema(schema).format(kind).load(folder)
