"""Streams of documents: the page pipeline needs no state, late pages need none either."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.layout_xml import read_layout


def layout_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of layout files as they arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.xml").load(folder)
    return read_layout(files.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("xml")))


def line_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per window and type, for events no later than ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
