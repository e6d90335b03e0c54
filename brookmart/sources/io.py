"""Sources: topics, log files, tables, change logs. Batch and streaming share one interface."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import typed_changes
from .segments import read_segments


def read_topic(spark: SparkSession, topic: str, servers: str | None = None, starting: str | None = None, stream: bool = False, path: str | None = None, segments: bool = False) -> DataFrame:
    """value STRING of each record of a topic. With `path`, the topic is a folder of text files, one record per line, or, with
    `segments`, of records with partition, offset and timestamp as a broker has them (see segments.py). Without `starting`, streams begin at the latest record and batches at the earliest; a batch can't begin at the latest."""
    if not stream and starting == "latest":
        raise ValueError("a batch has an end; it can't start at the latest record")
    if path is not None and segments:
        return read_segments(spark, path, starting, stream)
    if path is not None:
        lines = (spark.readStream if stream else spark.read).text(path)
        return lines.select("value")
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", starting or ("latest" if stream else "earliest"))
    return reader.load().select(F.col("value").cast("string").alias("value"), "topic", "partition", "offset", "timestamp")


def read_json_lines(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """Raw application log: one JSON text per line of daily files."""
    if stream:
        return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return spark.read.text(path)


def lower_camel(name: str) -> str:
    return re.sub(r"_+([a-z0-9])", lambda m: m[1].upper(), name.lower())


def read_table(spark: SparkSession, url: str, query: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
               partitions: int = 16, camel: bool = False, **options: str) -> DataFrame:
    """Result of a query over JDBC, read in parallel by ranges of a numeric column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    found = reader.load()
    return camel_columns(found) if camel else found


def camel_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*map(lower_camel, df.columns))


def read_typed_changelog(spark: SparkSession, path: str, columns: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(changes, rejects) of a change log whose row images have typed columns (DDL); see changes.typed_changes()."""
    return typed_changes(read_topic(spark, "", stream=stream, path=path), columns)


def read_changelog(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Change envelopes as JSON lines: a snapshot (type read) and then changes."""
    from ..schemas import CHANGE

    lines = read_topic(spark, "", stream=stream, path=path)
    return lines.select(F.from_json("value", CHANGE).alias("r")).select("r.*")
