"""Sinks: topics, routed topics, statistics, dimension snapshots. Folders can be written again for one batch without doubling
rows; brokers and JDBC tables get a repeated batch twice, whose rows carry its number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import latest_by_key


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_topic(df: DataFrame, path: str, batch_id: int = 0) -> None:
    """One JSON text per row, to a topic kept as a folder of text files; a batch that is written again replaces itself."""
    rows = as_json(df).withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").text(path)


def write_kafka(rows: DataFrame, servers: str, topic: str | None = None, checkpoint: str | None = None) -> StreamingQuery | None:
    """Rows of (value), or of (topic, value) where each row names its topic, to a broker: a batch, or, with a checkpoint, a
    stream. The connector must be on the class path."""
    options = {"kafka.bootstrap.servers": servers} | ({"topic": topic} if topic else {})
    if checkpoint:
        return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    rows.write.format("kafka").options(**options).save()
    return None


def write_stats_jdbc(df: DataFrame, url: str, table: str, batch_id: int = 0, columns: list[str] | None = None, **options: str) -> None:
    """Appends aggregates and their batch's number to a table over JDBC, one connection per partition. A batch that is done
    again is there twice; ledger.write_once() has each batch once."""
    rows = df.select(*(columns or df.columns)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def routed(df: DataFrame, sink_table: str = "sinkTable", payload: str = "after") -> DataFrame:
    """(topic, value): the topic comes from the row, the value is the payload alone."""
    return df.select(F.col(sink_table).alias("topic"), F.to_json(payload).alias("value"))


def write_routed(df: DataFrame, path: str, batch_id: int, files: int = 8) -> None:
    """One pass over the rows for all targets; a batch that is written again replaces itself."""
    rows = routed(df).withColumn("batch_id", F.lit(batch_id).cast("long"))
    # hashing the topic with a few salts bounds the number of files without sending a hot topic to one task
    rows.repartition(files, "topic", F.pmod(F.xxhash64("value"), F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "topic").text(path)


def write_stats(df: DataFrame, path: str, batch_id: int = 0, columns: list[str] | None = None) -> None:
    """Aggregates by day of the window start; columns that aren't stored are left out. Repeating a batch replaces it."""
    rows = df.select(*(columns or df.columns)).withColumn("dt", F.to_date("stt")).withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(path)


def upsert_dim(snapshot: DataFrame | None, changes: DataFrame, pk: str = "id", seq: Column | str = "seq", columns: list[str] | None = None, null_overwrites: bool = False) -> DataFrame:
    """New snapshot of a dimension: per key the latest value of each column; columns that a change lacks keep theirs, and
    columns that only the changes have are added."""
    fresh = latest_by_key(changes, pk, seq, columns, null_overwrites)
    if snapshot is None:
        return fresh
    keep = [c for c in snapshot.columns if c != pk]
    old = snapshot.select(F.col(pk).alias("_pk"), *(F.col(c).alias(f"_{c}") for c in keep))
    both = old.join(fresh, F.col("_pk") == F.col(pk), "full")

    def value(c: str) -> Column:
        if c not in keep or c not in fresh.columns:
            return F.col(c) if c in fresh.columns else F.col(f"_{c}")
        return F.when(F.col(pk).isNotNull(), F.col(c)).otherwise(F.col(f"_{c}")) if null_overwrites else F.coalesce(F.col(c), F.col(f"_{c}"))

    names = keep + [c for c in fresh.columns if c != pk and c not in keep]
    return both.select(F.coalesce(pk, "_pk").alias(pk), *(value(c).alias(c) for c in names))
