"""Streaming jobs: the batch operators over streams, with watermarks, stateful processors and per-batch lookups.

Rows behind a watermark are dropped: no late side output. Every job that writes can be stopped and started again on its
checkpoint; batches are written under their number and replace themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokenize
from ..operators import changes, logs, stats, wide
from ..sources import ledger, sinks
from ..sources.versions import DimStore
from . import state


def log_stream(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with the repaired flag, dirty lines) of a stream of (seq, value)."""
    good, dirty = logs.parse_log(lines)
    flat = good.select("seq", "common.*", F.to_json("start").alias("start"), F.to_json(F.struct("page.*")).alias("page"), F.to_json("displays").alias("displays"), "ts")
    return state.repair_is_new(flat), dirty


def flag_stream(records: DataFrame, path: str, checkpoint: str, keep: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64, available: bool = False) -> StreamingQuery:
    """Records of a stream (mid, is_new, seq and others) with the repaired flag, as log_stream() has it, to path/rows/batch=N:
    `keep` picks what is written. A device's first place that says new is a row of the store path/first, so a batch is an
    aggregation and a join over all its devices, where log_stream() calls Python for each. A batch that is done again finds
    its places stored and writes the same rows. `seq` must be unique within a device."""

    def write(batch: DataFrame, n: int) -> None:
        store = DimStore(batch.sparkSession, f"{path}/first", "mid", buckets)
        rows = batch.persist()
        try:
            if n not in store.published():
                first, base = logs.first_new(rows, order=("seq",)), store.newest(n)
                if base is not None:
                    first = first.join(store.dim(base), "mid", "left_anti")
                store.upsert(first, n, "first.seq", ["first"])
            flagged = logs.keep_first(rows, store.dim(n), order=("seq",))
            (keep(flagged) if keep else flagged).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        finally:
            rows.unpersist()

    return each_batch(records, checkpoint, write, available)


def unique_visits(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """First entry to arrive of each device and day. A key lives a day of event time, so it can't come twice on its day."""
    rows = pages.where(F.col("last_page_id").isNull()).withColumn("visit_date", F.to_date("event_time"))
    return rows.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["mid", "visit_date"])


def user_jumps(pages: DataFrame, within_ms: int = 10_000, delay: str = "2 seconds") -> DataFrame:
    return state.user_jumps(pages, within_ms, delay)


def first_visits(pages: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """As unique_visits, but the first in event time, whatever comes first."""
    return state.first_visits(pages, delay)


def to_topic(df: DataFrame, path: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Rows of a stream as Parquet files, each exactly once; streams that read the folder see finished batches only."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available else writer).start()


def visitor_stats(pages: DataFrame, visits: DataFrame, jumps: DataFrame, window: str = "10 seconds", delay: str = "13 seconds") -> DataFrame:
    """Windows over pages, unique visits and bounces. The three come from topics: a bounce is known only `within` after its
    page, when the page's window is closed for a query that has but one watermark."""
    return stats.visitor_stats(pages, visits, jumps, window, delay)


def product_stats(parts: dict[str, tuple[DataFrame, str | None]], window: str = "10 seconds") -> DataFrame:
    """Sums over the product rows of several inputs, each with its own delay: (rows, delay) by name, None for rows of a join,
    which have the watermark of what was joined. The least watermark closes
    windows. Orders are counted exactly across batches: the first level holds a row for each order until its window is
    closed, the second sums what the first has closed. Dimensions are joined per batch (stats_stream)."""
    marked = [rows.withWatermark("event_time", delay) if delay else rows for rows, delay in parts.values()]
    return stats.sum_products(stats.union_products(marked), window, None)


def payment_times(payments: DataFrame, record_time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Event time of payments, by default with rows in ascending order; unparsable times fall back to the record's."""
    parsed = F.try_to_timestamp(F.col("create_time").cast("string"), F.lit("yyyy-MM-dd HH:mm:ss"))
    time = F.coalesce(parsed, F.col(record_time)) if record_time else parsed
    return payments.withColumn("create_ts", time).withWatermark("create_ts", delay)


def order_wide(info: DataFrame, detail: DataFrame, delay: str = "2 seconds", **interval: str) -> DataFrame:
    return wide.order_wide(info, detail, delay=delay, **interval)


def payment_wide(info: DataFrame, detail: DataFrame, payments: DataFrame, delay: str = "2 seconds", payment_delay: str = "0 seconds", record_time: str | None = None,
                 order_interval: tuple[str, str] = ("-2 seconds", "2 seconds"), payment_interval: tuple[str, str] = ("-5 seconds", "15 minutes")) -> DataFrame:
    """Payments joined to a stream that is a join itself: its rows carry the order's event time, so the watermark comes through
    and both joins forget what can't match any more. Payment times that can't be read fall back to `record_time`."""
    orders = order_wide(info, detail, delay, lower=order_interval[0], upper=order_interval[1])
    return wide.payment_wide(orders, payment_times(payments, record_time, payment_delay), *payment_interval)


def retract_stream(log: DataFrame, pk: str = "id") -> DataFrame:
    return state.retractions(log, pk)


def table_stream(log: DataFrame, path: str, checkpoint: str, pk: str = "id", buckets: int = 64, available: bool = False) -> StreamingQuery:
    """Keeps the current table of a change log as a versioned store: of each batch's retract stream the last row of a key
    counts; keys that were taken back and not sent again are gone from dim()."""

    def write(batch: DataFrame, n: int) -> None:
        last = batch.groupBy("key").agg(F.max_by(F.struct("flag", "row"), F.struct("seq", "step")).alias("r"), F.max("seq").alias("seq"))
        rows = last.select("seq", F.col("key").alias(pk), F.when(F.col("r.flag"), F.to_json("r.row")).alias("row"))
        DimStore(batch.sparkSession, path, pk, buckets).upsert(rows, n, null_overwrites=True)

    writer = state.retractions(log, pk).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update")
    return (writer.trigger(availableNow=True) if available else writer).start()


def province_stats(orders: DataFrame, window: str = "10 seconds", delay: str = "2 seconds") -> DataFrame:
    return stats.province_stats(orders, window, delay)


def keyword_stats(pages: DataFrame, window: str = "10 seconds", delay: str = "2 seconds") -> DataFrame:
    return stats.keyword_stats(tokenize(stats.keyword_pages(pages), "full_word"), window, delay)


def each_batch(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], available: bool = False) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available else writer).start()


def route_stream(envelopes: DataFrame, load_rules: Callable[[], DataFrame], path: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Routes changes by the rules as they are when each batch starts; facts and dims go to one folder per table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = changes.route(changes.drop_deletes(batch), load_rules()).where("route in ('fact', 'dim')")
        sinks.write_routed(changes.filter_columns(rows), path, batch_id)

    return each_batch(envelopes, checkpoint, write, available)


def dim_stream(rows: DataFrame, path: str, checkpoint: str, pk: str = "id", seq: str = "seq", null_overwrites: bool = False, buckets: int = 64, keep: int | None = 3,
               available: bool = False) -> StreamingQuery:
    """Upserts a dimension store from a stream of its changed rows; version N is the state after batch N. A batch rewrites the
    buckets of its keys only, and done again it changes nothing; `keep` versions stay for readers."""

    def write(batch: DataFrame, n: int) -> None:
        DimStore(batch.sparkSession, path, pk, buckets).upsert(batch, n, seq, null_overwrites=null_overwrites, keep=keep)

    return each_batch(rows, checkpoint, write, available)


def stats_table_stream(df: DataFrame, dims: Callable[[DataFrame], DataFrame], url: str, table: str, query: str, checkpoint: str, available: bool = False, **options: str) -> StreamingQuery:
    """As stats_stream, to a database table, each batch exactly once (see ledger.py)."""
    return each_batch(df, checkpoint, ledger.writer(url, table, query, dims, **options), available)


def stats_stream(df: DataFrame, dims: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Writes aggregates with dimension columns. `dims` is called for each batch: with DimStore.dim() in it, a batch sees the
    newest version that was published when it began, whole, and never one that is being written."""
    return each_batch(df, checkpoint, lambda batch, n: sinks.write_stats(dims(batch), path, n), available)
