"""Streams whose state is Parquet. A batch is one join or one aggregation over its rows and the kept ones, with exchanges as any
batch query has them, and only what later batches may need is kept: a whole table in one batch leaves the rows near its end,
where a state store takes in every row first.

    path/rows/batch=N      what batch N sends on
    path/kept/N            rows that batches after N may need
    path/marks/N.json      each input's newest time up to batch N, put there last
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import stats, wide
from ..sources.versions import Files
from .streams import each_batch

#: Newest time of each input and the watermark, in microseconds.
Marks = dict[str, int]


class Kept:
    """Rows and marks by batch. A batch that is done again finds what the one before it kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark, path)

    def batches(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/marks") if n.endswith(".json"))

    def newest(self) -> tuple[DataFrame | None, Marks]:
        done = self.batches()
        if not done:
            return None, {}
        return self.spark.read.parquet(f"{self.path}/kept/{done[-1]}"), json.loads(self.files.read(f"{self.path}/marks/{done[-1]}.json"))

    def put(self, n: int, rows: DataFrame, marks: Marks) -> None:
        done = self.batches()
        rows.write.mode("overwrite").parquet(f"{self.path}/kept/{n}")
        self.files.put(f"{self.path}/marks/{n}.json", json.dumps(marks))
        for old in done:
            self.files.delete(f"{self.path}/marks/{old}.json")
            self.files.delete(f"{self.path}/kept/{old}")


def newer(marks: Marks, seen: dict[str, int | None], delays: dict[str, timedelta]) -> Marks:
    """Marks after a batch, with the watermark: the least of the inputs' newest times, each less its delay. It never falls."""
    found = marks | {k: max(v, marks.get(k, v)) for k, v in seen.items() if v is not None}
    least = min((found[k] - delay // timedelta(microseconds=1) for k, delay in delays.items() if k in found), default=None)
    return found if least is None else found | {"watermark": max(least, marks.get("watermark", least))}


def watermark(marks: Marks) -> Column | None:
    return F.timestamp_micros(F.lit(marks["watermark"])) if "watermark" in marks else None


def _newest(time: str, k: str) -> Column:
    return F.max(F.when(F.col("_in") == k, F.unix_micros(time))).alias(k)


def interval_join(left: DataFrame, right: DataFrame, on: tuple[str, str], times: tuple[str, str], lower: timedelta, upper: timedelta, delays: tuple[timedelta, timedelta],
                  path: str, checkpoint: str, available: bool = False, pick: Callable[[DataFrame], DataFrame] = lambda joined: joined) -> StreamingQuery:
    """Inner equi-join of two streams with right time in [left time + lower, left time + upper], as wide.interval_join() with
    delays has it; `pick` makes its rows. Column names must differ between the sides."""
    sides, late = {"left": left, "right": right}, dict(zip(("left", "right"), delays, strict=True))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (
        df.withColumn("_in", F.lit(k)).withColumn("_time", F.col(t)) for (k, df), t in zip(sides.items(), times, strict=True)))

    def write(batch: DataFrame, n: int) -> None:
        state = Kept(batch.sparkSession, path)
        if n in state.batches():
            return
        before, marks = state.newest()
        passed = watermark(marks)
        fresh = batch if passed is None else batch.where(F.col("_time") > passed)
        part = lambda df, k: df.where(F.col("_in") == k).select(*sides[k].columns)
        near = F.col(times[1]).between(F.col(times[0]) + F.lit(lower), F.col(times[0]) + F.lit(upper))
        meet = lambda a, b: part(a, "left").join(part(b, "right"), (F.col(on[0]) == F.col(on[1])) & near)
        joined = [meet(fresh, fresh)] if before is None else [meet(fresh, fresh), meet(fresh, before), meet(before, fresh)]
        pick(reduce(DataFrame.unionByName, joined)).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        marks = newer(marks, batch.agg(*(_newest("_time", k) for k in sides)).first().asDict(), late)
        every = fresh if before is None else fresh.unionByName(before)
        if (passed := watermark(marks)) is not None:
            reach = F.when(F.col("_in") == "left", F.col("_time") + F.lit(upper)).otherwise(F.col("_time") - F.lit(lower))
            every = every.where(reach >= passed)
        state.put(n, every, marks)

    return each_batch(rows, checkpoint, write, available)


def order_wide(info: DataFrame, detail: DataFrame, lower: timedelta, upper: timedelta, delays: tuple[timedelta, timedelta], path: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    return interval_join(
        wide.prefixed(info, "i_"), wide.prefixed(detail, "d_"), ("i_id", "d_order_id"), ("i_create_ts", "d_create_ts"), lower, upper, delays, path, checkpoint, available, wide.order_columns)


def payment_wide(orders: DataFrame, payments: DataFrame, lower: timedelta, upper: timedelta, delays: tuple[timedelta, timedelta], path: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Payments joined to a topic of wide orders."""
    return interval_join(
        orders, wide.prefixed(payments, "p_"), ("order_id", "p_order_id"), ("create_ts", "p_create_ts"), lower, upper, delays, path, checkpoint, available, wide.payment_columns)


def product_stats(parts: dict[str, tuple[DataFrame, timedelta]], path: str, checkpoint: str, window: str = "10 seconds", available: bool = False) -> StreamingQuery:
    """Sums over the product rows of several inputs, each with its own delay, as streams.product_stats() has them. Windows that
    the least watermark closes are sent on with the batch that closes them; of others a row for each order is kept."""
    late = {k: delay for k, (_, delay) in parts.items()}
    rows = reduce(DataFrame.unionByName, (df.withColumn("_in", F.lit(k)) for k, (df, _) in parts.items()))

    def write(batch: DataFrame, n: int) -> None:
        state = Kept(batch.sparkSession, path)
        if n in state.batches():
            return
        before, marks = state.newest()
        seen = Observation()
        fresh = stats.order_rows(batch.observe(seen, *(_newest("event_time", k) for k in parts)), window)
        if (passed := watermark(marks)) is not None:
            fresh = fresh.where(F.col("window.end") > passed)
        orders = stats.sum_orders(fresh if before is None else fresh.unionByName(before))
        orders.write.mode("overwrite").parquet(f"{path}/orders")
        orders = batch.sparkSession.read.schema(orders.schema).parquet(f"{path}/orders")
        if not orders.isEmpty():  # an empty exchange may take the observation with it
            marks = newer(marks, seen.get, late)
        passed = watermark(marks)
        closed = F.lit(False) if passed is None else F.col("window.end") <= passed
        stats.products_of_orders(orders.where(closed)).write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
        state.put(n, orders.where(~closed), marks)
        state.files.delete(f"{path}/orders")

    return each_batch(rows, checkpoint, write, available)
