"""Unique visits and bounces of devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def entries(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("last_page_id").isNull())


def unique_visits(pages: DataFrame, mid: str = "mid", time: str = "event_time", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """First entry of each device and day. min_by aggregates before the shuffle, so a busy device costs no more than others."""
    rows = entries(pages)
    first = rows.groupBy(mid, F.to_date(time).alias("visit_date")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return first.select("r.*", "visit_date")


def followed(pages: DataFrame, slice: str | None = None, mid: str = "mid", time: str = "event_time", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """pages with `_next` and `_next_entry`: time of the device's next row, and whether that is an entry.

    With `slice` (an interval) a device's rows are dealt out by slices of its time, so that a device that holds most rows is
    spread over tasks: each slice is a window of its own, and its last row takes the head of the device's next slice, from a
    table with one row for a device and slice. The order must follow the time."""
    entry = F.col("last_page_id").isNull()
    if slice is None:
        w = Window.partitionBy(mid).orderBy(*order)
        return pages.withColumn("_next", F.lead(time).over(w)).withColumn("_next_entry", F.lead(entry).over(w))
    cut = pages.withColumn("_slice", F.window(time, slice)["start"])
    w = Window.partitionBy(mid, "_slice").orderBy(*order)
    after = F.struct(F.col(time).alias("time"), entry.alias("entry"))
    rows = cut.withColumn("_after", F.lead(after).over(w))
    heads = cut.groupBy(mid, "_slice").agg(F.min_by(after, F.struct(*order)).alias("_head"))
    heads = heads.select(F.col(mid).alias("_mid"), F.col("_slice").alias("_of"), F.lead("_head").over(Window.partitionBy(mid).orderBy("_slice")).alias("_then"))
    both = rows.join(heads, F.col(mid).eqNullSafe(F.col("_mid")) & (F.col("_slice") == F.col("_of")))
    then = F.coalesce("_after", "_then")
    return both.withColumn("_next", then["time"]).withColumn("_next_entry", then["entry"]).drop("_slice", "_after", "_mid", "_of", "_then")


def jumps(within: str, time: str = "event_time") -> Column:
    """Over followed() rows: an entry without a next row, or whose next row is an entry or comes at least `within` later."""
    return F.col("last_page_id").isNull() & (F.col("_next").isNull() | F.col("_next_entry") | (F.col("_next") >= F.col(time) + F.expr(f"interval {within}")))


def user_jumps(pages: DataFrame, within: str = "10 seconds", mid: str = "mid", time: str = "event_time", order: tuple[str, ...] = ("ts", "seq"), slice: str | None = None) -> DataFrame:
    """Entries whose device has no later row, or whose next row is an entry or comes at least `within` later."""
    return followed(pages, slice, mid, time, order).where(jumps(within, time)).drop("_next", "_next_entry")
