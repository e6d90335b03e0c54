"""Behaviour log: parse, split, repair of the new-visitor flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import LOG


def parse_log(df: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, dirty). Dirty rows, which are malformed or have no device id, keep their raw text. The record is exploded from an
    array of one, since Spark would move filters on a plain column below it and parse (and make) the text again for each."""
    record = F.from_json(value, LOG + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = df.select("*", F.explode(F.array(record)).alias("_r"))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull() | F.col("_r.common.mid").isNull()
    rest = [c for c in df.columns if c != value]
    fields = [F.col(f"_r.{f}") for f in ("common", "start", "page", "displays", "ts")]
    good = parsed.where(~bad).select(*rest, *fields).withColumn("event_time", F.timestamp_millis("ts"))
    return good, parsed.where(bad).select(*df.columns)


def split_start(df: DataFrame) -> DataFrame:
    return df.where(F.col("start").isNotNull())


def split_page(df: DataFrame) -> DataFrame:
    return df.where(F.col("start").isNull())


def split_displays(pages: DataFrame) -> DataFrame:
    """One row per display of a page record, with the page's id; other columns than `seq` are pruned before the explode."""
    keep = [c for c in ("seq",) if c in pages.columns]
    rows = pages.select(*keep, F.col("page.page_id").alias("page_id"), F.posexplode("displays").alias("pos", "display"))
    return rows.select(*keep, "pos", "display.*", "page_id")


def repair_is_new_by_first(df: DataFrame, mid: str = "mid", is_new: str = "is_new", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """repair_is_new() for logs in which one device may hold most rows: the least place that says new comes from an aggregation
    with partial sums, and goes back by a join, whose hot keys Spark splits (or broadcasts away). The order must be unique."""
    return keep_first(df, first_new(df, mid, is_new, order), mid, is_new, order)


def first_new(df: DataFrame, mid: str = "mid", is_new: str = "is_new", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """(mid, first): the least place at which each device says new."""
    return df.where(F.col(is_new) == "1").groupBy(mid).agg(F.min(F.struct(*order)).alias("first"))


def keep_first(df: DataFrame, first: DataFrame, mid: str = "mid", is_new: str = "is_new", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Rows that say new elsewhere than at their device's place in `first` say so no more."""
    rows = df.join(first.select(F.col(mid).alias("_mid"), F.col("first").alias("_first")), F.col(mid) == F.col("_mid"), "left")
    return rows.withColumn(is_new, F.when((F.col(is_new) == "1") & (F.struct(*order) != F.col("_first")), "0").otherwise(F.col(is_new))).drop("_mid", "_first")


def repair_is_new(df: DataFrame, mid: str = "mid", is_new: str = "is_new", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Of a device's rows that say new, only the first keeps it. One exchange by device, which visits reuse."""
    w = Window.partitionBy(mid).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.col(is_new) == "1"
    so_far = F.sum(new.cast("int")).over(w)
    return df.withColumn(is_new, F.when(new & (so_far > 1), "0").otherwise(F.col(is_new)))
