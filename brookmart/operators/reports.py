"""Report queries of one day over the statistics tables. Ties in rankings go to the smaller key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_day(stats: DataFrame, date: str) -> DataFrame:
    """Rows whose window starts on the day (yyyy-MM-dd). Stored statistics have the day as a partition (dt), so that other
    days aren't read; otherwise the comparisons reach the scan."""
    if "dt" in stats.columns:
        stats = stats.where(F.col("dt") == F.lit(date).cast("date"))
    return stats.where((F.col("stt") >= f"{date} 00:00:00") & (F.col("stt") <= f"{date} 23:59:59"))


def gmv(stats: DataFrame, date: str) -> DataFrame:
    return of_day(stats, date).agg(F.sum("order_amount").alias("order_amount"))


def _ranked(stats: DataFrame, date: str, keys: list[str], limit: int, positive: bool = True, **more: Column) -> DataFrame:
    out = of_day(stats, date).groupBy(*keys).agg(F.sum("order_amount").alias("order_amount"), *(c.alias(n) for n, c in more.items()))
    if positive:
        out = out.where("order_amount > 0")
    return out.orderBy(F.desc("order_amount"), *keys).limit(limit)


def gmv_by_trademark(stats: DataFrame, date: str, limit: int = 10) -> DataFrame:
    return _ranked(stats, date, ["tm_id", "tm_name"], limit)


def gmv_by_category3(stats: DataFrame, date: str, limit: int = 10) -> DataFrame:
    return _ranked(stats, date, ["category3_id", "category3_name"], limit)


def gmv_by_spu(stats: DataFrame, date: str, limit: int = 10) -> DataFrame:
    return _ranked(stats, date, ["spu_id", "spu_name"], limit, order_ct=F.sum("order_ct"))


def gmv_by_tm_name(stats: DataFrame, date: str, limit: int = 5) -> DataFrame:
    return _ranked(stats, date, ["tm_name"], limit, positive=False)


def amount_by_province(stats: DataFrame, date: str) -> DataFrame:
    return of_day(stats, date).groupBy("province_id", "province_name").agg(F.sum("order_amount").alias("order_amount"))


MEASURES = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")


def visitors_by_new_flag(stats: DataFrame, date: str) -> DataFrame:
    return of_day(stats, date).groupBy("is_new").agg(*(F.sum(c).alias(c) for c in MEASURES))


def visitors_by_hour(stats: DataFrame, date: str) -> DataFrame:
    hour = F.substring("stt", 12, 2).cast("int")
    return of_day(stats, date).groupBy(hour.alias("hr")).agg(
        F.sum(F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)).alias("new_uv"), *(F.sum(c).alias(c) for c in ("uv_ct", "pv_ct", "uj_ct"))).orderBy("hr")


def fill_hours(by_hour: DataFrame) -> DataFrame:
    """24 rows, zeros where there is no data; hours as two digits."""
    hours = by_hour.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    values = [c for c in by_hour.columns if c != "hr"]
    return hours.join(by_hour, "hr", "left").select(F.lpad(F.col("hr").cast("string"), 2, "0").alias("hr"), *(F.coalesce(c, F.lit(0)).alias(c) for c in values))


def visitor_ratios(flags: DataFrame) -> DataFrame:
    """Bounce percentage, seconds and pages per visit; rounding is half up, zero without visitors."""
    d = lambda c: F.col(c).cast("decimal(18,0)")
    none = F.col("uv_ct") == 0
    ratio = lambda x, scale: F.when(none, F.lit(0).cast(f"decimal(18,{scale})")).otherwise(x.cast(f"decimal(18,{scale})"))
    bounce = F.round(F.try_divide(d("uj_ct") * 100, d("sv_ct")), 2)
    seconds = F.round(F.round(F.try_divide(d("dur_sum"), d("sv_ct")), 0) / 1000, 1)
    pages = F.round(F.try_divide(d("pv_ct"), d("sv_ct")), 2)
    return flags.select("*", ratio(bounce, 2).alias("uj_rate"), ratio(seconds, 1).alias("dur_per_sv"), ratio(pages, 2).alias("pv_per_sv"))


def visitor_table(flags: DataFrame) -> DataFrame:
    """Five measures by new and old; whatever isn't '1' is old, and a side without rows is zero."""
    side = F.when(F.col("is_new") == "1", "new").otherwise("old")
    stack = ", ".join(f"'{m}', cast({m} as bigint)" for m in MEASURES)
    long = flags.select(side.alias("flag"), F.expr(f"stack({len(MEASURES)}, {stack}) as (measure, value)"))
    return long.groupBy("measure").pivot("flag", ["new", "old"]).agg(F.sum("value")).na.fill(0, ["new", "old"])


#: Weights of a keyword's sources.
WEIGHTS = {"SEARCH": 10, "ORDER": 3, "CART": 2, "CLICK": 1}


def keyword_ranking(stats: DataFrame, date: str, limit: int = 20) -> DataFrame:
    """Weighted counts, ranked by the unweighted ones. Sources are compared without regard to case."""
    weight = F.lit(0)
    for source, w in WEIGHTS.items():
        weight = F.when(F.upper("source") == source, w).otherwise(weight)
    out = of_day(stats, date).groupBy("keyword").agg(F.sum(F.col("ct") * weight).alias("ct"), F.sum("ct").alias("n"))
    return out.orderBy(F.desc("n"), "keyword").limit(limit).drop("n")
