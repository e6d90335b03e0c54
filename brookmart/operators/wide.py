"""Wide facts: interval joins of orders, details and payments, and dimension lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive_order_times(df: DataFrame, text: str = "create_time") -> DataFrame:
    t = F.try_to_timestamp(F.col(text).cast("string"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return df.withColumn("create_ts", t).withColumn("create_date", F.date_format("create_ts", "yyyy-MM-dd")).withColumn("create_hour", F.date_format("create_ts", "HH"))


def interval_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, lower: str, upper: str,
                  left_delay: str | None = None, right_delay: str | None = None) -> DataFrame:
    """Inner equi-join with right_time in [left_time + lower, left_time + upper], both ends included. Column names must
    differ between the sides. With delays, both sides get watermarks and the join runs on streams as well."""
    if left_delay is not None:
        left = left.withWatermark(left_time, left_delay)
    if right_delay is not None:
        right = right.withWatermark(right_time, right_delay)
    on = F.col(right_time).between(F.col(left_time) + F.expr(f"interval {lower}"), F.col(left_time) + F.expr(f"interval {upper}"))
    for a, b in keys:
        on = (F.col(a) == F.col(b)) & on
    return left.join(right, on)


#: Columns of the wide order that come from each side; others stay null because nothing sets them.
ORDER_INFO = ("province_id", "order_status", "user_id", "total_amount", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee")
ORDER_DETAIL = ("sku_id", "order_price", "sku_num", "sku_name", "split_total_amount", "split_activity_amount", "split_coupon_amount")
UNSET = ("expire_time", "operate_time", "split_feight_fee")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*(prefix + c for c in df.columns))


def order_wide(info: DataFrame, detail: DataFrame, lower: str = "-2 seconds", upper: str = "2 seconds", delay: str | None = None) -> DataFrame:
    """One row per order detail whose order was made within the interval. Needs create_ts on both sides."""
    return order_columns(interval_join(prefixed(info, "i_"), prefixed(detail, "d_"), [("i_id", "d_order_id")], "i_create_ts", "d_create_ts", lower, upper, delay, delay))


def order_columns(joined: DataFrame) -> DataFrame:
    """The wide order of an order (i_) and its line (d_)."""
    has = set(joined.columns)
    pick = lambda p, names: [F.col(p + c).alias(c) for c in names if p + c in has]
    return joined.select(
        *(F.col(c).alias("detail_id") for c in ("d_id",) if c in has), F.col("i_id").alias("order_id"), *pick("i_", ORDER_INFO), *pick("d_", ORDER_DETAIL),
        *(F.lit(None).cast("string").alias(c) for c in UNSET), F.date_format("i_create_ts", "yyyy-MM-dd").alias("create_date"),
        F.date_format("i_create_ts", "HH").alias("create_hour"), F.col("i_create_ts").alias("create_ts"))


def payment_wide(wide: DataFrame, payment: DataFrame, lower: str = "-5 seconds", upper: str = "15 minutes", wide_delay: str | None = None, payment_delay: str | None = None) -> DataFrame:
    """One row per detail and payment. The payment's amount and user win over the order's, on every line of the order."""
    return payment_columns(interval_join(wide, prefixed(payment, "p_"), [("order_id", "p_order_id")], "create_ts", "p_create_ts", lower, upper, wide_delay, payment_delay))


def payment_columns(joined: DataFrame) -> DataFrame:
    """The wide payment of a wide order and its payment (p_)."""
    wins = [c for c in ("user_id", "total_amount", "subject", "payment_type", "callback_time") if f"p_{c}" in joined.columns]
    kept = [c for c in joined.columns if not c.startswith("p_") and c not in (*wins, "create_ts")]
    return joined.select(
        F.col("p_id").alias("payment_id"), *kept, *(F.col(f"p_{c}").alias(c) for c in wins),
        F.col("create_ts").alias("order_create_time"), F.col("p_create_ts").alias("payment_create_time"))


def lookup(df: DataFrame, dim: DataFrame, key: str, columns: dict[str, str | Column], how: str = "inner", dim_key: str = "id") -> DataFrame:
    """Adds dimension columns by key. Spark broadcasts a dimension that is small by its statistics, else it shuffles. A
    missing key drops the fact (inner), or leaves nulls (left). Columns that df has already are replaced."""
    side = dim.select(F.col(dim_key).alias("_key"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))
    base = df.drop(*(c for c in columns if c in df.columns))
    return base.join(side, F.col(key) == F.col("_key"), how).drop("_key")


def age(birthday: str, as_of: datetime) -> Column:
    """Whole 365-day years from the birthday (text yyyy-MM-dd) to as_of."""
    born = F.unix_millis(F.try_to_timestamp(F.col(birthday).cast("string"), F.lit("yyyy-MM-dd")))
    days = F.unix_millis(F.lit(as_of).cast("timestamp")) - born
    return F.floor(days / F.lit(365 * 86_400_000)).cast("int")


def join_user(df: DataFrame, dim: DataFrame, as_of: datetime, how: str = "inner") -> DataFrame:
    return lookup(df, dim, "user_id", {"user_gender": "gender", "user_age": age("birthday", as_of)}, how)


def join_province(df: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    return lookup(df, dim, "province_id", {"province_name": "name", "province_area_code": "area_code", "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"}, how)


def join_sku(df: DataFrame, dim: DataFrame, how: str = "inner", price: bool = False) -> DataFrame:
    columns: dict[str, str | Column] = {"sku_name": "sku_name", "category3_id": "category3_id", "spu_id": "spu_id", "tm_id": "tm_id"}
    return lookup(df, dim, "sku_id", columns | ({"sku_price": "price"} if price else {}), how)


def join_spu(df: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    return lookup(df, dim, "spu_id", {"spu_name": "spu_name"}, how)


def join_trademark(df: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    return lookup(df, dim, "tm_id", {"tm_name": "tm_name"}, how)


def join_category3(df: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    return lookup(df, dim, "category3_id", {"category3_name": "name"}, how)


#: Columns that the second partial row may fill in.
FILLED = (
    "order_status", "create_time", "create_date", "coupon_reduce_amount", "activity_reduce_amount", "original_total_amount", "feight_fee", "total_amount",
    "user_id", "sku_id", "sku_name", "order_price", "sku_num")


def coalesce_wide(a: DataFrame, b: DataFrame, key: str = "detail_id") -> DataFrame:
    """First non-null value of two partial wide rows of one detail; ids and split amounts only ever come from the first, the key from either."""
    right = prefixed(b, "b_")
    joined = a.join(right, F.col(key) == F.col(f"b_{key}"), "full")
    value = lambda c: F.coalesce(c, f"b_{c}") if c in (*FILLED, key) and f"b_{c}" in right.columns else F.col(c)
    return joined.select(*(value(c).alias(c) for c in a.columns))
