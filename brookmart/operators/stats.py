"""Statistics by event-time windows. Every function runs on batch and on streaming frames."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import MONEY
from .visits import followed, jumps
from .wide import join_category3, join_sku, join_spu, join_trademark

#: Fixed value: the code of a good appraisal.
GOOD = "1201"
FORMAT = "yyyy-MM-dd HH:mm:ss"


def bounds(window: str = "window") -> list[Column]:
    return [F.date_format(f"{window}.start", FORMAT).alias("stt"), F.date_format(f"{window}.end", FORMAT).alias("edt")]


def keyword_pages(pages: DataFrame) -> DataFrame:
    """Search phrases: pages reached for a keyword."""
    return pages.where((F.col("item_type") == "keyword") & F.col("item").isNotNull()).select(F.col("item").alias("full_word"), F.col("event_time").alias("rt"))


VISITOR_KEYS = ("vc", "ch", "ar", "is_new")
VISITOR_SUMS = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")


def _visitor_rows(df: DataFrame, **measures: Column) -> DataFrame:
    m = {c: measures.get(c, F.lit(0)).cast("long") for c in VISITOR_SUMS}
    return df.select("event_time", "ts", *VISITOR_KEYS, *(v.alias(c) for c, v in m.items()))


def visitor_rows_uv(visits: DataFrame) -> DataFrame:
    return _visitor_rows(visits, uv_ct=F.lit(1))


def visitor_rows_uj(jumps: DataFrame) -> DataFrame:
    return _visitor_rows(jumps, uj_ct=F.lit(1))


def visitor_rows_page(pages: DataFrame) -> DataFrame:
    entry = F.col("last_page_id").isNull().cast("int")
    return _visitor_rows(pages, pv_ct=F.lit(1), sv_ct=entry, dur_sum=F.coalesce("during_time", F.lit(0)))


def visitor_rows(pages: DataFrame, within: str = "10 seconds", mid: str = "mid", time: str = "event_time", order: tuple[str, ...] = ("ts", "seq"), slice: str | None = None) -> DataFrame:
    """Batch form: one row per page with all measures. The device's first entry of the day and its bounces come from
    windows over the device, for which one exchange is enough, and rows aren't multiplied. With `slice` no device is a hot
    key: bounces come from slices of its time, first entries from an aggregation that is joined back."""
    entry, day = F.col("last_page_id").isNull(), F.to_date(time)
    place = F.struct(*order)
    marked = followed(pages, slice, mid, time, order).withColumn("_jump", jumps(within, time))
    if slice is None:
        marked = marked.withColumn("_first", entry & (F.min(F.when(entry, place)).over(Window.partitionBy(mid, day)) == place))
    else:
        firsts = pages.where(entry).groupBy(F.col(mid).alias("_mid"), day.alias("_day")).agg(F.min(place).alias("_least"))
        marked = marked.join(firsts, F.col(mid).eqNullSafe(F.col("_mid")) & (day == F.col("_day")), "left").withColumn("_first", entry & (F.col("_least") == place))
    return _visitor_rows(
        marked, uv_ct=F.coalesce(F.col("_first"), F.lit(False)).cast("int"), pv_ct=F.lit(1), sv_ct=entry.cast("int"), uj_ct=F.col("_jump").cast("int"), dur_sum=F.coalesce("during_time", F.lit(0)))


def visitor_stats(pages: DataFrame, visits: DataFrame, jumps: DataFrame, window: str = "10 seconds", delay: str | None = "13 seconds") -> DataFrame:
    """Sums over three inputs. On streams each input has its own watermark and the least of them closes windows, so that
    an input that is behind (bounces are known late) loses nothing."""
    parts = [visitor_rows_page(pages), visitor_rows_uv(visits), visitor_rows_uj(jumps)]
    return sum_visitors(reduce(DataFrame.unionByName, [p.withWatermark("event_time", delay) for p in parts] if delay else parts), window, None)


def sum_visitors(rows: DataFrame, window: str, delay: str | None, *more: str) -> DataFrame:
    """Sums by window and visitor keys, and by the columns `more` if any are named."""
    if delay:
        rows = rows.withWatermark("event_time", delay)
    sums = rows.groupBy(F.window("event_time", window), *VISITOR_KEYS, *more).agg(*(F.sum(c).alias(c) for c in VISITOR_SUMS), F.min("ts").alias("ts"))
    return sums.select(*bounds(), *VISITOR_KEYS, *VISITOR_SUMS, "ts", *more)


#: Additive measures of product statistics, and the kinds whose orders are counted.
PRODUCT_SUMS = {
    "click_ct": "long", "display_ct": "long", "favor_ct": "long", "cart_ct": "long", "order_sku_num": "long", "order_amount": MONEY,
    "payment_amount": MONEY, "refund_amount": MONEY, "comment_ct": "long", "good_comment_ct": "long",
}
PRODUCT_ORDERS = {"order_ct": "order", "paid_order_ct": "pay", "refund_order_ct": "refund"}
#: The kind of rows that have the measure; others have 0.
PRODUCT_KINDS = {
    "click_ct": "click", "display_ct": "display", "favor_ct": "favor", "cart_ct": "cart", "order_sku_num": "order", "order_amount": "order",
    "payment_amount": "pay", "refund_amount": "refund", "comment_ct": "comment", "good_comment_ct": "comment",
}


def _product_rows(df: DataFrame, sku: Column, time: str, kind: str | Column, order_id: str | None = None, **measures: Column) -> DataFrame:
    m = [F.coalesce(measures.get(c, F.lit(0)).cast(t), F.lit(0).cast(t)).alias(c) for c, t in PRODUCT_SUMS.items()]
    order = F.col(order_id) if order_id else F.lit(None)
    return df.select(sku.cast("long").alias("sku_id"), F.col(time).alias("event_time"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), order.cast("long").alias("order_id"), *m)


def product_rows_click(pages: DataFrame) -> DataFrame:
    rows = pages.where((F.col("page_id") == "good_detail") & (F.col("item_type") == "sku_id"))
    return _product_rows(rows, F.expr("try_cast(item as bigint)"), "event_time", "click", click_ct=F.lit(1))


def product_rows_display(pages: DataFrame) -> DataFrame:
    rows = pages.select("event_time", F.explode("displays").alias("d")).where("d.item_type = 'sku_id'")
    return _product_rows(rows.select("event_time", "d.item"), F.expr("try_cast(item as bigint)"), "event_time", "display", display_ct=F.lit(1))


def product_rows_pages(pages: DataFrame) -> DataFrame:
    """Clicks and displays in one pass over the pages: the rows of product_rows_click() and product_rows_display()."""
    row = lambda item, kind: F.struct(item.alias("item"), F.lit(kind).alias("kind"))
    click = F.when((F.col("page_id") == "good_detail") & (F.col("item_type") == "sku_id"), F.array(row(F.col("item"), "click")))
    shown = F.transform(F.filter("displays", lambda d: d["item_type"] == "sku_id"), lambda d: row(d["item"], "display"))
    none = F.array().cast("array<struct<item:string,kind:string>>")
    rows = pages.select("event_time", F.explode(F.concat(F.coalesce(click, none), F.coalesce(shown, none))).alias("r")).select("event_time", "r.item", "r.kind")
    is_ = lambda kind: (F.col("kind") == kind).cast("int")
    return _product_rows(rows, F.expr("try_cast(item as bigint)"), "event_time", F.col("kind"), click_ct=is_("click"), display_ct=is_("display"))


def product_rows_actions(actions: DataFrame) -> DataFrame:
    """Favours, cart entries and comments in one pass over rows whose `action` tells them apart."""
    is_ = lambda kind: F.col("action") == kind
    rows = actions.where(F.col("action").isin("favor", "cart", "comment"))
    return _product_rows(
        rows, F.col("sku_id"), "create_ts", F.col("action"), favor_ct=is_("favor").cast("int"), cart_ct=is_("cart").cast("int"), comment_ct=is_("comment").cast("int"),
        good_comment_ct=(is_("comment") & (F.col("appraise") == GOOD)).cast("int"))


def product_rows_favor(favors: DataFrame) -> DataFrame:
    return _product_rows(favors, F.col("sku_id"), "create_ts", "favor", favor_ct=F.lit(1))


def product_rows_cart(carts: DataFrame) -> DataFrame:
    return _product_rows(carts, F.col("sku_id"), "create_ts", "cart", cart_ct=F.lit(1))


def product_rows_order(wide: DataFrame) -> DataFrame:
    return _product_rows(wide, F.col("sku_id"), "create_ts", "order", "order_id", order_sku_num=F.col("sku_num"), order_amount=F.col("split_total_amount"))


def product_rows_pay(paid: DataFrame) -> DataFrame:
    return _product_rows(paid, F.col("sku_id"), "payment_create_time", "pay", "order_id", payment_amount=F.col("split_total_amount"))


def product_rows_refund(refunds: DataFrame) -> DataFrame:
    return _product_rows(refunds, F.col("sku_id"), "create_ts", "refund", "order_id", refund_amount=F.col("refund_amount"))


def product_rows_comment(comments: DataFrame) -> DataFrame:
    return _product_rows(comments, F.col("sku_id"), "create_ts", "comment", comment_ct=F.lit(1), good_comment_ct=(F.col("appraise") == GOOD).cast("int"))


def union_products(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


#: What a row of one order holds: its counts, good comments and money. Which measures these are is told by its kind.
ORDER_KEYS = ("window", "sku_id", "kind", "order_id")
ORDER_SUMS = {"n": "long", "good": "long", "amount": MONEY}


def _held(measure: str) -> str:
    return "amount" if PRODUCT_SUMS[measure] == MONEY else "good" if measure == "good_comment_ct" else "n"


def order_rows(rows: DataFrame, window: str) -> DataFrame:
    """Product rows with their window. A row is of one kind, so three columns are enough for its measures."""
    total = lambda name: reduce(Column.__add__, (F.col(c) for c in PRODUCT_SUMS if _held(c) == name))
    return rows.select(F.window("event_time", window).alias("window"), *ORDER_KEYS[1:], *(total(c).cast(t).alias(c) for c, t in ORDER_SUMS.items()))


def sum_orders(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*ORDER_KEYS).agg(*(F.sum(c).cast(t).alias(c) for c, t in ORDER_SUMS.items()))


def products_of_orders(orders: DataFrame) -> DataFrame:
    measure = lambda c, t: F.sum(F.when(F.col("kind") == PRODUCT_KINDS[c], F.col(_held(c))).otherwise(F.lit(0).cast(t))).cast(t)
    counted = lambda kind: F.sum(((F.col("kind") == kind) & F.col("order_id").isNotNull()).cast("long"))
    return orders.groupBy("window", "sku_id").agg(
        *(measure(c, t).alias(c) for c, t in PRODUCT_SUMS.items()), *(counted(k).alias(c) for c, k in PRODUCT_ORDERS.items())
    ).select(*bounds(), "sku_id", *PRODUCT_SUMS, *PRODUCT_ORDERS)


def sum_products(rows: DataFrame, window: str = "10 seconds", delay: str | None = "2 seconds") -> DataFrame:
    """Two levels: by order and kind first, so that orders are counted exactly without sets, a hot product is spread over
    its orders, and streams can do it too (they have no distinct counts)."""
    if delay:
        rows = rows.withWatermark("event_time", delay)
    return products_of_orders(sum_orders(order_rows(rows, window)))


def product_states(rows: DataFrame, window: str = "10 seconds") -> DataFrame:
    """The first level of sum_products() as rows that can be stored and merged: sums by window, product, kind and order. Lines
    of one order that come later add to its row, so orders are never counted twice."""
    orders = rows.groupBy(F.window("event_time", window), "sku_id", "kind", "order_id").agg(*(F.sum(c).cast(t).alias(c) for c, t in PRODUCT_SUMS.items()))
    return orders.select(*bounds(), *STATE_KEYS[2:], *PRODUCT_SUMS)


STATE_KEYS = ("stt", "edt", "sku_id", "kind", "order_id")


def products_of_states(states: DataFrame) -> DataFrame:
    counted = lambda kind: F.sum(((F.col("kind") == kind) & F.col("order_id").isNotNull()).cast("long"))
    return states.groupBy("stt", "edt", "sku_id").agg(
        *(F.sum(c).cast(t).alias(c) for c, t in PRODUCT_SUMS.items()), *(counted(k).alias(c) for c, k in PRODUCT_ORDERS.items()))


def product_stats(parts: list[DataFrame], sku: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame, window: str = "10 seconds",
                  delay: str | None = "2 seconds", how: str = "inner") -> DataFrame:
    """Dimensions are joined to the aggregated rows, which are far fewer than the facts."""
    out = join_sku(sum_products(union_products(parts), window, delay), sku, how, price=True)
    return join_category3(join_trademark(join_spu(out, spu, how), trademark, how), category3, how)


PROVINCE_KEYS = ("province_id", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code")


def stamped(rows: DataFrame, as_of: datetime | Column | None) -> DataFrame:
    """rows with `ts`, the milliseconds of the time at which they are computed, which the caller names; without one as they are."""
    if as_of is None:
        return rows
    return rows.withColumn("ts", F.unix_millis(as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")))


def province_stats(wide: DataFrame, window: str = "10 seconds", delay: str | None = "2 seconds", scale: int = 2, as_of: datetime | Column | None = None) -> DataFrame:
    """Orders and revenue by province: by order first (exact count, a hot province spread over its orders), then by
    province. scale=0 rounds each amount to whole units. With `as_of` there is a tenth column `ts`."""
    rows = wide.withWatermark("create_ts", delay) if delay else wide
    amount = F.col("split_total_amount").cast(f"decimal(16,{scale})")
    orders = rows.groupBy(F.window("create_ts", window), *PROVINCE_KEYS, "order_id").agg(F.sum(amount).alias("order_amount"))
    out = orders.groupBy("window", *PROVINCE_KEYS).agg(F.sum("order_amount").cast(f"decimal(16,{scale})").alias("order_amount"), F.count("order_id").alias("order_count"))
    return stamped(out.select(*bounds(), *PROVINCE_KEYS, "order_amount", "order_count"), as_of)


def province_rows(wide: DataFrame) -> DataFrame:
    """Alternative: one row per order line, so that order_count counts lines."""
    return wide.select(*PROVINCE_KEYS, F.col("split_total_amount").alias("order_amount"), F.lit(1).cast("long").alias("order_count"), F.col("create_ts").alias("event_time"))


def keyword_stats(words: DataFrame, window: str = "10 seconds", delay: str | None = "2 seconds", source: str = "search", as_of: datetime | Column | None = None) -> DataFrame:
    """Counts of (keyword, rt) rows by word and window; with `as_of` there is a sixth column `ts`."""
    rows = words.withWatermark("rt", delay) if delay else words
    out = rows.groupBy(F.window("rt", window), "keyword").agg(F.count(F.lit(1)).alias("ct"))
    return stamped(out.select(*bounds(), "keyword", F.lit(source).alias("source"), "ct"), as_of)
