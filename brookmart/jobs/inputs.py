"""The given tables mapped to the warehouse's native records."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, logs, visits, wide
from ..schemas import MONEY


class Streamed(str):
    """A folder whose tables are read as streams; the mappings below are the same."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if isinstance(sf_dir, Streamed):
        # a table may be one file; a stream takes it by a pattern only, since it expects a path to be a folder
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")
    return spark.read.parquet(path)


#: Range of event times that a caller needs, the end left out; None for all.
Days = tuple[datetime, datetime] | None


def within(df: DataFrame, column: str, days: Days, before: int = 0, after: int = 0) -> DataFrame:
    """Rows of a range of days, widened by days before and after it. The comparison is with the stored column, so that it
    reaches the scan."""
    if days is None:
        return df
    low, high = (F.lit((d + timedelta(days=n)).isoformat(" ")).cast("timestamp_ntz") for d, n in zip(days, (-before, after), strict=True))
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def text(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def events(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    return within(table(spark, sf_dir, "events"), "ts", days).select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


def raw_log(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    """(seq, value): one JSON text per event; errors are cut short."""
    e = events(spark, sf_dir, days)
    kind, k = F.col("event_type"), F.col("k")
    common = F.struct(
        text("m", F.col("user_id")).alias("mid"), F.when(F.col("seq") % 3 == 0, "1").otherwise("0").alias("is_new"), text("v", F.col("user_id") % 3).alias("vc"),
        text("c", F.col("user_id") % 4).alias("ch"), text("a", F.col("user_id") % 5).alias("ar"))
    page = F.struct(
        F.when(kind == "view", "good_detail").when(kind == "click", "good_list").when(kind == "purchase", "trade").alias("page_id"),
        F.when(k % 3 != 0, "home").alias("last_page_id"),
        F.when(kind == "view", k.cast("string")).when(kind == "click", text("red widget w", k % 7)).alias("item"),
        F.when(kind == "view", "sku_id").when(kind == "click", "keyword").alias("item_type"), (k * 100).cast("bigint").alias("during_time"))
    start = F.struct(F.lit("icon").alias("entry"), k.cast("bigint").alias("loading_time"))
    shown = F.transform(F.sequence(F.lit(0), k % 3), lambda i: F.struct(((k + i) % 100).cast("string").alias("item"), F.when(i % 2 == 0, "sku_id").otherwise("activity_id").alias("item_type")))
    record = F.to_json(F.struct(
        common.alias("common"), F.when(kind == "signup", start).alias("start"), F.when(kind != "signup", page).alias("page"),
        F.when(kind == "view", shown).alias("displays"), F.unix_millis("time").alias("ts")))
    return e.withColumn("r", record).select("seq", F.when(kind == "error", F.substring("r", 1, 20)).otherwise(F.col("r")).alias("value"))


def good_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed log with the device's fields on top and the repaired flag."""
    good, _ = logs.parse_log(raw_log(spark, sf_dir))
    return logs.repair_is_new(good.select("seq", "common.*", "start", "page", "displays", "ts", "event_time"))


def plain_pages(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    """Pages with the flag as it was logged: its repair needs a device's whole history and a shuffle, and many don't use it."""
    good, _ = logs.parse_log(raw_log(spark, sf_dir, days))
    return logs.split_page(good).select("seq", "common.*", "page.*", "displays", "ts", "event_time")


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = logs.split_page(good_log(spark, sf_dir))
    return pages.select("seq", "mid", "is_new", "vc", "ch", "ar", "page.*", "displays", "ts", "event_time")


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, topic, before, after, op) as captured."""
    e = events(spark, sf_dir)
    kind, k = F.col("event_type"), F.col("k")
    image = lambda p: F.create_map(
        F.lit("id"), (F.col("user_id") % 50).cast("string"), F.lit("tm_name"), text(p, k), F.lit("logo_url"), F.when(k % 4 != 0, text("u", k)))
    op = F.when(kind == "click", "c").when(kind == "signup", "r").when(kind == "error", "d").otherwise("u")
    name = F.when(F.col("user_id") % 2 == 0, "base_trademark").otherwise("order_info")
    return e.select(
        "seq", F.concat(F.lit("srv.shop."), name).alias("topic"), F.when(kind.isin("error", "view", "purchase"), image("o")).alias("before"),
        F.when(kind != "error", image("n")).alias("after"), op.alias("op"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.normalise_change(raw_changes(spark, sf_dir))


def rules(spark: SparkSession) -> DataFrame:
    names = "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string, sinkExtend string"
    dims = [("base_trademark", t, "hbase", "dim_base_trademark", "id,tm_name,logo_url", "id", None) for t in ("insert", "update", "read")]
    return spark.createDataFrame([*dims, ("order_info", "insert", "kafka", "dwd_order_info", "id,tm_name", "id", None)], names)


def order_info(spark: SparkSession, sf_dir: str, days: Days = None, before: int = 0, after: int = 0) -> DataFrame:
    return within(table(spark, sf_dir, "orders"), "o_orderdate", days, before, after).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_custkey") % 25).alias("province_id"), F.col("o_orderstatus").alias("order_status"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"), F.col("o_orderdate").cast("timestamp").alias("create_ts"))


def order_detail(spark: SparkSession, sf_dir: str, days: Days = None, before: int = 0, after: int = 0) -> DataFrame:
    return within(table(spark, sf_dir, "lineitem"), "l_shipdate", days, before, after).select(
        F.col("l_orderkey").alias("order_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("sku_id"),
        F.col("l_quantity").cast("bigint").alias("sku_num"), F.col("l_extendedprice").cast(MONEY).alias("split_total_amount"), F.col("l_shipdate").cast("timestamp").alias("create_ts"))


def payment_info(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    """Payments come from 10 days before to 29 days after the order."""
    o = within(table(spark, sf_dir, "orders"), "o_orderdate", days, 30, 11).where("o_orderstatus = 'F'")
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(days=(F.col("o_orderkey") % 40 - 10).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        text("110", 1 + F.col("o_orderkey") % 3).alias("payment_type"), at.alias("create_ts"))


#: Days between an order and its lines, at most.
APART = 30


def order_wide(spark: SparkSession, sf_dir: str, days: Days = None, before: int = 0, after: int = 0) -> DataFrame:
    """Wide orders made in the range; lines are read as far around it as the interval reaches."""
    info, detail = order_info(spark, sf_dir, days, before, after), order_detail(spark, sf_dir, days, before + APART, after + APART + 1)
    return wide.order_wide(info, detail, f"-{APART} days", f"{APART} days")


def payment_wide(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    """Wide payments made in the range, and some around it; orders are read as far as the interval reaches."""
    return wide.payment_wide(order_wide(spark, sf_dir, days, 16, 6), payment_info(spark, sf_dir, days), "-5 days", "15 days")


def refunds(spark: SparkSession, sf_dir: str, days: Days = None) -> DataFrame:
    return order_detail_flag(spark, sf_dir, "R", days).withColumnRenamed("split_total_amount", "refund_amount")


def order_detail_flag(spark: SparkSession, sf_dir: str, flag: str, days: Days = None) -> DataFrame:
    rows = within(table(spark, sf_dir, "lineitem"), "l_shipdate", days).where(F.col("l_returnflag") == flag)
    return rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.col("l_extendedprice").cast(MONEY).alias("split_total_amount"), F.col("l_shipdate").cast("timestamp").alias("create_ts"))


def actions(spark: SparkSession, sf_dir: str, kind: str, *more: str, days: Days = None) -> DataFrame:
    """Favours (purchase), cart entries (click) and comments (view)."""
    e = events(spark, sf_dir, days).where(F.col("event_type") == kind)
    return e.select(F.col("k").cast("bigint").alias("sku_id"), F.col("time").alias("create_ts"), F.when(F.col("k") % 4 == 0, "1201").otherwise("1202").alias("appraise"), *more)


def every_action(spark: SparkSession, sf_dir: str, days: Days = None, more: tuple[str, ...] = ()) -> DataFrame:
    """actions() of all three kinds with their `action`, from one scan."""
    kind = F.col("event_type")
    e = events(spark, sf_dir, days).withColumn("action", F.when(kind == "purchase", "favor").when(kind == "click", "cart").when(kind == "view", "comment")).where("action is not null")
    return e.select(F.col("k").cast("bigint").alias("sku_id"), F.col("time").alias("create_ts"), F.when(F.col("k") % 4 == 0, "1201").otherwise("1202").alias("appraise"), "action", *more)


def dim_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.col("c_custkey") % 12000).cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("gender"), born.alias("birthday"))


def dim_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("area_code"),
        F.col("r_name").alias("iso_code"), text("X-", F.col("n_nationkey")).alias("iso_3166_2"))


def dim_category3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and their index in order: the number of smaller types, over the few distinct ones."""
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    all_types = types.agg(F.array_sort(F.collect_set("p_type")).alias("all"))
    return all_types.select(F.posexplode("all").alias("id", "name")).select(F.col("id").cast("bigint").alias("id"), "name")


def dim_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, types = table(spark, sf_dir, "part"), dim_category3(spark, sf_dir)
    return part.join(types, F.col("p_type") == F.col("name")).select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("sku_name"), F.col("p_retailprice").cast(MONEY).alias("price"), F.col("p_size").cast("bigint").alias("spu_id"),
        F.substring("p_brand", 7, 10).cast("bigint").alias("tm_id"), types["id"].alias("category3_id"))


def dim_spu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("id"), text("spu", F.col("p_size")).alias("spu_name")).distinct()


def dim_trademark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 10).cast("bigint").alias("id"), F.col("p_brand").alias("tm_name")).distinct()


def unique_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.unique_visits(page_log(spark, sf_dir))


def user_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.user_jumps(page_log(spark, sf_dir), "6 hours")
