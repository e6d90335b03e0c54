"""Registered queries that run streams and versioned stores over the given tables, each with its SQL.

A stream takes a whole table in one go (available now), so that rows come in no particular order within it but none is
late; windows are compared where every input's watermark has closed them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.text import tokenize
from ..operators import changes, logs, reports, stats, visits, wide
from ..session import scratch
from ..sources import sinks
from ..sources.segments import read_segments, write_segments
from ..sources.versions import DimStore, Rollup
from ..streaming import kept, state, streams
from . import inputs as i
from .queries import _LATEST, CHANGES, EVENT_DAY, KEYWORDS, LOG, ORDER_DAY, PRODUCTS, PROVINCES, SQL, VISITS, _product_parts, _trademarks, _visitors, doubles, query


@contextmanager
def stateful(spark: SparkSession, windows: bool = True) -> Iterator[None]:
    """State in RocksDB while the streams run; the session's own settings afterwards. Streams without windows (inner joins)
    need no batch behind their last rows: it emits nothing and would only take every row out of the state one by one."""
    held = state.WHOLE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(windows).lower()}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def finished(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows that several batches read, worked out once and kept as Parquet in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def topic(df: DataFrame, at: str, name: str) -> str:
    """Runs a stream to its end into a topic of the folder `at`."""
    finished(streams.to_topic(df, f"{at}/{name}", f"{at}/checkpoint-{name}", True))
    return f"{at}/{name}"


def flagged(records: DataFrame, at: str, name: str, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream of log records to its end; its rows with the repaired flag, in the folder `at`."""
    finished(streams.flag_stream(records, f"{at}/{name}", f"{at}/checkpoint-{name}", keep, available=True))
    return records.sparkSession.read.parquet(f"{at}/{name}/rows")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


# Versioned dimensions


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    rows = _trademarks(spark, sf_dir)
    half = i.events(spark, sf_dir).agg((F.max("seq") / 2).cast("long")).first()[0] or 0
    return rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half), half


def _store(spark: SparkSession, sf_dir: str) -> tuple[DimStore, int]:
    """The dimension after the earlier half of its changes (version 0) and after all (version 1)."""
    early, late, half = _halves(spark, sf_dir)
    store = DimStore(spark, scratch(spark, "dim"), buckets=16)
    store.upsert(early, 0)
    store.upsert(late, 1)
    return store, half


@query("WITH " + CHANGES + _LATEST)
def snk4_dim_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of a dimension that was upserted twice."""
    return _store(spark, sf_dir)[0].dim().select("id", "tm_name", "logo_url")


@query("WITH " + CHANGES + """, half AS (SELECT CAST(max(seq) / 2.0 AS BIGINT) AS h FROM ev),
old AS (SELECT id, arg_max(tm_name, seq) AS tm_name FROM routed, half WHERE sink = 'dim_base_trademark' AND seq <= floor((SELECT max(seq) FROM ev) / 2.0) GROUP BY id),
new AS (SELECT id, arg_max(tm_name, seq) AS tm_name FROM routed WHERE sink = 'dim_base_trademark' GROUP BY id)
SELECT e.seq, o.tm_name AS name_before, n.tm_name AS name_now FROM ch e JOIN new n ON e.id = n.id LEFT JOIN old o ON e.id = o.id""")
def str8_dim_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with its trademark's name as of the version before and as of the newest."""
    store, _ = _store(spark, sf_dir)
    rows = i.change_log(spark, sf_dir).select("seq", F.coalesce(F.col("after")["id"], F.col("before")["id"]).alias("tm_id"))
    now = wide.lookup(rows, store.dim(), "tm_id", {"name_now": "tm_name"})
    return wide.lookup(now, store.dim(0), "tm_id", {"name_before": "tm_name"}, "left").select("seq", "name_before", "name_now")


# Chained streams

#: Windows of the given events that every input has closed.
CLOSED = "2024-01-25 00:00:00"


@query("WITH " + _visitors("1 hour") + f" SELECT stt, edt, vc, ch, ar, is_new, uv_ct, pv_ct, sv_ct, uj_ct, dur_sum FROM vs WHERE edt <= '{CLOSED}'")
def agg1_visitor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain as streams: raw log to pages with the repaired flag, to visits and bounces, and from these three topics
    to windows."""
    at = scratch(spark, "visitors")
    records, _ = logs.parse_log(i.raw_log(spark, i.Streamed(sf_dir)))
    pages = lambda rows: logs.split_page(rows).select("seq", "mid", "is_new", "vc", "ch", "ar", "page.*", "ts", "event_time")
    flagged(records.select("seq", "common.*", "start", "page", "ts", "event_time"), at, "pages", pages)
    page_topic = f"{at}/pages/rows"
    with stateful(spark):
        visit_topic = topic(streams.first_visits(stream_of(spark, page_topic), "1 hour"), at, "visits")
        jump_topic = topic(streams.user_jumps(stream_of(spark, page_topic), 6 * 3_600_000, "1 hour"), at, "jumps")
        sums = streams.visitor_stats(*(stream_of(spark, t) for t in (page_topic, visit_topic, jump_topic)), "1 hour", "1 hour")
        out = topic(sums.drop("ts"), at, "stats")
    return spark.read.parquet(out).where(F.col("edt") <= CLOSED)


def _streamed_payment_info(spark: SparkSession, folder: i.Streamed) -> DataFrame:
    return i.payment_info(spark, folder).withColumn("create_time", F.date_format("create_ts", "yyyy-MM-dd HH:mm:ss"))


#: Order lines of a table from which on joins and windows keep their state as Parquet: a state store takes in every row of a
#: table that comes in one go, and several times its bytes on disk. Smaller tables may have no payments near their end, so that
#: `PAID_DELAY` would hold windows back.
MANY_LINES = 100_000


def many(spark: SparkSession, sf_dir: str) -> bool:
    return i.table(spark, sf_dir, "lineitem").count() > MANY_LINES


def days(*n: int) -> tuple[timedelta, ...]:
    return tuple(timedelta(days=d) for d in n)


def _streamed_orders(spark: SparkSession, sf_dir: str, at: str, info: tuple[str, ...] = (), detail: tuple[str, ...] = ()) -> str:
    """Topic of wide orders: the join runs once, whoever reads it. `info` and `detail` are the columns that a reader needs of
    orders and lines, besides the order's id and the times."""
    folder = i.Streamed(sf_dir)
    orders = i.order_info(spark, folder).select("id", "create_ts", *info)
    lines = i.order_detail(spark, folder).select("order_id", "create_ts", *detail)
    if many(spark, sf_dir):
        finished(kept.order_wide(orders, lines, *days(-30, 30), days(30, 30), f"{at}/orders", f"{at}/checkpoint-orders", True))
        return f"{at}/orders/rows/batch=*"
    with stateful(spark, windows=False):
        return topic(streams.order_wide(orders, lines, "30 days", lower="-30 days", upper="30 days"), at, "orders")


#: How far a wide order may lie behind the newest one in its topic. The join's watermark W is 30 days behind the newest order
#: or line, whichever is earlier. An order that it emits is at most 30 days older than W, and no wide order is newer than that
#: order or line by more than 30 days: three times 30 days in all.
WIDE_DELAY = "90 days"
#: The same of a wide payment in its topic. That join's watermark W is 90 days behind the newest wide order or 30 behind the
#: newest payment, whichever is earlier. It emits payments of up to 5 days before W, and none is newer than W + 90 + 15 days.
PAID_DELAY = timedelta(days=110)


@query(SQL["joi3_payment_wide"])
def joi3_payment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments joined to orders that are joined to their lines, as one streaming query, or by a topic of wide orders where the
    lines are many."""
    folder, at = i.Streamed(sf_dir), scratch(spark, "payments")
    if many(spark, sf_dir):
        orders = stream_of(spark, _streamed_orders(spark, sf_dir, at, (), ("id", "sku_id", "split_total_amount")))
        out = _kept_payments(i.payment_info(spark, folder), orders, at)
    else:
        wide_payments = streams.payment_wide(
            i.order_info(spark, folder), i.order_detail(spark, folder), _streamed_payment_info(spark, folder), "30 days", "30 days",
            order_interval=("-30 days", "30 days"), payment_interval=("-5 days", "15 days"))
        with stateful(spark, windows=False):
            out = topic(wide_payments, at, "wide")
    return doubles(spark.read.parquet(out).select(
        "payment_id", "detail_id", "order_id", "user_id", "total_amount", "payment_type", "sku_id", "split_total_amount", F.unix_millis("payment_create_time").alias("paid_ms")))


def _kept_payments(payments: DataFrame, orders: DataFrame, at: str) -> str:
    """Topic of payments joined to a topic of wide orders."""
    finished(kept.payment_wide(orders, payments, *days(-5, 15), days(90, 30), f"{at}/paid", f"{at}/checkpoint-paid", True))
    return f"{at}/paid/rows/batch=*"


def _kept_products(spark: SparkSession, folder: i.Streamed, at: str, order_topic: str, rows: dict[str, DataFrame]) -> str:
    """Product windows with wide orders and wide payments from topics, state kept as Parquet."""
    payments = i.payment_info(spark, folder).select("id", "order_id", "create_ts")
    orders = stream_of(spark, order_topic).select("order_id", "sku_id", "sku_num", "split_total_amount", "create_ts")
    paid = stream_of(spark, _kept_payments(payments, orders, at))
    late = dict(zip(("pages", "actions", "refund", "order"), days(1, 1, 30, 90), strict=True)) | {"pay": PAID_DELAY}
    every = rows | {"order": stats.product_rows_order(orders), "pay": stats.product_rows_pay(paid)}
    finished(kept.product_stats({k: (every[k], late[k]) for k in late}, f"{at}/stats", f"{at}/checkpoint-stats", "30 days", True))
    return f"{at}/stats/rows/batch=*"


#: The events of a month spread over the years of the orders, so that all inputs have windows in common.
_SPREAD = "INTERVAL (8250 + 30 * (seq % 90)) DAY"
ORDERS_CLOSED = "2001-04-01 00:00:00"


@query(PRODUCTS.replace("SELECT k, t, 'favor'", f"SELECT k, t - {_SPREAD}, 'favor'").replace("SELECT k, t, 'cart'", f"SELECT k, t - {_SPREAD}, 'cart'").replace("SELECT k, t, 'comment'", f"SELECT k, t - {_SPREAD}, 'comment'").replace("sku_id, t, 'click'", f"sku_id, t - {_SPREAD} AS t, 'click'").replace("CAST(item AS BIGINT), t, 'display'", f"CAST(item AS BIGINT), t - {_SPREAD}, 'display'") + f"""SELECT stt, edt, sku_id, CAST(click_ct AS BIGINT) AS click_ct,
  CAST(display_ct AS BIGINT) AS display_ct, CAST(favor_ct AS BIGINT) AS favor_ct, CAST(cart_ct AS BIGINT) AS cart_ct, CAST(order_sku_num AS BIGINT) AS order_sku_num, CAST(order_amount AS DOUBLE) AS order_amount,
  CAST(payment_amount AS DOUBLE) AS payment_amount, CAST(refund_amount AS DOUBLE) AS refund_amount, CAST(comment_ct AS BIGINT) AS comment_ct, CAST(good_comment_ct AS BIGINT) AS good_comment_ct, order_ct, paid_order_ct, refund_order_ct
FROM (SELECT *, strftime(b, '%Y-%m-%d %H:%M:%S') AS stt, strftime(b + INTERVAL '30 days', '%Y-%m-%d %H:%M:%S') AS edt FROM pq) WHERE edt <= '{ORDERS_CLOSED}'""")
def agg2_product_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product windows over streaming inputs, one of which is a topic of wide orders and one its join with payments: a join and
    two aggregations in one query, or with many lines a topic and windows that keep their state as Parquet. Clicks and displays
    come from one pass over the log, actions from one over theirs."""
    folder, at = i.Streamed(sf_dir), scratch(spark, "products")
    spread = F.expr("make_interval(0, 0, 0, cast(8250 + 30 * (seq % 90) as int))")
    moved = lambda df, time: df.withColumn(time, F.col(time) - spread)
    good, _ = logs.parse_log(i.raw_log(spark, folder))
    pages = moved(good.where("start is null").select("seq", "page.*", "displays", "event_time"), "event_time")
    acts = moved(i.every_action(spark, folder, more=("seq",)), "create_ts")
    order_topic = _streamed_orders(spark, sf_dir, at, detail=("sku_id", "sku_num", "split_total_amount"))
    rows = {"pages": stats.product_rows_pages(pages), "actions": stats.product_rows_actions(acts), "refund": stats.product_rows_refund(i.refunds(spark, folder))}
    if many(spark, sf_dir):
        out = _kept_products(spark, folder, at, order_topic, rows)
    else:
        with stateful(spark):
            orders = lambda: stream_of(spark, order_topic).withWatermark("create_ts", WIDE_DELAY)
            paid = wide.payment_wide(orders(), streams.payment_times(_streamed_payment_info(spark, folder), delay="30 days"), "-5 days", "15 days")
            parts = {
                "pages": (rows["pages"], "1 day"), "actions": (rows["actions"], "1 day"), "order": (stats.product_rows_order(orders()), None), "pay": (stats.product_rows_pay(paid), None),
                "refund": (rows["refund"], "30 days")}
            out = topic(streams.product_stats(parts, "30 days"), at, "stats")
    return doubles(spark.read.parquet(out).where(F.col("edt") <= ORDERS_CLOSED))


# Hot devices


@query(SQL["win1_repair_is_new"])
def win1_first_by_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flag without a window: no device is a hot key."""
    good, _ = logs.parse_log(i.raw_log(spark, sf_dir))
    return logs.repair_is_new_by_first(good.select("seq", "common.mid", "common.is_new", "ts"))


@query(SQL["win3_user_jumps"])
def win3_jumps_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visits.user_jumps(i.plain_pages(spark, sf_dir), "6 hours", slice="3 hours").select("seq", "mid", "ts")


@query(SQL["agg1_visitor_stats"])
def agg1_visitor_stats_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = logs.parse_log(i.raw_log(spark, sf_dir))
    flat = logs.repair_is_new_by_first(good.select("seq", "common.*", "start", "page", "ts", "event_time"))
    pages = logs.split_page(flat).select("seq", "mid", "is_new", "vc", "ch", "ar", "page.*", "ts", "event_time")
    return stats.sum_visitors(stats.visitor_rows(pages, "6 hours", slice="3 hours"), "1 day", None)


# Reports of stored statistics


@query(SQL["rpt2_gmv_by_trademark"])
def rpt2_gmv_of_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states that came in two batches, lines of one order in both, merged by day; the report reads its day alone."""
    states = stats.product_states(stats.union_products([p.where(F.col("order_id").isNotNull()) for p in _product_parts(spark, sf_dir)[2:]]), "30 days")
    line = F.pmod(F.xxhash64("order_id", "order_amount"), F.lit(2))
    roll = Rollup(spark, scratch(spark, "rollup"), list(stats.STATE_KEYS), dict.fromkeys(stats.PRODUCT_SUMS, "sum"))
    found = written(states.withColumn("line", line), "states")  # worked out once for both batches
    for n in (0, 1):
        roll.add(found.where(F.col("line") == n), n)
    day = stats.products_of_states(reports.of_day(roll.read(), ORDER_DAY))
    sku = wide.join_sku(day, i.dim_sku(spark, sf_dir))
    return doubles(reports.gmv_by_trademark(wide.join_trademark(sku, i.dim_trademark(spark, sf_dir)), ORDER_DAY))


@query(SQL["rpt7_visitors_by_new_flag"])
def rpt7_visitors_of_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitor windows of an hour that came in two batches, merged by day; the report reads its day alone."""
    rows = stats.visitor_rows(i.page_log(spark, sf_dir), "6 hours")
    roll = Rollup(spark, scratch(spark, "rollup"), ["stt", "edt", *stats.VISITOR_KEYS], dict.fromkeys(stats.VISITOR_SUMS, "sum") | {"ts": "min"})
    parts = written(stats.sum_visitors(rows.withColumn("half", F.col("ts") % 2), "1 day", None, "half"), "halves")  # worked out once for both batches
    for n in (0, 1):
        roll.add(parts.where(F.col("half") == n), n)
    return reports.visitors_by_new_flag(roll.read(), EVENT_DAY)


# Typed changes, lexicon

_TYPED = "id int, k int, amount double, name string"


@query("WITH " + CHANGES + """, t AS (SELECT seq, type, CAST(id AS INTEGER) AS id, CAST(substr(tm_name, 2) AS INTEGER) AS k FROM ch WHERE "tableName" = 'base_trademark')
SELECT id, k, k / 4.0::DOUBLE AS amount, CASE WHEN k % 3 <> 0 THEN 'n' || k END AS name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM t WHERE type = 'delete' OR k % 10 <> 7) WHERE r = 1 AND type <> 'delete'""")
def src4_typed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log as JSON text with numbers in it: images are typed, rows with an amount that is no number go aside, and the
    current table has numbers."""
    e = i.events(spark, sf_dir).where(F.col("user_id") % 2 == 0)
    kind, k = F.col("event_type"), F.col("k")
    type_ = F.when(kind == "click", "insert").when(kind == "signup", "read").when(kind == "error", "delete").otherwise("update")
    image = F.to_json(F.struct((F.col("user_id") % 50).alias("id"), k.alias("k"), F.when(k % 3 != 0, i.text("n", k)).alias("name")))
    amount = F.when((k % 10 == 7) & (kind != "error"), F.lit('"n/a"')).otherwise((k / 4).cast("string"))
    image = F.concat(F.lit('{"amount":'), amount, F.lit(","), F.substr(image, F.lit(2)))
    both = lambda before, after: F.concat(F.lit('{"database":"shop","tableName":"base_trademark","type":"'), type_, F.lit('","before":'), before, F.lit(',"after":'), after, F.lit("}"))
    none = F.lit("null")
    value = F.when(kind == "error", both(image, none)).otherwise(both(none, image))
    good, _ = changes.typed_changes(e.select("seq", value.alias("value")), _TYPED)
    return changes.replay(good).select("row.*")


#: Parts of words; none overlaps itself, so that SQL can count them.
PARTS = ("the", "ing", "ering", "er", "in", "tion", "ou", "ed", "and", "eau", "ment", "que", "ung", "sch")


@query("WITH p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in PARTS) + """]) AS keyword), d AS (SELECT lower(text) AS t FROM documents)
SELECT keyword, CAST(sum((length(t) - length(replace(t, keyword, ''))) / length(keyword)) AS BIGINT) AS n FROM p, d GROUP BY keyword HAVING sum(length(t) - length(replace(t, keyword, ''))) > 0""")
def udt1_lexicon_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part at every place of every word of all documents, overlaps included, counted by part."""
    found = tokenize(i.table(spark, sf_dir, "documents").select("text"), "text", PARTS, compounds=True, rest=False)
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


# Changes as streams

_OF_TRADEMARK = """, k AS (SELECT *, CASE WHEN type <> 'delete' THEN tm_name END AS now, lag(CASE WHEN type <> 'delete' THEN tm_name END) OVER (PARTITION BY id ORDER BY seq) AS sent FROM ch WHERE "tableName" = 'base_trademark')"""


@query("WITH " + CHANGES + _OF_TRADEMARK + " SELECT seq, 0 AS step, FALSE AS flag, id, sent AS tm_name FROM k WHERE sent IS NOT NULL UNION ALL SELECT seq, 1, TRUE, id, now FROM k WHERE now IS NOT NULL")
def cdc6_retract_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retract stream with state: what is taken back is what was sent."""
    at = scratch(spark, "retract")

    def write(batch: DataFrame, n: int) -> None:
        batch.select("seq", "step", "flag", F.col("key").alias("id"), F.col("row")["tm_name"].alias("tm_name")).write.mode("overwrite").parquet(f"{at}/out/batch={n}")

    log = i.change_log(spark, i.Streamed(sf_dir)).where("tableName = 'base_trademark'")
    with stateful(spark):
        finished(streams.retract_stream(log).writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").outputMode("update").trigger(availableNow=True).start())
    return spark.read.parquet(f"{at}/out").drop("batch")


@query(SQL["cdc7_replay"])
def cdc7_table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table of a change log, kept by a stream in a versioned store."""
    at = scratch(spark, "table")
    log = i.change_log(spark, i.Streamed(sf_dir)).where("tableName = 'base_trademark'")
    with stateful(spark):
        finished(streams.table_stream(log, f"{at}/table", f"{at}/checkpoint", buckets=16, available=True))
    row = F.from_json("row", "map<string,string>")
    return DimStore(spark, f"{at}/table", buckets=16).dim().where("row is not null").select("id", row["tm_name"].alias("tm_name"), row["logo_url"].alias("logo_url"))


# Single operators as streams, topics and sinks


@query("WITH " + VISITS + f" SELECT seq, mid, ts FROM uv WHERE t < '{CLOSED}'")
def win2_visits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    with stateful(spark):
        out = topic(streams.first_visits(i.plain_pages(spark, i.Streamed(sf_dir)), "1 hour"), scratch(spark, "visits"), "visits")
    return spark.read.parquet(out).where(F.col("event_time") < CLOSED).select("seq", "mid", "ts")


@query("WITH " + VISITS + f" SELECT seq, mid, ts FROM uj WHERE t < '{CLOSED}'")
def win3_jumps_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    with stateful(spark):
        out = topic(streams.user_jumps(i.plain_pages(spark, i.Streamed(sf_dir)), 6 * 3_600_000, "1 hour"), scratch(spark, "jumps"), "jumps")
    return spark.read.parquet(out).where(F.col("event_time") < CLOSED).select("seq", "mid", "ts")


@query("WITH " + LOG + " SELECT mid, is_new, ts FROM lg")
def win1_flags_of_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log written to a topic of segments, a device to a partition; a stream reads it and takes the order of rows from
    the offsets."""
    at = scratch(spark, "topic")
    raw = i.raw_log(spark, sf_dir).select("value", F.get_json_object("value", "$.common.mid").alias("mid"), F.timestamp_millis(F.get_json_object("value", "$.ts").cast("long")).alias("timestamp"))
    write_segments(raw, f"{at}/log", 0, "mid")
    records, _ = logs.parse_log(read_segments(spark, f"{at}/log", "earliest", True).select(F.col("offset").alias("seq"), "value"))
    return flagged(records.select("seq", "common.mid", "common.is_new", "ts"), at, "flags").select("mid", "is_new", "ts")


@query("WITH " + LOG + " SELECT mid, count(*) AS n, TRUE AS ordered FROM raw GROUP BY mid")
def src1_topic_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a topic that was written in two batches, by device: how many there are, and whether offsets follow time."""
    at = scratch(spark, "topic")
    raw = i.raw_log(spark, sf_dir).select("seq", "value", F.get_json_object("value", "$.common.mid").alias("mid"), F.get_json_object("value", "$.ts").cast("long").alias("ms")).where("mid is not null")
    rows = raw.withColumn("timestamp", F.timestamp_millis("ms"))
    half = rows.agg((F.max("ms") / 2 + F.min("ms") / 2).cast("long")).first()[0] or 0
    write_segments(rows.where(F.col("ms") <= half), at, 0, "mid")
    write_segments(rows.where(F.col("ms") > half), at, 1, "mid")
    back = read_segments(spark, at).select("offset", F.get_json_object("value", "$.common.mid").alias("mid"), F.get_json_object("value", "$.ts").cast("long").alias("ms"))
    follows = F.coalesce(F.lag("ms").over(Window.partitionBy("mid").orderBy("offset")) <= F.col("ms"), F.lit(True))
    return back.withColumn("follows", follows).groupBy("mid").agg(F.count(F.lit(1)).alias("n"), F.min("follows").alias("ordered"))


@query(KEYWORDS + f"SELECT * FROM ks WHERE edt <= '{CLOSED}'")
def agg4_keyword_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    with stateful(spark):
        out = topic(streams.keyword_stats(i.plain_pages(spark, i.Streamed(sf_dir)), "1 day", "1 hour"), scratch(spark, "words"), "stats")
    return spark.read.parquet(out).where(F.col("edt") <= CLOSED)


@query(PROVINCES + f"SELECT stt, edt, province_id, province_name, province_area_code, province_iso_code, province_3166_2_code, CAST(order_amount AS DOUBLE) AS order_amount, order_count FROM pv WHERE edt <= '{ORDERS_CLOSED}'")
def agg3_province_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders joined to their lines as streams into a topic; the topic joined to provinces as a table, and summed."""
    at = scratch(spark, "provinces")
    order_topic = _streamed_orders(spark, sf_dir, at, ("province_id",), ("split_total_amount",))
    with stateful(spark):
        out = topic(stats.province_stats(wide.join_province(stream_of(spark, order_topic), i.dim_province(spark, sf_dir)), "30 days", WIDE_DELAY), at, "stats")
    return doubles(spark.read.parquet(out).where(F.col("edt") <= ORDERS_CLOSED))


@query(SQL["snk2_routed"])
def str7_route_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes routed as a stream, by the rules as they are when a batch starts; rows of each topic's folder."""
    at = scratch(spark, "routed")
    finished(streams.route_stream(i.change_log(spark, i.Streamed(sf_dir)), lambda: i.rules(spark), f"{at}/out", f"{at}/checkpoint", True))
    return spark.read.format("text").load(f"{at}/out").groupBy("topic").agg(F.count("value").alias("n"))


@query(KEYWORDS + "SELECT * FROM ks")
def snk3_stats_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written in two batches, the second of them twice."""
    at = scratch(spark, "stats")
    words = stats.keyword_stats(tokenize(stats.keyword_pages(i.plain_pages(spark, sf_dir)), "full_word"), "1 day", None)
    for batch, rows in ((0, words.where("keyword < 's'")), (1, words.where("keyword >= 's'")), (1, words.where("keyword >= 's'"))):
        sinks.write_stats(rows, at, batch)
    return spark.read.parquet(at).drop("dt", "batch_id")
