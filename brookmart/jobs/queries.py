"""Registered queries over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import changes, logs, reports, stats, wide
from ..sources import sinks
from . import inputs as i

AS_OF = datetime(2020, 1, 1)
#: Reports are of the day on which a window of these inputs starts.
ORDER_DAY, EVENT_DAY = "1998-02-03", "2024-01-15"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = """ev AS (SELECT event_id AS seq, ts AS t, epoch_us(ts) // 1000 AS ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
LOG = EV + """,
raw AS (SELECT seq, t, ts, k, event_type, 'm' || user_id AS mid, CASE WHEN seq % 3 = 0 THEN '1' ELSE '0' END AS is_new_raw, 'v' || (user_id % 3) AS vc,
  'c' || (user_id % 4) AS ch, 'a' || (user_id % 5) AS ar, event_type = 'signup' AS is_start FROM ev WHERE event_type <> 'error'),
lg AS (SELECT *, CASE WHEN is_new_raw = '1' AND sum(CASE WHEN is_new_raw = '1' THEN 1 ELSE 0 END) OVER (PARTITION BY mid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) > 1 THEN '0' ELSE is_new_raw END AS is_new FROM raw),
pg AS (SELECT seq, t, ts, k, event_type, mid, is_new, vc, ch, ar,
  CASE event_type WHEN 'view' THEN 'good_detail' WHEN 'click' THEN 'good_list' WHEN 'purchase' THEN 'trade' END AS page_id,
  CASE WHEN k % 3 <> 0 THEN 'home' END AS last_page_id,
  CASE event_type WHEN 'view' THEN CAST(k AS VARCHAR) WHEN 'click' THEN 'red widget w' || (k % 7) END AS item,
  CASE event_type WHEN 'view' THEN 'sku_id' WHEN 'click' THEN 'keyword' END AS item_type, CAST(k * 100 AS BIGINT) AS during_time FROM lg WHERE NOT is_start),
disp AS (SELECT seq, t, page_id, n AS pos, CAST((k + n) % 100 AS VARCHAR) AS item, CASE WHEN n % 2 = 0 THEN 'sku_id' ELSE 'activity_id' END AS item_type
  FROM pg, LATERAL (SELECT unnest(range(0, k % 3 + 1)) AS n) WHERE event_type = 'view')"""
VISITS = LOG + """,
uv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mid, CAST(t AS DATE) ORDER BY ts, seq) AS r FROM pg WHERE last_page_id IS NULL) WHERE r = 1),
nx AS (SELECT *, lead(ts) OVER (PARTITION BY mid ORDER BY ts, seq) AS next_ts, lead(last_page_id IS NULL) OVER (PARTITION BY mid ORDER BY ts, seq) AS next_entry FROM pg),
uj AS (SELECT * FROM nx WHERE last_page_id IS NULL AND (next_ts IS NULL OR next_entry OR next_ts - ts >= 21600000))"""
STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _visitors(step: str) -> str:
    b = f"time_bucket(INTERVAL '{step}', t, TIMESTAMP '1970-01-01')"
    return VISITS + f""",
vr AS (SELECT t, ts, vc, ch, ar, is_new, 0 AS uv, 1 AS pv, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END AS sv, 0 AS uj, during_time AS dur FROM pg
  UNION ALL SELECT t, ts, vc, ch, ar, is_new, 1, 0, 0, 0, 0 FROM uv UNION ALL SELECT t, ts, vc, ch, ar, is_new, 0, 0, 0, 1, 0 FROM uj),
vs AS (SELECT {STAMP.format(b)} AS stt, {STAMP.format(f"{b} + INTERVAL '{step}'")} AS edt, vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct,
  CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(uj) AS BIGINT) AS uj_ct, CAST(sum(dur) AS BIGINT) AS dur_sum, min(ts) AS ts FROM vr GROUP BY {b}, vc, ch, ar, is_new)"""


CHANGES = EV + """,
ch AS (SELECT seq, CASE WHEN user_id % 2 = 0 THEN 'base_trademark' ELSE 'order_info' END AS "tableName", event_type,
  CASE event_type WHEN 'click' THEN 'insert' WHEN 'signup' THEN 'read' WHEN 'error' THEN 'delete' ELSE 'update' END AS type,
  CAST(user_id % 50 AS VARCHAR) AS id, 'n' || k AS tm_name, 'o' || k AS old_name, CASE WHEN k % 4 <> 0 THEN 'u' || k END AS logo_url FROM ev),
routed AS (SELECT *, CASE WHEN "tableName" = 'base_trademark' AND type <> 'delete' THEN 'dim_base_trademark' WHEN "tableName" = 'order_info' AND type = 'insert' THEN 'dwd_order_info' END AS sink FROM ch)"""
WIDE = """info AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_custkey % 25 AS province_id, o_orderstatus AS order_status, CAST(o_totalprice AS DECIMAL(16,2)) AS total_amount, o_orderdate AS ct FROM orders),
detail AS (SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS id, l_partkey AS sku_id, CAST(l_quantity AS BIGINT) AS sku_num, CAST(l_extendedprice AS DECIMAL(16,2)) AS split_total_amount, l_shipdate AS ct, l_returnflag FROM lineitem),
wide AS (SELECT d.id AS detail_id, i.id AS order_id, i.province_id, i.order_status, i.user_id, i.total_amount, d.sku_id, d.sku_num, d.split_total_amount, i.ct
  FROM info i JOIN detail d ON i.id = d.order_id AND d.ct BETWEEN i.ct - INTERVAL 30 DAY AND i.ct + INTERVAL 30 DAY),
pay AS (SELECT o_orderkey AS id, o_orderkey AS order_id, o_custkey AS user_id, CAST(o_totalprice AS DECIMAL(16,2)) AS total_amount, '110' || (1 + o_orderkey % 3) AS payment_type,
  o_orderdate + to_days(CAST(o_orderkey % 40 - 10 AS INTEGER)) AS ct FROM orders WHERE o_orderstatus = 'F'),
pwide AS (SELECT p.id AS payment_id, w.detail_id, w.order_id, p.user_id, p.total_amount, p.payment_type, w.sku_id, w.sku_num, w.split_total_amount, w.ct AS order_ct, p.ct
  FROM wide w JOIN pay p ON w.order_id = p.order_id AND p.ct BETWEEN w.ct - INTERVAL 5 DAY AND w.ct + INTERVAL 15 DAY),
prov AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_nationkey AS VARCHAR) AS area, r_name AS iso, 'X-' || n_nationkey AS iso2 FROM nation JOIN region ON n_regionkey = r_regionkey),
cat3 AS (SELECT p_type AS name, row_number() OVER (ORDER BY p_type) - 1 AS id FROM (SELECT DISTINCT p_type FROM part)),
sku AS (SELECT p_partkey AS id, p_name AS sku_name, CAST(p_retailprice AS DECIMAL(16,2)) AS price, CAST(p_size AS BIGINT) AS spu_id, CAST(substr(p_brand, 7) AS BIGINT) AS tm_id, p_brand AS tm_name, c.id AS category3_id, p_type AS category3_name
  FROM part JOIN cat3 c ON p_type = c.name)"""
_PB = "time_bucket(INTERVAL '30 days', {}, TIMESTAMP '1970-01-01')"
PRODUCTS = "WITH " + LOG + ", " + WIDE + f""",
pr AS (SELECT CAST(item AS BIGINT) AS sku_id, t, 'click' AS kind, NULL AS order_id, 1 AS click, 0 AS display, 0 AS favor, 0 AS cart, 0 AS num, 0.0::DECIMAL(16,2) AS oa, 0.0::DECIMAL(16,2) AS pa, 0.0::DECIMAL(16,2) AS ra, 0 AS comment, 0 AS good FROM pg WHERE page_id = 'good_detail'
  UNION ALL SELECT CAST(item AS BIGINT), t, 'display', NULL, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0 FROM disp WHERE item_type = 'sku_id'
  UNION ALL SELECT k, t, 'favor', NULL, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0 FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT k, t, 'cart', NULL, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0 FROM ev WHERE event_type = 'click'
  UNION ALL SELECT k, t, 'comment', NULL, 0, 0, 0, 0, 0, 0, 0, 0, 1, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END FROM ev WHERE event_type = 'view'
  UNION ALL SELECT sku_id, ct, 'order', order_id, 0, 0, 0, 0, sku_num, split_total_amount, 0, 0, 0, 0 FROM wide
  UNION ALL SELECT sku_id, ct, 'pay', order_id, 0, 0, 0, 0, 0, 0, split_total_amount, 0, 0, 0 FROM pwide
  UNION ALL SELECT sku_id, ct, 'refund', order_id, 0, 0, 0, 0, 0, 0, 0, split_total_amount, 0, 0 FROM detail WHERE l_returnflag = 'R'),
pq AS (SELECT {_PB.format("t")} AS b, sku_id, sum(click) AS click_ct, sum(display) AS display_ct, sum(favor) AS favor_ct, sum(cart) AS cart_ct, sum(num) AS order_sku_num, sum(oa) AS order_amount,
  sum(pa) AS payment_amount, sum(ra) AS refund_amount, sum(comment) AS comment_ct, sum(good) AS good_comment_ct, count(DISTINCT order_id) FILTER (WHERE kind = 'order') AS order_ct,
  count(DISTINCT order_id) FILTER (WHERE kind = 'pay') AS paid_order_ct, count(DISTINCT order_id) FILTER (WHERE kind = 'refund') AS refund_order_ct FROM pr GROUP BY 1, 2),
ps AS (SELECT {STAMP.format("b")} AS stt, {STAMP.format("b + INTERVAL '30 days'")} AS edt, pq.*, sku_name, price AS sku_price, spu_id, 'spu' || spu_id AS spu_name, tm_id, tm_name, category3_id, category3_name
  FROM pq JOIN sku ON pq.sku_id = sku.id)
"""
_PVB = _PB.format("ct")
PROVINCES = "WITH " + WIDE + f""",
pv AS (SELECT {STAMP.format(_PVB)} AS stt, {STAMP.format(_PVB + " + INTERVAL '30 days'")} AS edt, p.id AS province_id, p.name AS province_name, p.area AS province_area_code, p.iso AS province_iso_code,
  p.iso2 AS province_3166_2_code, sum(split_total_amount) AS order_amount, count(DISTINCT order_id) AS order_count, count(*) AS order_lines
  FROM wide w JOIN prov p ON w.province_id = p.id GROUP BY ALL)
"""
_KB = "time_bucket(INTERVAL '1 day', t, TIMESTAMP '1970-01-01')"
KEYWORDS = "WITH " + LOG + f""",
wd AS (SELECT seq, t, unnest(string_split(item, ' ')) AS keyword FROM pg WHERE item_type = 'keyword'),
ks AS (SELECT {STAMP.format(_KB)} AS stt, {STAMP.format(_KB + " + INTERVAL '1 day'")} AS edt, keyword, 'search' AS source, count(*) AS ct FROM wd GROUP BY {_KB}, keyword)
"""


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def doubles(df: DataFrame) -> DataFrame:
    """Decimals as doubles, to be compared with other engines."""
    return df.select(*(F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes))


# Logs


@query("WITH " + LOG + """ SELECT e.seq, CASE WHEN event_type = 'error' THEN 'dirty' ELSE 'good' END AS status, CASE WHEN event_type <> 'error' THEN 'm' || user_id END AS mid,
  CASE WHEN event_type <> 'error' THEN CASE WHEN seq % 3 = 0 THEN '1' ELSE '0' END END AS is_new, CASE WHEN event_type <> 'error' THEN ts END AS ts FROM ev e""")
def prj1_parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, dirty = logs.parse_log(i.raw_log(spark, sf_dir))
    rows = good.select("seq", F.lit("good").alias("status"), "common.mid", "common.is_new", "ts")
    return rows.unionByName(dirty.select("seq", F.lit("dirty").alias("status")), allowMissingColumns=True)


@query("WITH " + LOG + " SELECT seq, mid, is_new, CAST(k AS BIGINT) AS loading_time FROM lg WHERE is_start")
def prj2_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.split_start(i.good_log(spark, sf_dir)).select("seq", "mid", "is_new", "start.loading_time")


@query("WITH " + LOG + " SELECT seq, mid, is_new, page_id, last_page_id, item, item_type, during_time, ts FROM pg")
def prj2_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.page_log(spark, sf_dir).select("seq", "mid", "is_new", "page_id", "last_page_id", "item", "item_type", "during_time", "ts")


@query("WITH " + LOG + " SELECT seq, CAST(pos AS INTEGER) AS pos, item, item_type, page_id FROM disp")
def prj3_displays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.split_displays(logs.split_page(i.good_log(spark, sf_dir)))


@query("WITH " + LOG + " SELECT seq, mid, is_new, ts FROM lg")
def win1_repair_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = logs.parse_log(i.raw_log(spark, sf_dir))
    return logs.repair_is_new(good.select("seq", "common.mid", "common.is_new", "ts"))


@query("WITH " + VISITS + " SELECT seq, mid, CAST(CAST(t AS DATE) AS VARCHAR) AS visit_date, ts FROM uv")
def win2_unique_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.unique_visits(spark, sf_dir).select("seq", "mid", F.col("visit_date").cast("string").alias("visit_date"), "ts")


@query("WITH " + VISITS + " SELECT seq, mid, ts FROM uj")
def win3_user_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.user_jumps(spark, sf_dir).select("seq", "mid", "ts")


@query("WITH " + LOG + " SELECT seq, item AS full_word, ts FROM pg WHERE item_type = 'keyword'")
def prj7_keyword_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = i.page_log(spark, sf_dir)
    return stats.keyword_pages(pages.withColumn("event_time", F.struct("seq", "ts"))).select("rt.seq", "full_word", "rt.ts")


@query("WITH " + VISITS + """ SELECT 'page' AS kind, vc, ch, ar, is_new, count(*) AS n, CAST(sum(CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS sv_ct, CAST(sum(during_time) AS BIGINT) AS dur_sum FROM pg GROUP BY ALL
  UNION ALL SELECT 'uv', vc, ch, ar, is_new, count(*), 0, 0 FROM uv GROUP BY ALL UNION ALL SELECT 'uj', vc, ch, ar, is_new, count(*), 0, 0 FROM uj GROUP BY ALL""")
def prj8_visitor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {
        "page": stats.visitor_rows_page(i.page_log(spark, sf_dir)), "uv": stats.visitor_rows_uv(i.unique_visits(spark, sf_dir)), "uj": stats.visitor_rows_uj(i.user_jumps(spark, sf_dir))}
    rows = stats.union_products([df.withColumn("kind", F.lit(k)) for k, df in parts.items()])
    return rows.groupBy("kind", *stats.VISITOR_KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum("sv_ct").alias("sv_ct"), F.sum("dur_sum").alias("dur_sum"))


# Changes


@query("WITH " + CHANGES + """ SELECT seq, 'shop' AS database, "tableName", type, id, tm_name, logo_url FROM ch WHERE type <> 'delete'""")
def prj4_5_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("after")
    return changes.drop_deletes(i.change_log(spark, sf_dir)).select(
        "seq", "database", "tableName", "type", a["id"].alias("id"), a["tm_name"].alias("tm_name"), a["logo_url"].alias("logo_url"))


@query("WITH " + CHANGES + """, r AS (SELECT "tableName", type, 'dim_' || (seq % 3) AS sink, seq FROM ch WHERE type <> 'delete')
  SELECT "tableName" AS "sourceTable", type AS "operateType", arg_max(sink, seq) AS "sinkTable" FROM r GROUP BY ALL""")
def cdc1_load_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.change_log(spark, sf_dir)
    text = lambda s: F.lit(s).cast("string")
    after = F.create_map(
        text("sourceTable"), F.col("tableName"), text("operateType"), F.col("type"), text("sinkType"), text("hbase"), text("sinkTable"),
        F.concat(F.lit("dim_"), (F.col("seq") % 3).cast("string")), text("sinkColumns"), text("id"), text("sinkPk"), text("id"), text("sinkExtend"), text(None))
    return changes.load_rules(log.withColumn("after", after)).select("sourceTable", "operateType", "sinkTable")


@query("WITH " + CHANGES + """ SELECT seq, CASE WHEN sink = 'dwd_order_info' THEN 'fact' WHEN sink IS NOT NULL THEN 'dim' ELSE 'unmatched' END AS route, sink AS "sinkTable" FROM routed WHERE type <> 'delete'""")
def cdc2_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.route(changes.drop_deletes(i.change_log(spark, sf_dir)), i.rules(spark)).select("seq", "route", "sinkTable")


@query("WITH " + CHANGES + """ SELECT seq, sink AS "sinkTable", CASE WHEN sink = 'dwd_order_info' THEN 'id,tm_name' ELSE 'id,logo_url,tm_name' END AS names, id, tm_name,
  CASE WHEN sink = 'dim_base_trademark' THEN logo_url END AS logo_url FROM routed WHERE sink IS NOT NULL AND type <> 'delete'""")
def cdc3_filter_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.route(changes.drop_deletes(i.change_log(spark, sf_dir)), i.rules(spark)).where("route in ('fact', 'dim')")
    a = F.col("after")
    return changes.filter_columns(rows).select(
        "seq", "sinkTable", F.array_join(F.array_sort(F.map_keys("after")), ",").alias("names"), F.try_element_at("after", F.lit("id")).alias("id"),
        F.try_element_at(a, F.lit("tm_name")).alias("tm_name"), F.try_element_at(a, F.lit("logo_url")).alias("logo_url"))


def _trademarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dims, _ = changes.route_changes(changes.drop_deletes(i.change_log(spark, sf_dir)), i.rules(spark))
    a = F.col("after")
    return dims.select("seq", a["id"].alias("id"), a["tm_name"].alias("tm_name"), a["logo_url"].alias("logo_url"))


_LATEST = " SELECT id, arg_max(tm_name, seq) AS tm_name, arg_max(logo_url, seq) FILTER (WHERE logo_url IS NOT NULL) AS logo_url FROM routed WHERE sink = 'dim_base_trademark' GROUP BY id"


@query("WITH " + CHANGES + _LATEST)
def cdc4_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.latest_by_key(_trademarks(spark, sf_dir))


@query("WITH " + CHANGES + " SELECT id, tm_name, logo_url FROM routed WHERE sink = 'dim_base_trademark'")
def cdc5_project_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dims, _ = changes.route_changes(changes.drop_deletes(i.change_log(spark, sf_dir)), i.rules(spark))
    return changes.project_dim_schema(dims, "id,tm_name,logo_url")


@query("WITH " + CHANGES + """ SELECT seq, 0 AS step, TRUE AS flag, id, tm_name FROM ch WHERE type IN ('insert', 'read') UNION ALL SELECT seq, 0, FALSE, id, old_name FROM ch WHERE type IN ('update', 'delete')
  UNION ALL SELECT seq, 1, TRUE, id, tm_name FROM ch WHERE type = 'update'""")
def cdc6_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.to_retract(i.change_log(spark, sf_dir)).select("seq", "step", "flag", F.col("row")["id"].alias("id"), F.col("row")["tm_name"].alias("tm_name"))


@query("WITH " + CHANGES + """ SELECT id, tm_name, logo_url FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM ch WHERE "tableName" = 'base_trademark') WHERE r = 1 AND type <> 'delete'""")
def cdc7_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.change_log(spark, sf_dir).where("tableName = 'base_trademark'")
    return changes.replay(log).select("id", F.col("row")["tm_name"].alias("tm_name"), F.col("row")["logo_url"].alias("logo_url"))


@query("WITH " + CHANGES + " SELECT sink AS topic, count(*) AS n FROM routed WHERE sink IS NOT NULL GROUP BY sink")
def snk2_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes.route(changes.drop_deletes(i.change_log(spark, sf_dir)), i.rules(spark)).where("route in ('fact', 'dim')")
    return sinks.routed(rows).groupBy("topic").agg(F.count("value").alias("n"))


@query("WITH " + CHANGES + _LATEST)
def snk4_upsert_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts, of even and odd days' changes in order of seq: the later half on top of the earlier."""
    rows = _trademarks(spark, sf_dir)
    half = i.events(spark, sf_dir).agg((F.max("seq") / 2).cast("long").alias("half"))
    marked = rows.crossJoin(F.broadcast(half))  # one row
    first = sinks.upsert_dim(None, marked.where("seq <= half").drop("half"))
    return sinks.upsert_dim(first, marked.where("seq > half").drop("half"))


# Wide facts


@query("WITH " + WIDE + " SELECT i.id AS i_id, d.id AS d_id, epoch_ms(i.ct) AS i_ms, epoch_ms(d.ct) AS d_ms FROM info i JOIN detail d ON i.id = d.order_id AND d.ct BETWEEN i.ct - INTERVAL 10 DAY AND i.ct + INTERVAL 60 DAY")
def joi1_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = wide.prefixed(i.order_info(spark, sf_dir).select("id", "create_ts"), "i_")
    right = wide.prefixed(i.order_detail(spark, sf_dir).select("id", "order_id", "create_ts"), "d_")
    found = wide.interval_join(left, right, [("i_id", "d_order_id")], "i_create_ts", "d_create_ts", "-10 days", "60 days")
    return found.select("i_id", "d_id", F.unix_millis("i_create_ts").alias("i_ms"), F.unix_millis("d_create_ts").alias("d_ms"))


@query("WITH " + WIDE + " SELECT detail_id, order_id, province_id, order_status, user_id, CAST(total_amount AS DOUBLE) AS total_amount, sku_id, sku_num, CAST(split_total_amount AS DOUBLE) AS split_total_amount, CAST(CAST(ct AS DATE) AS VARCHAR) AS create_date, strftime(ct, '%H') AS create_hour FROM wide")
def joi2_order_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(i.order_wide(spark, sf_dir).select(
        "detail_id", "order_id", "province_id", "order_status", "user_id", "total_amount", "sku_id", "sku_num", "split_total_amount", "create_date", "create_hour"))


@query("WITH " + WIDE + " SELECT payment_id, detail_id, order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, payment_type, sku_id, CAST(split_total_amount AS DOUBLE) AS split_total_amount, epoch_ms(ct) AS paid_ms FROM pwide")
def joi3_payment_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(i.payment_wide(spark, sf_dir).select(
        "payment_id", "detail_id", "order_id", "user_id", "total_amount", "payment_type", "sku_id", "split_total_amount", F.unix_millis("payment_create_time").alias("paid_ms")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS create_date, strftime(o_orderdate, '%H') AS create_hour, epoch_ms(o_orderdate) AS ms FROM orders")
def prj6_order_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event time, day and hour of orders from the text of their time."""
    rows = i.order_info(spark, sf_dir).select("id", F.date_format("create_ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"))
    return wide.derive_order_times(rows).select("id", "create_date", "create_hour", F.unix_millis("create_ts").alias("ms"))


@query("WITH " + WIDE + """ SELECT detail_id, order_id, user_id, c_mktsegment AS user_gender, CAST(floor(date_diff('day', DATE '1970-01-01' + CAST(c_custkey % 12000 AS INTEGER), DATE '2020-01-01') / 365.0) AS INTEGER) AS user_age
  FROM wide JOIN customer ON user_id = c_custkey""")
def joi4_user_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.join_user(i.order_wide(spark, sf_dir), i.dim_user(spark, sf_dir), AS_OF).select("detail_id", "order_id", "user_id", "user_gender", "user_age")


@query("WITH " + WIDE + " SELECT detail_id, order_id, province_id, name AS province_name, area AS province_area_code, iso AS province_iso_code, iso2 AS province_3166_2_code FROM wide JOIN prov ON province_id = prov.id")
def joi5_province_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide.join_province(i.order_wide(spark, sf_dir), i.dim_province(spark, sf_dir)).select("detail_id", "order_id", *stats.PROVINCE_KEYS)


@query("WITH " + WIDE + " SELECT detail_id, order_id, sku_id, sku_name, spu_id, 'spu' || spu_id AS spu_name, tm_id, tm_name, category3_id, category3_name FROM wide JOIN sku ON sku_id = sku.id")
def joi6_7_product_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = wide.join_sku(i.order_wide(spark, sf_dir), i.dim_sku(spark, sf_dir))
    rows = wide.join_category3(wide.join_trademark(wide.join_spu(rows, i.dim_spu(spark, sf_dir)), i.dim_trademark(spark, sf_dir)), i.dim_category3(spark, sf_dir))
    return rows.select("detail_id", "order_id", "sku_id", "sku_name", "spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name")


_SPLITS = ("split_activity_amount", "split_coupon_amount", "split_total_amount")


@query("WITH " + WIDE + """,
a AS (SELECT l_orderkey * 10 + l_linenumber AS detail_id, CAST(NULL AS BIGINT) AS order_id, CAST(NULL AS VARCHAR) AS order_status, CAST(NULL AS VARCHAR) AS create_time, CAST(NULL AS VARCHAR) AS create_date,
  CASE WHEN l_returnflag = 'R' THEN l_tax END AS coupon_reduce_amount, CASE WHEN l_returnflag = 'A' THEN l_discount END AS activity_reduce_amount, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS original_total_amount,
  CAST(NULL AS DOUBLE) AS feight_fee, CAST(NULL AS DOUBLE) AS total_amount, CAST(NULL AS BIGINT) AS user_id, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS sku_id, CASE WHEN l_linestatus = 'O' THEN 'line ' || l_partkey END AS sku_name,
  CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS order_price, CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) END AS sku_num, CASE WHEN l_returnflag <> 'A' THEN l_discount END AS split_activity_amount,
  CASE WHEN l_returnflag <> 'R' THEN l_tax END AS split_coupon_amount, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS split_total_amount FROM lineitem),
b AS (SELECT *, strftime(ct, '%Y-%m-%d %H:%M:%S') AS create_time, CAST(CAST(ct AS DATE) AS VARCHAR) AS create_date, CAST(total_amount AS DOUBLE) AS total, CAST(split_total_amount AS DOUBLE) AS split FROM wide)
SELECT coalesce(a.detail_id, b.detail_id) AS detail_id, a.order_id, coalesce(a.order_status, b.order_status) AS order_status, coalesce(a.create_time, b.create_time) AS create_time, coalesce(a.create_date, b.create_date) AS create_date,
  coalesce(a.coupon_reduce_amount, b.split) AS coupon_reduce_amount, coalesce(a.activity_reduce_amount, b.split) AS activity_reduce_amount, coalesce(a.original_total_amount, b.total) AS original_total_amount,
  coalesce(a.feight_fee, CAST(b.sku_num AS DOUBLE)) AS feight_fee, coalesce(a.total_amount, b.total) AS total_amount, coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.sku_id, b.sku_id) AS sku_id,
  coalesce(a.sku_name, 'sku ' || b.sku_id) AS sku_name, coalesce(a.order_price, b.split) AS order_price, coalesce(a.sku_num, b.sku_num) AS sku_num, a.split_activity_amount, a.split_coupon_amount, a.split_total_amount
FROM a FULL JOIN b ON a.detail_id = b.detail_id""")
def joi8_coalesce_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, some of whose columns are missing, filled from the wide order where the interval join has one."""
    line, c = i.table(spark, sf_dir, "lineitem"), F.col
    only = lambda flag, value: F.when(flag, value)
    gone = lambda kind: F.lit(None).cast(kind)
    final = c("l_linestatus") == "F"
    a = line.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("detail_id"), gone("bigint").alias("order_id"), *(gone("string").alias(n) for n in ("order_status", "create_time", "create_date")),
        only(c("l_returnflag") == "R", c("l_tax")).alias("coupon_reduce_amount"), only(c("l_returnflag") == "A", c("l_discount")).alias("activity_reduce_amount"), only(final, c("l_extendedprice")).alias("original_total_amount"),
        *(gone("double").alias(n) for n in ("feight_fee", "total_amount")), gone("bigint").alias("user_id"), only(c("l_returnflag") != "N", c("l_partkey")).alias("sku_id"),
        only(c("l_linestatus") == "O", i.text("line ", c("l_partkey"))).alias("sku_name"), only(c("l_returnflag") == "N", c("l_extendedprice")).alias("order_price"), only(final, c("l_quantity").cast("bigint")).alias("sku_num"),
        only(c("l_returnflag") != "A", c("l_discount")).alias("split_activity_amount"), only(c("l_returnflag") != "R", c("l_tax")).alias("split_coupon_amount"), only(final, c("l_extendedprice")).alias("split_total_amount"))
    total, split = c("total_amount").cast("double"), c("split_total_amount").cast("double")
    b = i.order_wide(spark, sf_dir).select(
        "detail_id", "order_id", "order_status", F.date_format("create_ts", "yyyy-MM-dd HH:mm:ss").alias("create_time"), "create_date", split.alias("coupon_reduce_amount"), split.alias("activity_reduce_amount"),
        total.alias("original_total_amount"), c("sku_num").cast("double").alias("feight_fee"), total.alias("total_amount"), "user_id", "sku_id", i.text("sku ", c("sku_id")).alias("sku_name"), split.alias("order_price"), "sku_num",
        *(split.alias(n) for n in _SPLITS))
    return wide.coalesce_wide(a, b)


# Statistics


def _visitor_stats(spark: SparkSession, sf_dir: str, window: str) -> DataFrame:
    return stats.sum_visitors(stats.visitor_rows(i.page_log(spark, sf_dir), "6 hours"), window, None)


@query("WITH " + _visitors("1 day") + " SELECT * FROM vs")
def agg1_visitor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visitor_stats(spark, sf_dir, "1 day")


def _product_parts(spark: SparkSession, sf_dir: str, days: i.Days = None) -> list[DataFrame]:
    return [
        stats.product_rows_pages(i.plain_pages(spark, sf_dir, days)), stats.product_rows_actions(i.every_action(spark, sf_dir, days)),
        stats.product_rows_order(i.order_wide(spark, sf_dir, days)), stats.product_rows_pay(i.payment_wide(spark, sf_dir, days)), stats.product_rows_refund(i.refunds(spark, sf_dir, days))]


def _product_stats(spark: SparkSession, sf_dir: str, days: i.Days = None, orders_only: bool = False) -> DataFrame:
    """Windows that lie in the range of days are whole, others may not be. Reports of products with revenue need the rows of
    orders only."""
    parts = [stats.product_rows_order(i.order_wide(spark, sf_dir, days))] if orders_only else _product_parts(spark, sf_dir, days)
    dims = (i.dim_sku, i.dim_spu, i.dim_trademark, i.dim_category3)
    return stats.product_stats(parts, *(d(spark, sf_dir) for d in dims), window="30 days", delay=None)


@query(PRODUCTS + """SELECT stt, edt, sku_id, sku_name, CAST(sku_price AS DOUBLE) AS sku_price, spu_id, spu_name, tm_id, tm_name, category3_id, category3_name, CAST(click_ct AS BIGINT) AS click_ct,
  CAST(display_ct AS BIGINT) AS display_ct, CAST(favor_ct AS BIGINT) AS favor_ct, CAST(cart_ct AS BIGINT) AS cart_ct, CAST(order_sku_num AS BIGINT) AS order_sku_num, CAST(order_amount AS DOUBLE) AS order_amount,
  CAST(payment_amount AS DOUBLE) AS payment_amount, CAST(refund_amount AS DOUBLE) AS refund_amount, CAST(comment_ct AS BIGINT) AS comment_ct, CAST(good_comment_ct AS BIGINT) AS good_comment_ct, order_ct, paid_order_ct, refund_order_ct FROM ps""")
def agg2_product_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(_product_stats(spark, sf_dir))


def _province_stats(spark: SparkSession, sf_dir: str, days: i.Days = None) -> DataFrame:
    return stats.province_stats(wide.join_province(i.order_wide(spark, sf_dir, days), i.dim_province(spark, sf_dir)), "30 days", None)


@query(PROVINCES + "SELECT stt, edt, province_id, province_name, province_area_code, province_iso_code, province_3166_2_code, CAST(order_amount AS DOUBLE) AS order_amount, order_count, 1577836800000 AS ts FROM pv")
def agg3_province_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(stats.stamped(_province_stats(spark, sf_dir), F.timestamp_millis(F.lit(1577836800000))))


def _keyword_stats(spark: SparkSession, sf_dir: str, days: i.Days = None) -> DataFrame:
    return stats.keyword_stats(tokenize(stats.keyword_pages(i.plain_pages(spark, sf_dir, days)), "full_word"), "1 day", None)


@query(KEYWORDS + "SELECT *, 1577836800000 AS ts FROM ks")
def agg4_keyword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stamped(_keyword_stats(spark, sf_dir), F.timestamp_millis(F.lit(1577836800000)))


@query(PROVINCES + "SELECT stt, province_id, CAST(order_amount AS DOUBLE) AS order_amount, order_lines AS order_count FROM pv")
def agg5_province_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.province_rows(wide.join_province(i.order_wide(spark, sf_dir), i.dim_province(spark, sf_dir)))
    out = rows.groupBy(F.window("event_time", "30 days"), "province_id").agg(F.sum("order_amount").alias("order_amount"), F.sum("order_count").alias("order_count"))
    return doubles(out.select(stats.bounds()[0], "province_id", "order_amount", "order_count"))


@query(KEYWORDS + "SELECT seq, keyword FROM wd")
def udt1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = i.plain_pages(spark, sf_dir).where("item_type = 'keyword'").select("seq", "item")
    return tokenize(pages, "item").select("seq", "keyword")


# Reports

_OF_ORDER = f"WHERE stt BETWEEN '{ORDER_DAY} 00:00:00' AND '{ORDER_DAY} 23:59:59'"
_OF_EVENT = f"WHERE stt BETWEEN '{EVENT_DAY} 00:00:00' AND '{EVENT_DAY} 23:59:59'"




def _days(day: str, window: int) -> i.Days:
    """Event times of the windows, so many days long, that start on the day."""
    start = datetime.fromisoformat(day)
    return start, start + timedelta(days=window + 1)


_ORDERS, _EVENTS = _days(ORDER_DAY, 30), _days(EVENT_DAY, 1)


def _top(keys: str, limit: int, positive: bool = True, more: str = "") -> str:
    having = "HAVING sum(order_amount) > 0" if positive else ""
    return PRODUCTS + f"SELECT {keys}, CAST(sum(order_amount) AS DOUBLE) AS order_amount{more} FROM ps {_OF_ORDER} GROUP BY {keys} {having} ORDER BY order_amount DESC, {keys} LIMIT {limit}"


@query(PRODUCTS + f"SELECT CAST(sum(order_amount) AS DOUBLE) AS order_amount FROM ps {_OF_ORDER}")
def rpt1_gmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.gmv(_product_stats(spark, sf_dir, _ORDERS), ORDER_DAY))


@query(_top("tm_id, tm_name", 10))
def rpt2_gmv_by_trademark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.gmv_by_trademark(_product_stats(spark, sf_dir, _ORDERS, True), ORDER_DAY))


@query(_top("category3_id, category3_name", 10))
def rpt3_gmv_by_category3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.gmv_by_category3(_product_stats(spark, sf_dir, _ORDERS, True), ORDER_DAY))


@query(_top("spu_id, spu_name", 10, more=", CAST(sum(order_ct) AS BIGINT) AS order_ct"))
def rpt4_gmv_by_spu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.gmv_by_spu(_product_stats(spark, sf_dir, _ORDERS, True), ORDER_DAY))


@query(_top("tm_name", 5, positive=False))
def rpt5_gmv_by_tm_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.gmv_by_tm_name(_product_stats(spark, sf_dir, _ORDERS), ORDER_DAY))


@query(PROVINCES + f"SELECT province_id, province_name, CAST(sum(order_amount) AS DOUBLE) AS order_amount FROM pv {_OF_ORDER} GROUP BY ALL")
def rpt6_amount_by_province(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.amount_by_province(_province_stats(spark, sf_dir, _ORDERS), ORDER_DAY))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visitors_by_new_flag(_visitor_stats(spark, sf_dir, "1 day"), EVENT_DAY)


_FLAGS = "WITH " + _visitors("1 day") + f", fl AS (SELECT is_new, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in reports.MEASURES)} FROM vs {_OF_EVENT} GROUP BY is_new)"


@query(_FLAGS + " SELECT * FROM fl")
def rpt7_visitors_by_new_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


_HOURS = "WITH " + _visitors("1 hour") + f""", hr AS (SELECT CAST(substr(stt, 12, 2) AS INTEGER) AS hr, CAST(sum(CASE WHEN is_new = '1' THEN uv_ct ELSE 0 END) AS BIGINT) AS new_uv, CAST(sum(uv_ct) AS BIGINT) AS uv_ct,
  CAST(sum(pv_ct) AS BIGINT) AS pv_ct, CAST(sum(uj_ct) AS BIGINT) AS uj_ct FROM vs {_OF_EVENT} GROUP BY ALL)"""


@query(_HOURS + " SELECT * FROM hr")
def rpt8_visitors_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visitors_by_hour(_visitor_stats(spark, sf_dir, "1 hour"), EVENT_DAY)


@query(_HOURS + " SELECT lpad(CAST(n AS VARCHAR), 2, '0') AS hr, coalesce(new_uv, 0) AS new_uv, coalesce(uv_ct, 0) AS uv_ct, coalesce(pv_ct, 0) AS pv_ct, coalesce(uj_ct, 0) AS uj_ct FROM range(24) t(n) LEFT JOIN hr ON hr.hr = n")
def win4_fill_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.fill_hours(reports.visitors_by_hour(_visitor_stats(spark, sf_dir, "1 hour"), EVENT_DAY))


def _half_up(x: str, scale: int) -> str:
    return f"floor(CAST({x} AS DECIMAL(38,12)) * {10**scale} + 0.5) / {10**scale}"


@query(_FLAGS + f""" SELECT *, CAST({_half_up("uj_ct * 100.0 / sv_ct", 2)} AS DOUBLE) AS uj_rate, CAST({_half_up("floor(CAST(dur_sum * 1.0 / sv_ct AS DECIMAL(38,12)) + 0.5) / 1000.0", 1)} AS DOUBLE) AS dur_per_sv,
  CAST({_half_up("pv_ct * 1.0 / sv_ct", 2)} AS DOUBLE) AS pv_per_sv FROM fl""")
def rpt9_visitor_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(reports.visitor_ratios(_flags(spark, sf_dir)))


@query(_FLAGS + " , u AS (" + " UNION ALL ".join(f"SELECT '{m}' AS measure, is_new, {m} AS value FROM fl" for m in reports.MEASURES) + """) SELECT measure, CAST(coalesce(sum(CASE WHEN is_new = '1' THEN value END), 0) AS BIGINT) AS "new",
  CAST(coalesce(sum(CASE WHEN is_new <> '1' THEN value END), 0) AS BIGINT) AS "old" FROM u GROUP BY measure""")
def rpt10_visitor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visitor_table(_flags(spark, sf_dir))


@query(KEYWORDS + f"SELECT keyword, CAST(sum(ct * 10) AS BIGINT) AS ct FROM ks {_OF_EVENT} GROUP BY keyword ORDER BY sum(ct) DESC, keyword LIMIT 20")
def rpt11_keyword_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.keyword_ranking(_keyword_stats(spark, sf_dir, _EVENTS), EVENT_DAY)


from . import streamed  # noqa: E402, F401  registers its queries too
