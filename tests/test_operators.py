from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brookmart.functions.text import tokenize
from brookmart.operators import changes, logs, reports, stats, visits, wide
from brookmart.sources import io, sinks


def t(text: str) -> datetime:
    return datetime.fromisoformat(text)


LINES = [
    (1, '{"common":{"mid":"a","is_new":"1","vc":"v","ch":"c","ar":"r"},"start":{"entry":"icon"},"ts":1000}'),
    (2, '{"common":{"mid":"a","is_new":"1","vc":"v","ch":"c","ar":"r"},"page":{"page_id":"p","during_time":5},"displays":[{"item":"1","item_type":"sku_id"},{"item":"2","item_type":"x"}],"ts":2000}'),
    (3, '{"common":{"mid":"a","is_new":"0"},"page":{"page_id":"p"},"ts":1500}'), (4, '{"common":{"is_new":"1"},"ts":1}'), (5, '{"common":{"mid"'), (6, None),
]


def test_log_parse_split_repair(spark):
    df = spark.createDataFrame(LINES, "seq long, value string")
    good, dirty = logs.parse_log(df)
    assert sorted(r.seq for r in good.collect()) == [1, 2, 3]
    assert {r.seq: r.value for r in dirty.collect()} == {4: LINES[3][1], 5: LINES[4][1], 6: None}
    assert [r.seq for r in logs.split_start(good).collect()] == [1]
    shown = logs.split_displays(logs.split_page(good)).collect()
    assert sorted((r.seq, r.item, r.page_id) for r in shown) == [(2, "1", "p"), (2, "2", "p")]
    fixed = logs.repair_is_new(good.select("seq", "common.mid", "common.is_new", "ts"))
    assert {r.seq: r.is_new for r in fixed.collect()} == {1: "1", 2: "0", 3: "0"}


def _pages(spark, rows):
    return spark.createDataFrame(rows, "mid string, ts long, seq long, last_page_id string").withColumn("event_time", F.timestamp_millis("ts"))


@pytest.mark.parametrize(("gap", "jumps"), [(9_999, [2]), (10_000, [1, 2]), (10_001, [1, 2])])
def test_jump_boundary(spark, gap, jumps):
    rows = [("a", 0, 1, None), ("a", gap, 3, "home"), ("b", 0, 2, None)]
    assert sorted(r.seq for r in visits.user_jumps(_pages(spark, rows)).collect()) == jumps


def test_jump_next_entry_and_ties(spark):
    rows = [("a", 0, 1, None), ("a", 0, 2, None), ("a", 0, 3, "x")]
    assert [r.seq for r in visits.user_jumps(_pages(spark, rows)).collect()] == [1]


def test_unique_visits(spark):
    day = 86_400_000
    rows = [("a", 5, 2, None), ("a", 1, 1, "x"), ("a", 5, 1, None), ("a", day, 4, None), ("b", day + 1, 5, None)]
    assert sorted((r.mid, r.seq, str(r.visit_date)) for r in visits.unique_visits(_pages(spark, rows)).collect()) == [
        ("a", 1, "1970-01-01"), ("a", 4, "1970-01-02"), ("b", 5, "1970-01-02")]


def test_changes(spark):
    rows = [(1, "s.db.t", None, {"id": "1", "x": "a"}, "c"), (2, "s.db.t", {"id": "1", "x": "a"}, {"id": "1", "x": None}, "u"), (3, "s.db.t", {"id": "2"}, None, "d"), (4, "s.db.t", None, {"id": "3", "x": "z"}, "R")]
    log = changes.normalise_change(spark.createDataFrame(rows, "seq long, topic string, before map<string,string>, after map<string,string>, op string"))
    assert [(r.database, r.tableName, r.type) for r in log.orderBy("seq").collect()] == [("db", "t", k) for k in ("insert", "update", "delete", "read")]
    kept = changes.drop_deletes(log.withColumn("type", F.when(F.col("seq") == 4, None).otherwise(F.col("type"))))
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 4]
    flat = kept.select("seq", F.col("after")["id"].alias("id"), F.col("after")["x"].alias("x"))
    assert {r.id: r.x for r in changes.latest_by_key(flat).collect()} == {"1": "a", "3": "z"}
    assert {r.id: r.x for r in changes.latest_by_key(flat, null_overwrites=True).collect()} == {"1": None, "3": "z"}
    assert sorted((r.seq, r.flag) for r in changes.to_retract(log).collect()) == [(1, True), (2, False), (2, True), (3, False), (4, True)]
    assert sorted(r.id for r in changes.replay(log).collect()) == ["1", "3"]


def test_rules_and_columns(spark):
    rule = lambda table, cols: {"sourceTable": table, "operateType": "insert", "sinkType": "kafka", "sinkTable": "f", "sinkColumns": cols}
    events = [(1, rule("t", "id"), "insert"), (2, rule("t", "id, x"), "update"), (3, rule("t", "q"), "delete")]
    rules = changes.load_rules(spark.createDataFrame(events, "seq long, after map<string,string>, type string"))
    assert [r.sinkColumns for r in rules.collect()] == ["id, x"]
    df = spark.createDataFrame([("t", "insert", {"id": "1", "x": "2", " x": "3"}), ("u", "insert", {"id": "1"})], "tableName string, type string, after map<string,string>")
    facts, dims, rest = changes.route_changes(df, rules)
    assert changes.filter_columns(facts).first().after == {"id": "1", " x": "3"}
    assert (dims.count(), [r.tableName for r in rest.collect()]) == (0, ["u"])
    assert [tuple(r) for r in changes.project_dim_schema(df, "x,id").collect()] == [("2", "1"), (None, "1")]


@pytest.mark.parametrize(("at", "n"), [("2024-01-01 00:00:02", 1), ("2023-12-31 23:59:58", 1), ("2024-01-01 00:00:02.001", 0), ("2023-12-31 23:59:57.999", 0)])
def test_interval_bounds(spark, at, n):
    info = spark.createDataFrame([(1, t("2024-01-01 00:00:00"))], "id long, create_ts timestamp")
    detail = spark.createDataFrame([(7, 1, t(at))], "id long, order_id long, create_ts timestamp")
    assert wide.order_wide(info, detail).count() == n


def test_wide_lookups(spark):
    info = spark.createDataFrame([(1, 5, 9, "10.00")], "id long, user_id long, province_id long, total_amount string").withColumn("create_ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    detail = spark.createDataFrame([(7, 1, 3), (8, 1, 4)], "id long, order_id long, sku_id long").withColumn("create_ts", F.lit("2024-01-01 10:00:01").cast("timestamp"))
    rows = wide.order_wide(info, detail)
    assert {r.detail_id: (r.create_hour, r.expire_time) for r in rows.collect()} == {7: ("10", None), 8: ("10", None)}
    pay = spark.createDataFrame([(2, 1, 6, "11.00")], "id long, order_id long, user_id long, total_amount string").withColumn("create_ts", F.lit("2024-01-01 10:15:00").cast("timestamp"))
    assert sorted((r.detail_id, r.user_id, r.total_amount) for r in wide.payment_wide(rows, pay).collect()) == [(7, 6, "11.00"), (8, 6, "11.00")]
    sku = spark.createDataFrame([(3, "s", 1, 2, 4)], "id long, sku_name string, category3_id long, spu_id long, tm_id long")
    assert [r.detail_id for r in wide.join_sku(rows, sku).collect()] == [7]
    assert {r.detail_id: r.sku_name for r in wide.join_sku(rows, sku, "left").collect()} == {7: "s", 8: None}
    user = spark.createDataFrame([(5, "F", "2000-01-01")], "id long, gender string, birthday string")
    assert {r.user_age for r in wide.join_user(rows, user, t("2009-12-29 00:00:00")).collect()} == {10}
    assert {r.user_age for r in wide.join_user(rows, user, t("2009-12-28 00:00:00")).collect()} == {9}
    times = wide.derive_order_times(spark.createDataFrame([("2024-01-02 03:04:05",), ("bad",)], "create_time string"))
    assert [(r.create_date, r.create_hour) for r in times.collect()] == [("2024-01-02", "03"), (None, None)]


def test_product_orders_are_counted_once(spark):
    rows = spark.createDataFrame([(1, 10, 2, "5.00"), (1, 10, 1, "2.50"), (1, 11, 1, "1.00")], "sku_id long, order_id long, sku_num long, split_total_amount string")
    parts = [stats.product_rows_order(rows.withColumn("create_ts", F.lit("2024-01-01 00:00:03").cast("timestamp")))]
    r = stats.sum_products(stats.union_products(parts), delay=None).first()
    assert (r.order_ct, r.paid_order_ct, r.order_sku_num, float(r.order_amount), r.stt, r.edt) == (2, 0, 4, 8.5, "2024-01-01 00:00:00", "2024-01-01 00:00:10")


def test_province_scale(spark):
    keys = [F.lit("x").alias(k) for k in stats.PROVINCE_KEYS]
    rows = spark.createDataFrame([(1, "1.50"), (1, "1.40"), (2, "1.00")], "order_id long, split_total_amount string").select("*", *keys, F.lit("2024-01-01").cast("timestamp").alias("create_ts"))
    assert [(float(r.order_amount), r.order_count) for r in stats.province_stats(rows, delay=None).collect()] == [(3.9, 2)]
    assert [float(r.order_amount) for r in stats.province_stats(rows, delay=None, scale=0).collect()] == [4.0]


def test_reports(spark):
    flags = spark.createDataFrame([("1", 2, 7, 3, 1, 10_000), ("0", 0, 0, 0, 0, 0), ("x", 1, 5, 0, 4, 2)], "is_new string, uv_ct long, pv_ct long, sv_ct long, uj_ct long, dur_sum long")
    got = {r.is_new: (r.uj_rate, r.dur_per_sv, r.pv_per_sv) for r in reports.visitor_ratios(flags).collect()}
    assert [float(x) for x in got["1"]] == [33.33, 3.3, 2.33]
    assert [float(x) for x in got["0"]] == [0, 0, 0]
    assert got["x"] == (None, None, None)
    assert {r.measure: (r.new, r.old) for r in reports.visitor_table(flags).collect()}["pv_ct"] == (7, 5)
    assert {r.measure: (r.new, r.old) for r in reports.visitor_table(flags.where("is_new = '1'")).collect()}["uj_ct"] == (1, 0)
    words = spark.createDataFrame([("2024-01-01 00:00:00", "a", "search", 2), ("2024-01-01 00:00:10", "b", "ORDER", 5), ("2024-01-02 00:00:00", "a", "CART", 9)], "stt string, keyword string, source string, ct long")
    assert [tuple(r) for r in reports.keyword_ranking(words, "2024-01-01").collect()] == [("b", 15), ("a", 20)]


def test_tokenize(spark):
    df = spark.createDataFrame([(1, "Red widget, w-3"), (2, None), (3, "中国人民 x")], "id long, text string")
    plain = tokenize(df, "text").collect()
    assert [r.keyword for r in plain if r.id == 1] == ["red", "widget", "w", "3"]
    assert [r.keyword for r in plain if r.id == 3] == ["中国人民", "x"]
    fine = tokenize(df, "text", ["中国", "中国人", "国人"]).collect()
    assert [r.keyword for r in fine if r.id == 3] == ["中国人", "中国", "国人", "民", "x"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/app.2024-01-01.log").write_text('{"database":"d","tableName":"t","after":{"id":"1"},"type":"insert"}\nbad\n')
    assert io.read_json_lines(spark, str(tmp_path / "log")).count() == 2
    log = io.read_changelog(spark, str(tmp_path / "log"))
    assert [r.tableName for r in log.collect()] == ["t", None]
    assert io.camel_columns(spark.createDataFrame([(1, 2)], "ORDER_ID long, tm_name long")).columns == ["orderId", "tmName"]
    df = spark.createDataFrame([("f", {"id": "1"}), ("g", {"id": "2"}), ("f", {"id": "3"})], "sinkTable string, after map<string,string>")
    for _ in range(2):  # the same batch twice
        sinks.write_routed(df, str(tmp_path / "routed"), 0)
    got = spark.read.format("text").load(str(tmp_path / "routed"))
    assert sorted((r.topic, r.value) for r in got.collect()) == [("f", '{"id":"1"}'), ("f", '{"id":"3"}'), ("g", '{"id":"2"}')]
    s = spark.createDataFrame([("2024-01-01 00:00:00", 1, 2)], "stt string, n long, hidden long")
    for batch in (0, 0, 1):
        sinks.write_stats(s, str(tmp_path / "stats"), batch, ["stt", "n"])
    stored = spark.read.parquet(str(tmp_path / "stats"))
    assert stored.count() == 2 and "hidden" not in stored.columns
    for _ in range(2):
        sinks.write_topic(s, str(tmp_path / "topic"), 7)
    assert io.read_topic(spark, "t", path=str(tmp_path / "topic")).count() == 1
    assert io.read_topic(spark, "t", path=str(tmp_path / "topic")).first().value == '{"stt":"2024-01-01 00:00:00","n":1,"hidden":2}'


def test_upsert_keeps_what_a_change_lacks(spark):
    old = spark.createDataFrame([("1", "a", "b"), ("2", "c", "d")], "id string, x string, y string")
    new = spark.createDataFrame([(1, "1", "z", None), (2, "3", "n", "m")], "seq long, id string, x string, y string")
    assert sorted(tuple(r) for r in sinks.upsert_dim(old, new).collect()) == [("1", "z", "b"), ("2", "c", "d"), ("3", "n", "m")]
    assert ("1", "z", None) in [tuple(r) for r in sinks.upsert_dim(old, new, null_overwrites=True).collect()]


def test_reports_read_only_their_day(spark, tmp_path):
    s = spark.createDataFrame([(f"2024-01-0{d} 0{d}:00:00", "5.00") for d in (1, 2, 3)], "stt string, order_amount string")
    sinks.write_stats(s, str(tmp_path / "stats"))
    stored = reports.of_day(spark.read.parquet(str(tmp_path / "stats")), "2024-01-02")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [float(r.order_amount) for r in reports.gmv(spark.read.parquet(str(tmp_path / "stats")), "2024-01-02").collect()] == [5.0]


def test_jdbc_tables(spark, tmp_path):
    """Written to and read from an embedded database, whole and by ranges of a column."""
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    df = spark.createDataFrame([(k, f"n{k}", None if k % 2 else k * 1.5) for k in range(20)], "SKU_ID long, TM_NAME string, AMOUNT double")
    for n in (0, 1):
        sinks.write_stats_jdbc(df, url, "STATS", n, driver=driver)
    found = io.read_table(spark, url, 'select "SKU_ID", "TM_NAME", "AMOUNT" from STATS where "batch_id" = 1', camel=True, driver=driver)
    assert found.columns == ["skuId", "tmName", "amount"]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, df.collect()))
    parts = io.read_table(spark, url, "select * from STATS", "SKU_ID", (0, 20), 4, driver=driver)
    assert parts.count() == 40 and parts.rdd.getNumPartitions() == 4


def test_a_batch_cannot_start_at_the_latest(spark):
    with pytest.raises(ValueError, match="latest"):
        io.read_topic(spark, "t", "localhost:1", starting="latest")


def test_coalesce_fills_only_what_it_may(spark):
    names = "detail_id long, order_id long, user_id long, sku_name string, split_total_amount double"
    a = spark.createDataFrame([(1, None, None, "a", None), (2, 5, 6, None, 1.0)], names)
    b = spark.createDataFrame([(1, 9, 8, "b", 7.0), (3, 9, 8, "c", 7.0)], names)
    assert sorted(map(tuple, wide.coalesce_wide(a, b).collect())) == [(1, None, 8, "a", None), (2, 5, 6, None, 1.0), (3, None, 8, "c", None)]


def test_products_in_one_pass(spark):
    """One pass over pages, and one over actions, give the rows of the single functions."""
    pages = spark.createDataFrame(
        [("good_detail", "sku_id", "5", [("6", "sku_id"), ("7", "activity_id"), (None, "sku_id"), ("x", "sku_id")]), ("home", "sku_id", "5", None), ("good_detail", "keyword", "w", []), (None, None, None, [("8", None)])],
        "page_id string, item_type string, item string, displays array<struct<item:string,item_type:string>>").withColumn("event_time", F.lit("2024-01-01").cast("timestamp"))
    apart = stats.product_rows_click(pages).unionByName(stats.product_rows_display(pages))
    assert sorted(map(str, stats.product_rows_pages(pages).collect())) == sorted(map(str, apart.collect()))
    acts = spark.createDataFrame([(1, "1201", "favor"), (2, "1201", "cart"), (3, "1201", "comment"), (4, None, "comment"), (5, "1202", "other")], "sku_id long, appraise string, action string").withColumn("create_ts", F.lit("2024-01-01").cast("timestamp"))
    of = lambda k: acts.where(F.col("action") == k)
    apart = stats.union_products([stats.product_rows_favor(of("favor")), stats.product_rows_cart(of("cart")), stats.product_rows_comment(of("comment"))])
    assert sorted(map(str, stats.product_rows_actions(acts).collect())) == sorted(map(str, apart.collect()))
