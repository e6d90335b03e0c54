from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from brookmart.operators import logs, stats, visits, wide
from brookmart.sources.versions import DimStore
from brookmart.streaming import state, streams

SCHEMA = "mid string, ts long, seq long, last_page_id string, is_new string, vc string, ch string, ar string, item string, item_type string"


def page(mid, ts, seq, last=None, is_new="0", item=None):
    return {"mid": mid, "ts": ts, "seq": seq, "last_page_id": last, "is_new": is_new, "vc": "v", "ch": "c", "ar": "a", "item": item, "item_type": "keyword" if item else None}


def files(path, batches):
    path.mkdir()
    for n, rows in enumerate(batches):
        (path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files are taken by age
    return str(path)


def source(spark, path):
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    return df.withColumn("event_time", F.timestamp_millis("ts"))


def batch(spark, path):
    return spark.read.schema(SCHEMA).json(path).withColumn("event_time", F.timestamp_millis("ts"))


def run(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_first_new_flag_over_batches(spark, tmp_path):
    path = files(tmp_path / "in", [[page("a", 5, 2, is_new="1"), page("a", 9, 1, is_new="1"), page("b", 1, 3)], [page("a", 1, 4, is_new="1"), page("b", 2, 5, is_new="1")]])
    rows = source(spark, path).select("mid", "seq", "is_new", "ts")
    got = {r.seq: r.is_new for r in run(state.repair_is_new(rows), "flags", tmp_path / "c")}
    assert got == {1: "1", 2: "0", 3: "0", 4: "0", 5: "1"}
    assert got[1] == {r.seq: r.is_new for r in logs.repair_is_new(batch(spark, path), order=("seq",)).collect()}[1]


def test_jumps_equal_batch_and_late_rows_go(spark, tmp_path):
    first = [page("a", 1000, 1), page("a", 5000, 2, "x"), page("b", 2000, 3), page("c", 3000, 4), page("c", 3500, 5), page("d", 3000, 7, "x")]
    second = [page("d", 4000, 8), page("d", 14_000, 9, "x"), page("a", 13_000, 10)]
    end = [page("z", 100_000, 20), page("z", 100_001, 21, "x")]
    path = files(tmp_path / "in", [first, second, end, [page("late", 100, 30)], [page("z", 200_000, 40, "x")]])
    got = sorted(r.seq for r in run(streams.user_jumps(source(spark, path)), "jumps", tmp_path / "c"))
    closed = batch(spark, path).where("ts < 50000 and mid <> 'late'")
    assert got == sorted(r.seq for r in visits.user_jumps(closed).collect()) == [3, 4, 5, 8, 10]


def test_unique_visits_stream(spark, tmp_path):
    path = files(tmp_path / "in", [[page("a", 1000, 1), page("a", 2000, 2), page("b", 1, 3, "x")], [page("a", 3000, 4), page("a", 86_400_000, 5)]])
    got = run(streams.unique_visits(source(spark, path)), "visits", tmp_path / "c")
    assert sorted((r.mid, str(r.visit_date)) for r in got) == [("a", "1970-01-01"), ("a", "1970-01-02")]


def test_keyword_windows_equal_batch(spark, tmp_path):
    path = files(tmp_path / "in", [[page("a", 1000, 1, item="red box"), page("a", 9000, 2, item="red")], [page("a", 12_000, 3, item="red")], [page("a", 100_000, 4, item="end")]])
    got = sorted((r.stt, r.keyword, r.ct) for r in run(streams.keyword_stats(source(spark, path)), "words", tmp_path / "c"))
    from brookmart.functions.text import tokenize

    want = stats.keyword_stats(tokenize(stats.keyword_pages(batch(spark, path)), "full_word"), delay=None).where("keyword <> 'end'")
    assert got == sorted((r.stt, r.keyword, r.ct) for r in want.collect()) == [("1970-01-01 00:00:00", "box", 1), ("1970-01-01 00:00:00", "red", 2), ("1970-01-01 00:00:10", "red", 1)]


def test_order_wide_then_province_windows(spark, tmp_path):
    schema = "id long, order_id long, province_id string, split_total_amount string, ts long"
    for name, rows in (("info", [(1, None, "p", None, 1000), (2, None, "p", None, 4000), (9, None, "p", None, 200_000)]), ("detail", [(11, 1, None, "2.00", 2000), (12, 1, None, "3.00", 3000), (13, 2, None, "1.00", 9000), (19, 9, None, "1.00", 200_000)])):
        files(tmp_path / name, [[dict(zip(("id", "order_id", "province_id", "split_total_amount", "ts"), r, strict=True)) for r in part] for part in (rows[:-1], rows[-1:])])

    def read(name, stream):
        reader = spark.readStream.option("maxFilesPerTrigger", 1) if stream else spark.read
        df = reader.schema(schema).json(str(tmp_path / name)).withColumn("create_ts", F.timestamp_millis("ts"))
        return df.select("id", "province_id", "create_ts") if name == "info" else df.select("id", "order_id", "split_total_amount", "create_ts")

    def provinces(df):
        for k in stats.PROVINCE_KEYS[1:]:
            df = df.withColumn(k, F.lit("x"))
        return df

    joined = streams.order_wide(read("info", True), read("detail", True))
    got = run(joined.select("order_id", "detail_id"), "wide", tmp_path / "c1")
    assert sorted(map(tuple, got)) == [(1, 11), (1, 12), (9, 19)]
    want = stats.province_stats(provinces(wide.order_wide(read("info", False), read("detail", False))), delay=None).where("stt < '1970-01-01 00:01:00'")
    assert [(float(r.order_amount), r.order_count) for r in want.collect()] == [(5.0, 1)]


def test_route_stream_restarts_and_sees_new_rules(spark, tmp_path):
    schema = "database string, tableName string, before map<string,string>, after map<string,string>, type string"
    rule = "sourceTable string, operateType string, sinkType string, sinkTable string, sinkColumns string, sinkPk string"
    now = [[("t", "insert", "kafka", "f1", "id", None)]]
    path = tmp_path / "in"
    event = lambda n: {"database": "d", "tableName": "t", "after": {"id": str(n), "x": "y"}, "type": "insert"}
    files(path, [[event(1)]])

    def go():
        df = spark.readStream.schema(schema).json(str(path))
        q = streams.route_stream(df, lambda: spark.createDataFrame(now[0], rule), str(tmp_path / "out"), str(tmp_path / "c"), True)
        q.awaitTermination(120)

    go()
    now[0] = [("t", "insert", "kafka", "f2", "id", None)]
    (path / "1.json").write_text(json.dumps(event(2)))
    go()
    go()
    got = spark.read.format("text").load(str(tmp_path / "out")).collect()
    assert sorted((r.topic, r.value) for r in got) == [("f1", '{"id":"1"}'), ("f2", '{"id":"2"}')]


def test_payment_times(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("bad",)], "create_time string").withColumn("at", F.lit("2020-01-01").cast("timestamp"))
    assert [str(r.create_ts) for r in streams.payment_times(df, "at").collect()] == ["2024-01-01 00:00:00", "2020-01-01 00:00:00"]


def test_dim_stream_restarts_on_its_snapshot(spark, tmp_path):
    schema, path = "seq long, id string, x string, y string", tmp_path / "in"
    files(path, [[{"seq": 1, "id": "a", "x": "1", "y": "1"}, {"seq": 2, "id": "b", "x": "2"}], [{"seq": 3, "id": "a", "x": "9"}]])

    def go():
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path))
        q = streams.dim_stream(df, str(tmp_path / "dim"), str(tmp_path / "c"), available=True)
        q.awaitTermination(120)
        assert q.exception() is None

    go()
    (path / "2.json").write_text(json.dumps({"seq": 4, "id": "c", "x": "3"}) + "\n" + json.dumps({"seq": 5, "id": "b", "y": "4"}))
    go()
    go()
    state_at = lambda n: sorted(map(tuple, DimStore(spark, f"{tmp_path}/dim").dim(n).select("id", "x", "y").collect()))
    assert state_at(1) == [("a", "9", "1"), ("b", "2", None)]
    assert state_at(2) == [("a", "9", "1"), ("b", "2", "4"), ("c", "3", None)]
