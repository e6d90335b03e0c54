"""streams whose state is Parquet equal the batch forms over late starts, batches done again and rows out of order, and keep
little; queries over many lines take them."""

from __future__ import annotations

import json
import os
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brookmart.jobs import streamed
from brookmart.operators import stats, wide
from brookmart.streaming import kept
from tests.oracle import connect, rows

DATA = "/root/testdata/sf0.01"
START = datetime(2020, 1, 1, tzinfo=UTC)


def put(path, n, found):
    path.mkdir(exist_ok=True, parents=True)
    (path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in found))


def source(spark, path, schema, stream):
    return (spark.readStream if stream else spark.read).schema(schema).json(str(path)).withColumn("create_ts", F.timestamp_seconds("s")).drop("s")


def seconds(days):
    return int((START + timedelta(days=days)).timestamp())


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


INFO, DETAIL = "id long, province_id long, s long", "id long, order_id long, sku_id long, sku_num long, split_total_amount string, s long"


@pytest.mark.parametrize("ahead", [0, 40, -40])
def test_wide_orders_of_many_batches(spark, tmp_path, ahead):
    """Rows up to 29 days late, one input ahead of the other, both ends of the interval."""
    rng = random.Random(ahead)
    orders = [(k, rng.randint(0, 300)) for k in range(200)]
    lines = [(10 * k + n, k, day + rng.choice([-31, -30, 30, 31, rng.randint(-35, 35)])) for k, day in orders for n in range(3)]
    info = [(d + rng.randint(0, 29) + max(ahead, 0), {"id": k, "province_id": k % 3, "s": seconds(d)}) for k, d in orders]
    detail = [(d + rng.randint(0, 29) + max(-ahead, 0), {"id": i, "order_id": k, "sku_id": k % 7, "sku_num": 1, "split_total_amount": "1.00", "s": seconds(d)}) for i, k, d in lines]
    path, days = str(tmp_path / "wide"), lambda n: timedelta(days=n)
    for n, (low, high) in enumerate([(-99, 80), (80, 160), (160, 161), (161, 999)]):
        for name, every in (("info", info), ("detail", detail)):
            put(tmp_path / name, n, [r for when, r in every if low <= when < high])
        q = kept.order_wide(source(spark, tmp_path / "info", INFO, True), source(spark, tmp_path / "detail", DETAIL, True), days(-30), days(30), (days(30), days(30)), path, str(tmp_path / "c"), True)
        streamed.finished(q)
    want = wide.order_wide(source(spark, tmp_path / "info", INFO, False), source(spark, tmp_path / "detail", DETAIL, False), "-30 days", "30 days")
    got = spark.read.parquet(path + "/rows/batch=*")
    assert got.count() > 300 and found(got) == found(want.select(got.columns))
    assert os.listdir(path + "/kept") == ["3"] and 0 < spark.read.parquet(path + "/kept/3").count() < 350  # of 800


def test_batch_done_again(spark, tmp_path):
    path, days, schema = str(tmp_path / "wide"), lambda n: timedelta(days=n), "id long, a timestamp, order_id long, b timestamp"
    at = lambda n: START + timedelta(days=n)

    def go():
        left, right = (spark.readStream.schema(schema).parquet(str(tmp_path / side)) for side in ("left", "right"))
        streamed.finished(kept.interval_join(left.select("id", "a"), right.select("order_id", "b"), ("id", "order_id"), ("a", "b"), days(0), days(5), (days(5), days(5)), path, str(tmp_path / "c"), True))

    for n in (0, 1):
        for side in ("left", "right"):
            spark.createDataFrame([(k, at(k + 3 * n), k, at(k + 4 - n)) for k in range(20 * n, 20 * n + 30)], schema).write.mode("append").parquet(str(tmp_path / side))
        go()
    before = found(spark.read.parquet(path + "/rows"))
    assert len(before) > 40
    for f in ("commits/1", "commits/.1.crc"):
        os.remove(tmp_path / "c" / f)
    go()  # its marks are there: nothing to do
    assert found(spark.read.parquet(path + "/rows")) == before and os.listdir(path + "/kept") == ["1"]


def product_rows(spark, root, stream):
    df = source(spark, root, DETAIL.replace("s long", "kind string, s long"), stream)
    of = lambda kind: df.where(F.col("kind") == kind)
    paid = of("pay").withColumn("payment_create_time", F.col("create_ts"))
    return {"order": stats.product_rows_order(of("order")), "pay": stats.product_rows_pay(paid), "comment": stats.product_rows_comment(of("comment").withColumn("appraise", F.lit("1201")))}


def test_products_of_many_batches(spark, monkeypatch, tmp_path):
    """Lines of an order in different batches count once; a batch that failed before its marks is done again."""
    rng, path = random.Random(5), str(tmp_path / "stats")

    def lost(*_):
        raise OSError("lost")

    def go():
        parts = product_rows(spark, tmp_path / "in", True)
        streamed.finished(kept.product_stats({k: (df, timedelta(days=10 + len(k))) for k, df in parts.items()}, path, str(tmp_path / "c"), "7 days", True))

    for n in range(4):
        days = [20 * n + rng.randint(-9, 20) for _ in range(150)]
        put(tmp_path / "in", n, [{"id": k, "kind": rng.choice(["order", "pay", "comment"]), "order_id": d // 2, "sku_id": 1 + k % 3, "sku_num": k, "split_total_amount": "1.25", "s": seconds(max(d, 0))} for k, d in enumerate(days)])
        if n == 2:
            with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
                m.setattr(kept.Kept, "put", lost)
                go()
        go()
        if n == 2:
            assert len(os.listdir(path + "/marks")) == 2 and os.listdir(path + "/kept") == ["2"]  # marks and their checksum
    got = spark.read.parquet(path + "/rows/batch=*")
    want = stats.sum_products(stats.union_products(list(product_rows(spark, tmp_path / "in", False).values())), "7 days", None)
    last = got.agg(F.max("edt")).first()[0]
    assert last >= "2020-02-20" and found(got) == found(want.where(F.col("edt") <= last).select(got.columns))
    assert max(r.order_ct for r in got.collect()) > 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["agg2_product_stream", "agg3_province_stream", "joi3_payment_stream"])
def test_many_lines_stay_out_of_state_stores(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(streamed, "MANY_LINES", 0)
    monkeypatch.setattr(streamed, "scratch", lambda spark, name: str(tmp_path))
    got = getattr(streamed, name)(spark, DATA).toPandas()
    want = connect(DATA).execute(streamed.SQL[name]).df()
    assert len(got) > 100 and rows(got) == rows(want)
    assert not (tmp_path / "checkpoint-orders/state").exists()
    size = lambda at: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(at) for f in fs)
    assert size(tmp_path) < 1.5 * size(DATA)


def test_batch_without_rows(spark, tmp_path):
    """Files whose rows are all filtered out: the batch ends, and marks stay."""
    path = str(tmp_path / "stats")
    line = {"id": 1, "order_id": 1, "sku_id": 1, "sku_num": 1, "split_total_amount": "1.00", "s": seconds(1)}
    for n, kind in enumerate(["other", "order", "other"]):
        put(tmp_path / "in", n, [line | {"kind": kind}])
        parts = product_rows(spark, tmp_path / "in", True)
        streamed.finished(kept.product_stats({k: (df, timedelta(days=1)) for k, df in parts.items()}, path, str(tmp_path / "c"), "7 days", True))
        assert kept.Kept(spark, path).newest()[1] == ({} if n == 0 else {"order": seconds(1) * 1_000_000, "watermark": seconds(0) * 1_000_000})
