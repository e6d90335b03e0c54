"""A device that holds nine rows in ten: same rows as the window forms, spread over tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brookmart.operators import logs, stats, visits

SCHEMA = "mid string, ts long, seq long, last_page_id string, is_new string, vc string, ch string, ar string, during_time long"


@pytest.fixture(scope="module")
def pages(spark):
    rng, rows = random.Random(2), []
    for k in range(4000):
        mid = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", "c"])
        rows.append((mid, rng.randrange(40 * 3_600_000), k, rng.choice([None, "home", "home"]), rng.choice("01"), "v", "c", "r", 5))
    rows += [("edge", t, 5000 + n, None, "1", "v", "c", "r", 5) for n, t in enumerate((0, 3_600_000, 3_600_000, 7_199_999, 7_200_000, 90_000_000))]  # on the bounds of slices, with a gap
    return spark.createDataFrame(rows, SCHEMA).withColumn("event_time", F.timestamp_millis("ts")).repartition(3).persist()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def share(df):
    """Part of the rows in the fullest task."""
    rows = df.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("_next"), F.max("_next_entry"))
    n = [r.n for r in rows.collect()]
    return max(n) / sum(n)


@pytest.mark.parametrize("slice", ["1 hour", "7 minutes", "3 days"])
def test_sliced_equals_window(pages, slice):
    for within in ("10 seconds", "20 minutes", "6 hours"):
        assert rows_of(visits.user_jumps(pages, within, slice=slice)) == rows_of(visits.user_jumps(pages, within))
    sums = lambda s: rows_of(stats.sum_visitors(stats.visitor_rows(pages, "20 minutes", slice=s), "1 hour", None))
    assert sums(slice) == sums(None)


def test_flag_by_first_equals_window(pages):
    assert rows_of(logs.repair_is_new_by_first(pages)) == rows_of(logs.repair_is_new(pages).select(pages.columns))
    none = pages.withColumn("is_new", F.lit("0"))
    assert rows_of(logs.repair_is_new_by_first(none)) == rows_of(none)


def test_a_hot_device_is_spread(spark, pages):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert share(visits.followed(pages)) > 0.85
        assert share(visits.followed(pages, "30 minutes")) < 0.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = logs.repair_is_new_by_first(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


def test_time_of_computation(spark):
    from datetime import datetime

    words = spark.createDataFrame([("a", datetime(2024, 1, 1))], "keyword string, rt timestamp")
    out = stats.keyword_stats(words, delay=None, as_of=datetime(2024, 5, 6))
    assert out.columns[-1] == "ts" and len(out.columns) == 6 and out.first().ts == 1_714_953_600_000
