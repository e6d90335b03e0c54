"""Adding to a rollup deals its rows out once."""

from __future__ import annotations

from pyspark.sql import functions as F

from brookmart.sources.versions import Rollup


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_add_deals_rows_out_once(spark, tmp_path):
    day = F.date_format(F.timestamp_seconds(F.col("id") % 3 * 86400), "yyyy-MM-dd HH:mm:ss")
    rows = spark.range(60_000).select(day.alias("stt"), F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n"))
    at = shuffled(spark)
    rows.withColumn("dt", F.to_date("stt")).repartition(3, "dt").write.parquet(str(tmp_path / "once"))
    once, at = shuffled(spark) - at, shuffled(spark)
    for files in (1, 2):
        roll = Rollup(spark, str(tmp_path / f"roll-{files}"), ["stt", "k"], {"n": "sum"})
        at = shuffled(spark)
        roll.add(rows, 0, files_per_day=files)
        assert shuffled(spark) - at < 1.5 * once
        roll.add(rows, 1, files_per_day=files)
        got = roll.read().agg(F.count("k"), F.sum("n"), F.countDistinct("stt", "k")).first()
        assert tuple(got) == (60_000, 2 * rows.agg(F.sum("n")).first()[0], 60_000)
