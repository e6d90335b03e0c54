"""Batches in a database table: each once, wherever an attempt stopped."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from brookmart.sources import io, ledger
from brookmart.streaming import streams

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def rows(spark, url, table):
    return sorted(map(tuple, io.read_table(spark, url, f"select * from {table}", driver=DRIVER).collect()))


def test_a_batch_that_fails_half_way_is_there_once(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(0, 400, 1, 4).select("id", F.concat(F.lit("n"), "id").alias("name"))
    assert ledger.write_once(df.where("id < 100"), url, "STATS", "q", 0, driver=DRIVER)
    part = F.spark_partition_id()
    broken = df.withColumn("name", F.when((part == 3) & (F.col("id") == 399), F.raise_error(F.lit("down"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="down"):
        ledger.write_once(broken.where("id >= 100"), url, "STATS", "q", 1, driver=DRIVER)
    stage = f"STATS_stage_{ledger.hash_of('q')}"
    assert 0 < io.read_table(spark, url, f"select * from {stage}", driver=DRIVER).count() < 300  # partitions of the failed attempt
    assert len(rows(spark, url, "STATS")) == 100
    assert ledger.write_once(df.where("id >= 100"), url, "STATS", "q", 1, driver=DRIVER)
    assert not ledger.write_once(df, url, "STATS", "q", 1, driver=DRIVER)
    assert rows(spark, url, "STATS") == sorted((k, f"n{k}") for k in range(400))
    assert ledger.write_once(df.limit(1), url, "STATS", "another", 1, driver=DRIVER)  # the ledger is by query


def test_the_move_is_one_transaction(spark, tmp_path, monkeypatch):
    """A crash after the rows were moved and before the note leaves neither."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(5).select("id")
    real = ledger._run

    def run(c, sql):
        real(c, sql)
        if sql.startswith("INSERT"):
            raise OSError("down")

    with monkeypatch.context() as m:
        m.setattr(ledger, "_run", run)
        with pytest.raises(OSError):
            ledger.write_once(df, url, "STATS", "q", 0, driver=DRIVER)
    assert rows(spark, url, "STATS") == [] and rows(spark, url, "STATS_ledger") == []
    assert ledger.write_once(df, url, "STATS", "q", 0, driver=DRIVER) and len(rows(spark, url, "STATS")) == 5


def test_stream_to_a_table(spark, tmp_path):
    """The checkpoint forgets its last commit, so the batch comes again; its rows don't."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    (tmp_path / "in").mkdir()

    def go():
        df = spark.readStream.schema("stt string, n long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = streams.stats_table_stream(df, lambda b: b.withColumn("twice", F.col("n") * 2), url, "STATS", "sums", str(tmp_path / "c"), True, driver=DRIVER)
        q.awaitTermination(120)
        assert q.exception() is None

    for n in range(2):
        (tmp_path / f"in/{n}.json").write_text(json.dumps({"stt": "s", "n": n}) + "\n")
    go()
    for f in ("1", ".1.crc"):
        os.remove(tmp_path / "c/commits" / f)
    (tmp_path / "in/2.json").write_text(json.dumps({"stt": "s", "n": 2}) + "\n")
    go()
    assert sorted(r[1:] for r in rows(spark, url, "STATS")) == [(0, 0), (1, 2), (2, 4)]
