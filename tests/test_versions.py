"""Versioned tables: what an upsert touches, what a reader sees, what a crash leaves."""

from __future__ import annotations

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brookmart.operators import changes, reports, wide
from brookmart.sources.versions import DimStore, Rollup
from brookmart.streaming import streams

SCHEMA = "seq long, id string, x string, y string"


def folders(path, version):
    return sorted(p.name for p in Path(path, f"data/v={version}").glob("bucket=*"))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_only_changed_buckets_are_written(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), buckets=16)
    assert store.dim() is None
    first = spark.createDataFrame([(k, f"k{k}", "a", None) for k in range(200)], SCHEMA)
    assert store.upsert(first, 1, keep=None) and len(folders(tmp_path, 1)) == 16
    second = spark.createDataFrame([(300, "k7", "b", "new"), (301, "k7", None, "newer"), (302, "k900", "c", None), (303, None, "lost", None)], SCHEMA)
    assert store.upsert(second, 2, keep=None)
    hit = {r[0] for r in second.where("id is not null").select(store.bucket()).distinct().collect()}
    assert folders(tmp_path, 2) == sorted(f"bucket={b}" for b in hit)
    files = [f for f in Path(tmp_path, "data/v=2").rglob("*.parquet")]
    assert len(files) == len(hit) <= 2
    want = changes.latest_by_key(first.unionByName(second.where("id is not null")))
    assert rows_of(store.dim()) == rows_of(want) and ("k7", "b", "newer") in rows_of(store.dim())
    assert rows_of(store.dim(1)) == rows_of(first.select("id", "x", "y"))
    only = store.dim(keys=["k7"])
    assert ("k7", "b", "newer") in rows_of(only) and only.count() < 40
    assert all("bucket=" in f for f in only.inputFiles()) and len({f.rsplit("/", 2)[1] for f in only.inputFiles()}) == 1


def test_a_replay_changes_nothing(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), buckets=4)
    a = spark.createDataFrame([(1, "k", "a", None)], SCHEMA)
    store.upsert(a, 0)
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    assert not store.upsert(a.withColumn("x", F.lit("other")), 0)
    assert before == {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}


def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = DimStore(spark, str(tmp_path), buckets=4)
    store.upsert(spark.createDataFrame([(1, "k", "a", None), (1, "m", "a", None)], SCHEMA), 0)
    b = spark.createDataFrame([(2, "k", "b", None)], SCHEMA)

    def broken(*_):
        raise OSError("down")

    with monkeypatch.context() as m:
        m.setattr(store.files, "put", broken)
        with pytest.raises(OSError):
            store.upsert(b, 1)
    assert folders(tmp_path, 1) and store.newest() == 0  # files are there, the version isn't
    assert rows_of(DimStore(spark, str(tmp_path), buckets=4).dim()) == [("k", "a", None), ("m", "a", None)]
    assert store.upsert(b, 1)
    assert rows_of(store.dim()) == [("k", "b", None), ("m", "a", None)]


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), buckets=8)
    for n in range(6):
        store.upsert(spark.createDataFrame([(n, f"k{n % 3}", f"v{n}", None), (n, "same", "x", None)][: 1 + (n == 0)], SCHEMA), n, keep=2)
    assert store.published() == [4, 5]
    assert rows_of(store.dim(4)) == [("k0", "v3", None), ("k1", "v4", None), ("k2", "v2", None), ("same", "x", None)]
    assert rows_of(store.dim(5))[2] == ("k2", "v5", None)
    named = {(v, b) for k in (4, 5) for b, v in store.manifest(k)["parts"].items()}
    there = {(int(p.parent.name[2:]), p.name[7:]) for p in tmp_path.glob("data/v=*/bucket=*")}
    assert there == named


def test_columns_come_and_stay(spark, tmp_path):
    store = DimStore(spark, str(tmp_path), buckets=2)
    store.upsert(spark.createDataFrame([(1, "a", "1"), (1, "b", "1")], "seq long, id string, x string"), 0)
    store.upsert(spark.createDataFrame([(2, "a", 5)], "seq long, id string, z int"), 1, null_overwrites=True)
    assert store.dim().columns == ["id", "x", "z"]
    assert rows_of(store.dim().where("id = 'a'")) == [("a", "1", 5)]
    assert [r.z for r in store.dim().where("id = 'b'").collect()] == [None]


def put(path, n, rows):
    path.mkdir(exist_ok=True)
    (path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def test_a_stream_sees_what_was_published_before_each_batch(spark, tmp_path, monkeypatch):
    """Version v, then v+1 between two batches; then a writer that dies half-way."""
    store, out = DimStore(spark, str(tmp_path / "dim"), buckets=4), str(tmp_path / "out")
    dim = "seq long, id long, sku_name string, category3_id long, spu_id long, tm_id long"
    store.upsert(spark.createDataFrame([(1, 7, "old", 1, 1, 1), (1, 8, "eight", 1, 1, 1)], dim), 0)

    def go(n):
        put(tmp_path / "in", n, [{"stt": f"2024-01-0{n} 00:00:00", "sku_id": 7, "n": n}, {"stt": f"2024-01-0{n} 00:00:00", "sku_id": 8, "n": n}])
        df = spark.readStream.schema("stt string, sku_id long, n long").json(str(tmp_path / "in"))
        q = streams.stats_stream(df, lambda batch: wide.join_sku(batch, store.dim()), out, str(tmp_path / "c"), available=True)
        q.awaitTermination(120)
        assert q.exception() is None

    go(1)
    store.upsert(spark.createDataFrame([(2, 7, "new", None, None, None)], dim), 1)
    go(2)
    monkeypatch.setattr(store.files, "put", lambda *_: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(OSError):
        store.upsert(spark.createDataFrame([(3, 7, "never", None, None, None)], dim), 2)
    go(3)
    got = spark.read.parquet(out).select("n", "sku_id", "sku_name", "tm_id")
    assert rows_of(got) == [(1, 7, "old", 1), (1, 8, "eight", 1), (2, 7, "new", 1), (2, 8, "eight", 1), (3, 7, "new", 1), (3, 8, "eight", 1)]


def test_rollup_merges_days(spark, tmp_path):
    roll = Rollup(spark, str(tmp_path), ["stt", "edt", "k"], {"n": "sum", "ts": "min"})
    row = lambda day, hour, k, n, ts: (f"2024-01-0{day} {hour:02}:00:00", f"2024-01-0{day} {hour:02}:00:10", k, n, ts)
    schema = "stt string, edt string, k string, n long, ts long"
    roll.add(spark.createDataFrame([row(1, 1, "a", 2, 50), row(1, 1, "a", 3, 40), row(2, 1, "a", 1, 9)], schema), 0)
    kept = {p: p.stat().st_mtime_ns for p in tmp_path.glob("data/v=0/dt=2024-01-02/*")}
    late = spark.createDataFrame([row(1, 1, "a", 10, 60), row(1, 2, "b", 1, 1)], schema)  # late windows of a day that is stored
    assert roll.add(late, 1) and not roll.add(late, 1)
    assert rows_of(roll.read().select("stt", "k", "n", "ts")) == [("2024-01-01 01:00:00", "a", 15, 40), ("2024-01-01 02:00:00", "b", 1, 1), ("2024-01-02 01:00:00", "a", 1, 9)]
    assert [p.name for p in tmp_path.glob("data/v=1/dt=*")] == ["dt=2024-01-01"] and kept == {p: p.stat().st_mtime_ns for p in kept}
    day = reports.of_day(roll.read(), "2024-01-02")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0] and day.count() == 1
    assert all("dt=2024-01-02" in f for f in roll.read(parts=["2024-01-02"]).inputFiles())
