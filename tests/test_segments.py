"""Topics with offsets: ranges, restarts, and the streams that take their sequence from them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brookmart.operators import logs, visits
from brookmart.sources import io
from brookmart.sources.segments import read_segments, write_segments
from brookmart.streaming import state, streams

LINE = '{{"common":{{"mid":"{mid}","is_new":"{new}","vc":"v","ch":"c","ar":"r"}},"page":{{"page_id":"p","last_page_id":{last},"during_time":5}},"ts":{ts}}}'


def write(spark, path, n, rows, **more):
    df = spark.createDataFrame([(m, t, LINE.format(mid=m, new=new, last='"home"' if last else "null", ts=t)) for m, t, new, last in rows], "mid string, ts long, value string")
    return write_segments(df.withColumn("timestamp", F.timestamp_millis("ts")), path, n, "mid", **({"partitions": 3} | more))


def batch(n, size=40):
    return [(f"m{k % 5}", 1000 + (n * size + k) * 400, "1" if k % 3 else "0", k % 4) for k in range(size)]


def rows_of(df):
    return sorted((r.partition, r.offset, r.value) for r in df.collect())


def test_offsets_have_no_gaps(spark, tmp_path):
    path = str(tmp_path / "topic")
    assert write(spark, path, 0, batch(0), most=7) and write(spark, path, 1, batch(1))
    assert not write(spark, path, 1, batch(1))
    every = read_segments(spark, path)
    got = rows_of(every)
    assert len(got) == 80
    for p in {g[0] for g in got}:
        assert [g[1] for g in got if g[0] == p] == list(range(sum(g[0] == p for g in got)))
    keys = every.select("partition", F.get_json_object("value", "$.common.mid").alias("mid")).distinct()
    assert keys.count() == keys.select("mid").distinct().count() == 5  # a key has one partition
    ordered = every.select("partition", "offset", F.unix_millis("timestamp").alias("t"), F.get_json_object("value", "$.common.mid").alias("m")).orderBy("m", "offset").collect()
    assert all(a.m != b.m or a.t <= b.t for a, b in zip(ordered, ordered[1:]))  # noqa: B905
    first = got[0][0]
    assert rows_of(read_segments(spark, path, {first: 5})) == [g for g in got if g[0] != first or g[1] >= 5]
    assert rows_of(io.read_topic(spark, "t", path=path, segments=True)) == got
    with pytest.raises(ValueError, match="latest"):
        read_segments(spark, path, "latest")


def test_a_write_that_fails_is_not_seen(spark, tmp_path, monkeypatch):
    from brookmart.sources.versions import Files

    path = str(tmp_path / "topic")
    write(spark, path, 0, batch(0))
    with monkeypatch.context() as m:
        m.setattr(Files, "put", lambda *_: (_ for _ in ()).throw(OSError("down")))
        with pytest.raises(OSError):
            write(spark, path, 1, batch(1))
    assert read_segments(spark, path).count() == 40
    assert write(spark, path, 1, batch(1)) and read_segments(spark, path).count() == 80


def run(df, out, checkpoint):
    """Takes what is there, trigger by trigger; numbers of rows of each."""
    sizes = []

    def keep(b, n):
        b.write.mode("overwrite").parquet(f"{out}/batch={n}")

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        q.processAllAvailable()
        sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
        q.awaitTermination(60)
    return sizes


def test_stream_by_ranges_and_restarts(spark, tmp_path):
    path, out, at = str(tmp_path / "topic"), str(tmp_path / "out"), str(tmp_path / "c")
    write(spark, path, 0, batch(0))
    read = lambda: read_segments(spark, path, "earliest", True, limit=6)
    sizes = run(read(), out, at)
    assert max(sizes) <= 6 * 3 and len(sizes) > 1 and sum(sizes) == 40
    write(spark, path, 1, batch(1))
    write(spark, path, 2, batch(2, 7))
    sizes = run(read(), out, at)
    assert sum(sizes) == 47 and max(sizes) <= 6 * 3
    assert run(read(), out, at) == []
    assert rows_of(spark.read.parquet(out)) == rows_of(read_segments(spark, path))  # nothing lost, nothing twice


def test_streams_start_at_given_offsets(spark, tmp_path):
    path = str(tmp_path / "topic")
    write(spark, path, 0, batch(0))
    got = rows_of(read_segments(spark, path))
    first = got[0][0]
    run(read_segments(spark, path, {first: 3}, True), str(tmp_path / "out"), str(tmp_path / "c"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == [g for g in got if g[0] != first or g[1] >= 3]


def test_flags_and_bounces_take_their_sequence_from_offsets(spark, tmp_path):
    path = str(tmp_path / "topic")
    for n in range(3):
        write(spark, path, n, batch(n))
    lines = lambda stream: read_segments(spark, path, "earliest", stream).select(F.col("offset").alias("seq"), "value")
    good, _ = streams.log_stream(lines(True))
    run(good.select("seq", "mid", "is_new", "ts"), str(tmp_path / "flags"), str(tmp_path / "c1"))
    parsed, _ = logs.parse_log(lines(False))
    flat = parsed.select("seq", "common.*", "page.last_page_id", "ts", "event_time")
    want = logs.repair_is_new(flat, order=("seq",)).select("seq", "mid", "is_new", "ts")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "flags")).drop("batch").collect())) == sorted(map(tuple, want.collect()))
    live, _ = logs.parse_log(lines(True))
    jumps = state.user_jumps(live.select("seq", "common.*", "page.last_page_id", "ts", "event_time"), 3000)
    run(jumps.select("mid", "seq", "ts"), str(tmp_path / "jumps"), str(tmp_path / "c2"))
    closed = max(r.ts for r in flat.collect()) - 2000 - 3000
    want = visits.user_jumps(flat, "3 seconds").where(F.col("ts") < closed).select("mid", "seq", "ts")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "jumps")).drop("batch").where(F.col("ts") < closed).collect())) == sorted(map(tuple, want.collect()))
