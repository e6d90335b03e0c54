"""The repaired flag as a stream of batches: as the processor of log_stream(), whatever the batches, and no Python per device."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from brookmart.jobs.queries import QUERIES, SQL
from brookmart.operators import logs
from brookmart.sources.versions import DimStore
from brookmart.streaming import state, streams
from tests.oracle import connect, rows
from tests.test_streaming import batch, files, page, run, source

DATA = "/root/testdata/sf0.001"


def flags(spark, path, at, keep=None):
    q = streams.flag_stream(source(spark, path).select("mid", "seq", "is_new", "ts"), str(at / "out"), str(at / "c"), keep, buckets=4, available=True)
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(str(at / "out/rows")).select("mid", "seq", "is_new", "ts").collect()))


def test_flags_over_batches_and_again(spark, tmp_path):
    first = [page("a", 5, 2, is_new="1"), page("a", 9, 1, is_new="1"), page("b", 1, 3), page("hot", 1, 6, is_new="1"), page("n", 1, 7, is_new=None)]
    none = [page("b", 2, 8), page("n", 2, 9)]
    late = [page("a", 1, 4, is_new="1"), page("b", 2, 5, is_new="1"), *(page("hot", k, k, is_new="1") for k in range(100, 400))]
    path = files(tmp_path / "in", [first, none, late, [page("hot", 9, 0, is_new="1"), page("n", 3, 10, is_new="1")]])
    got = flags(spark, path, tmp_path)
    assert {m: s for m, s, new, _ in got if new == "1"} == {"a": 1, "b": 5, "hot": 6, "n": 10} and len(got) == 311
    assert got == sorted(tuple(r[c] for c in ("mid", "seq", "is_new", "ts")) for r in run(state.repair_is_new(source(spark, path).select("mid", "seq", "is_new", "ts")), "by_processor", tmp_path / "c1"))
    for noted in ("3", ".3.crc"):  # stopped after the last batch was written, before it was noted
        os.remove(tmp_path / "c/commits" / noted)
    assert flags(spark, path, tmp_path) == got
    assert DimStore(spark, str(tmp_path / "out/first"), "mid", 4).published()[-1] == 3


def test_a_stop_between_store_and_rows(spark, tmp_path):
    path = files(tmp_path / "in", [[page("a", 5, 2, is_new="1"), page("a", 9, 1, is_new="1")], [page("a", 1, 3, is_new="1"), page("b", 1, 4, is_new="1")]])

    def down(_):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        flags(spark, path, tmp_path, down)
    assert flags(spark, path, tmp_path) == [("a", 1, "1", 9), ("a", 2, "0", 5), ("a", 3, "0", 1), ("b", 4, "1", 1)]


def test_flags_equal_the_batch_form(spark, tmp_path):
    path = files(tmp_path / "in", [[page(f"m{k % 7}", k, k, is_new=str(k % 2)) for k in range(n, n + 50)] for n in (0, 50, 100)])
    want = logs.repair_is_new(batch(spark, path), order=("seq",)).select("mid", "seq", "is_new", "ts").where(F.col("seq") >= 0)
    assert flags(spark, path, tmp_path) == sorted(map(tuple, want.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["win1_flags_of_topic", "agg1_visitor_stream"])
def test_queries_call_no_python_for_a_device(spark, monkeypatch, name):
    def called(*_):
        raise AssertionError("the flag goes device by device through Python")

    monkeypatch.setattr(state, "repair_is_new", called)
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(connect(DATA).execute(SQL[name]).df())
