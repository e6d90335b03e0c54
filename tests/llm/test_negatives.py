"""Hard negatives against all inner products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmart.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in rows
            if None not in (r.vec_id, r.label, r.embedding) and all(x is not None and np.isfinite(x) for x in r.embedding)]
    inner = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for k, (anchor, label, v) in enumerate(kept):
        if anchor % 50:
            continue
        scored = sorted((-inner(v, w), i, n) for n, (i, _, w) in enumerate(kept) if n != k)
        for p, i, _ in [s for s in scored if kept[s[2]][1] == label][:5]:
            fits = [(-s, j) for s, j, n in scored if kept[n][1] != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(anchor, i, rank, j, -p, s) for rank, (s, j) in enumerate(fits[:3], 1)]
    return sorted(out)


def found(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, negatives.op11_hard_negatives(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize(("spread", "bits"), [(0.0, 11), (2.0, 3)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, spread, bits):
    """Unit and very unequal norms; whole buckets, and small ones with several passes."""
    monkeypatch.setattr(negatives, "BUCKET", bits)
    if bits < 11:
        monkeypatch.setattr(negatives, "BLOCK", 2)
        monkeypatch.setattr(negatives, "PASS_BYTES", 1)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 8))
    rows = [(k, [float(x) for x in (base[k % 12] + rng.normal(size=8) * 0.4) * np.exp(spread * rng.normal())], int(k % 12 % 10)) for k in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = found(spark, df, tmp_path)
    assert got and got == brute(df.collect())


def test_ties_copies_and_rows_that_take_no_part(spark, tmp_path):
    near, far = [1.0, 0.0, 0.5], [0.7, 0.0, 0.3]
    rows = [(50, near, 1), (100, near, 1), (3, near, 1), (4, far, 2), (5, far, 2), (6, far, 3), (8, far, 2), (9, near, 2), (10, None, 1), (11, near, None), (None, near, 1),
            (12, [1.0, None, 1.0], 1), (13, [float("nan"), 1.0, 1.0], 2), (15, [float("inf"), 1.0, 1.0], 2), (16, [0.9], 2), (17, [], 2), (18, [-1.0, 0.0, -1.0], 1)]
    df = spark.createDataFrame(rows + [(4, far, 2), (200, [-1.0, 0.0, 0.0], 5), (201, [1.0, 0.0, 0.0], 5)], SCHEMA)
    for c in ("id", "row", "place", "tree", "below", "score", "rank"):
        df = df.withColumn(c, F.lit(c))
    got = found(spark, df, tmp_path)
    assert got == brute(df.collect())
    assert {g[0] for g in got} == {50, 100}
    assert not [g for g in got if g[0] == 200]  # its only positive has a negative score


def test_large_components_are_exact(spark, tmp_path):
    rows = [(50, [60000.123, 65535.9], 1), (51, [60000.5, 65535.0], 1), (53, [50000.25, 60000.75], 2), (54, [50000.25, 60000.74], 2), (55, [70000.0, 1.0], 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(spark, df, tmp_path) == brute([r for r in df.collect() if r.vec_id != 55])


def test_empty(spark, tmp_path):
    assert found(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_no_anchor(spark, tmp_path):
    assert found(spark, spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA), tmp_path) == []
