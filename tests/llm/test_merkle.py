"""The manifest against trees built one after the other."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from brookmart.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts) -> str:
    return hashlib.sha256(b"".join(p.encode() if isinstance(p, str) else p for p in parts)).hexdigest()


def image(v) -> bytes:
    return b"-" if v is None else b"%d:%s" % (len(raw := str(v).encode()), raw)


def tree(nodes):
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, k in zip(ways, places, strict=True):
            way.append((nodes[k ^ 1] if k ^ 1 < len(nodes) else None, k % 2))
        nodes, places = [sha(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)], [k // 2 for k in places]
    return nodes[0], ways


def brute(rows):
    groups = {}
    for r in rows:
        leaf, bad = (sha(*map(image, (r.doc_id, r.source, r.lang, n, r.text))) for n in (r.n_chars, None if r.n_chars is None else r.n_chars + 1))
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        groups.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, leaf), bad if hit else leaf))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: tree([g[0][2] for g in sorted(groups[n])]) for n in names}
    root, up = tree([trees[n][0] for n in names]) if names else (None, [])
    out = []
    for k, n in enumerate(names):
        for ((known, doc, leaf), folded), way in zip(sorted(groups[n]), trees[n][1], strict=True):
            for other, right in [*way, *up[k]]:
                folded = sha(folded) if other is None else sha(other, folded) if right else sha(folded, other)
            out.append((doc if known else None, leaf, trees[n][0], root, sha(*(o for o, _ in [*way, *up[k]] if o)), folded, folded == root))
    return sorted(out, key=str)


def found(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 64, 65, 1), (130, 63, 7), (4100,)])
def test_equals_brute_force(spark, tmp_path, sizes):
    rows = [(n * 10_000 + (k * 7919) % size, f"t{k}" if k % 5 else None, f"l{n}" if n else None, None if k % 4 == 0 else "s", None if k % 3 == 0 else k) for n, size in enumerate(sizes) for k in range(size)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(spark, df, tmp_path) == brute(df.collect())


def test_repeats_nulls_and_clashing_columns(spark, tmp_path):
    rows = [(1, "a", "x", "s", 1)] * 70 + [(None, None, "x", None, None)] * 3 + [(1, "b", "x", "s", 1), (7, "ü" * 100_000, "é", "", 5), (2, "", "", "s", 0), (3, "", None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "leaf", "row", "place", "size", "key", "steps", "node"):
        df = df.withColumn(c, F.lit(c))
    got = found(spark, df, tmp_path)
    assert got == brute(df.collect()) and len(got) == len(rows)


def test_empty(spark, tmp_path):
    assert found(spark, spark.createDataFrame([], SCHEMA), tmp_path) == []


def test_a_changed_row_does_not_verify(spark):
    docs = spark.createDataFrame([(k, str(k), "l", "s", k) for k in range(200)], SCHEMA)
    rows = merkle.leaves(docs, "doc_id", "lang", merkle.FIELDS, {"text": F.lit("forged")}, F.col("doc_id").isin(3, 199))
    made = merkle.manifest(rows)
    ok = made.select("key", (merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")) == F.col("root")).alias("ok"))
    assert sorted(r.key for r in ok.where("not ok").collect()) == [3, 199]


def test_bytes_that_are_no_utf8(spark, tmp_path):
    df = spark.createDataFrame([(1, bytearray(b"\xff\xfea"), "l", "s", 1)], "doc_id long, b binary, lang string, source string, n_chars long")
    df = df.select("doc_id", F.expr("cast(b as string)").alias("text"), "lang", "source", "n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).first()
    assert got.leaf == sha(image(1), image("s"), image("l"), image(1), b"3:\xff\xfea")
