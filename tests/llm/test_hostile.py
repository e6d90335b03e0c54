"""Bytes that aren't UTF-8, columns with the names that operators work with, and a session without any settings."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from brookmart.llm import bytepairs, decontamination, licenses, media, merkle, pieces, quality, simhash, suffixes, toxicity, urls, warc

BAD = ["ff", "61ff62c3", "c328206d6974206c6963656e7365", "20" * 40 + "e28228", "f0288cbc" * 60]
#: Every name that some operator uses for a column of its own.
NAMES = ("_cut_text", "_cut_id", "_quality_score", "cut_id", "cut_text", "cut_digest", "score", "payload", "id", "ids", "key", "tree", "row", "place", "data", "spans", "digest",
         "fingerprint", "fp", "component", "component_id", "n", "host", "path", "rule", "verdict", "labels", "label", "words", "gram", "item", "text_class", "out", "a", "b")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """All tables with broken texts beside sound ones; texts repeat, so that dedup stages have work."""
    at = tmp_path_factory.mktemp("hostile")
    sound = ["the quick brown fox jumps over the lazy dog near the old mill by the river " * 3 + str(k % 4) for k in range(12)] + ["you utter scum " * 3] * 4
    rows = [(k, t.encode()) for k, t in enumerate(sound)] + [(100 + k, bytes.fromhex(h)) for k, h in enumerate(BAD)] + [(200 + k, ("\n".join(sound[:2])).encode() + bytes.fromhex(h)) for k, h in enumerate(BAD)]
    docs = spark.createDataFrame([(k, bytearray(b)) for k, b in rows], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.col("text"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{at}/documents.parquet")
    spark.range(220).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), (F.col("id") % 3 == 0).cast("int").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id in (1, 100, 104, 201)").write.parquet(f"{at}/benchmark.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://"), "text").alias("url"), F.col("text").alias("html")).write.parquet(f"{at}/pages.parquet")
    return str(at)


QUERIES = {
    "op1": licenses.op1_license_scan, "op2": quality.op2_quality_classifier, "op3": decontamination.op3_benchmark_decontamination, "op4": urls.op4_url_filters,
    "op5": pieces.op5_sentencepiece, "op6": warc.op6_warc_bundles, "op7": media.op7_media_columns, "op8": toxicity.op8_toxicity, "op9": simhash.op9_simhash_near_dedup,
    "op10": suffixes.op10_suffix_dedup, "op12": merkle.op12_merkle_manifest, "op13": bytepairs.op13_byte_bpe}
STAGES = {"quality": quality.keep_good, "near": simhash.keep_first, "repeats": suffixes.without_repeats, "leaks": decontamination.keep_clean, "tokens": pieces.tokenized}


@pytest.mark.parametrize("name", QUERIES)
def test_queries_take_any_bytes(spark, folder, name):
    n = QUERIES[name](spark, folder).count()
    assert n == 26 if name != "op3" else n >= 1


@pytest.mark.parametrize("name", STAGES)
def test_stages_take_any_bytes_and_names(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for c in NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")))
    out = STAGES[name](spark, docs, folder)
    if name == "tokens":
        assert out.count() == 26
        return
    assert out.dtypes == docs.dtypes
    rows = out.collect() if name != "repeats" else out.drop("text", "source").collect()
    assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in NAMES)


def test_cut_texts_keep_their_bytes(spark, folder):
    out = suffixes.without_repeats(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    cut = {r.doc_id: bytes(r.raw) for r in out.select("doc_id", F.col("text").cast("binary").alias("raw")).collect()}
    for k, h in enumerate(BAD[:3]):
        assert cut[200 + k].endswith(bytes.fromhex(h)) and cut[100 + k] == bytes.fromhex(h)


def test_a_session_without_settings(tmp_path):
    """Scratch tables need no setting in a local session, whatever its configuration folder holds."""
    code = """
from pyspark.sql import SparkSession
from brookmart.llm import common, suffixes
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = spark.createDataFrame([(1, "abc" * 50)], "doc_id long, text string")
assert suffixes.covered(df).count() == 1 and common.scratch(spark, "x").rsplit("/", 1)[0] == common.scratch(spark, "y").rsplit("/", 1)[0]
"""
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
