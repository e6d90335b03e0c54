"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and reads it again as the next stage's documents. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brookmart.llm import common, decontamination, pieces, quality, simhash, suffixes

STAGES = [
    ("quality classifier", quality.keep_good),
    ("SimHash near-dedup", simhash.keep_first),
    ("suffix-array dedup", suffixes.without_repeats),
    ("benchmark decontamination", decontamination.keep_clean),
    ("SentencePiece encoding and decoding", pieces.tokenized),
]

#: None: a trained model, similarity over all shingle sets and byte windows are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
