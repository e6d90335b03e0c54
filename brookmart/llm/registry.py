"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bytepairs, decontamination, licenses, media, merkle, negatives, pieces, quality, simhash, suffixes, toxicity, urls, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_url_filters": urls.op4_url_filters,
    "op5_sentencepiece": pieces.op5_sentencepiece,
    "op6_warc_bundles": warc.op6_warc_bundles,
    "op7_media_columns": media.op7_media_columns,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_byte_bpe": bytepairs.op13_byte_bpe,
}

SQL = {**warc.SQL, **licenses.SQL}
