"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brookmart.llm import decontamination, licenses, media, pieces, quality, simhash, suffixes, toxicity, urls, warc

LONG = "the quick brown fox jumps over the lazy dog near licence 42 km from Paris. " * 4000
ROWS = [(1, None), (2, ""), (3, LONG), (4, "short text"), (4, "short text"), (None, "no id"), (5, " \n\t "), (6, "ünïcödé ▁ 日本 😀 mit"), (2**60 + 1, "short text")]
EXTRA = ["payload", "label", "score", "id", "fp", "words", "n", "digest", "data", "start", "hits", "spans", "component", "text_class"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in EXTRA:
        df = df.withColumn(c, F.lit(c))
    return df.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(9)] + [(1, None, None), (None, 1, True)], "doc_id long, quality int, t boolean").select("doc_id", "quality", F.col("t").cast("int").alias("toxic"))


BENCH = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota"), (2, None), (3, ""), (None, "a b c")]


def per_document(docs, labels, spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return {
        "licenses": lambda d: licenses.scan(d),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "pieces": lambda d: pieces.digests(d),
        "encode": lambda d: pieces.decode(pieces.encode(d)),
        "media": lambda d: media.describe(media.store(d, "doc_id"), "doc_id"),
        "simhash": lambda d: simhash.grouped(d),
        "warc": lambda d: warc.read_bundles(warc.write_bundles(d, "doc_id", "text", "source")),
    }, bench


@pytest.mark.parametrize("name", ["licenses", "quality", "toxicity", "pieces", "encode", "media", "simhash", "warc"])
def test_one_row_per_document(spark, docs, labels, name):
    f = per_document(docs, labels, spark)[0][name]
    rows = f(docs).collect()
    key = "page_id" if name == "warc" else "doc_id"
    assert sorted((r[key] for r in rows), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert f(docs.limit(0)).collect() == []


def test_equal_rows_have_equal_results(spark, docs, labels):
    for name in ("pieces", "media", "toxicity", "licenses"):
        rows = [tuple(r)[1:] for r in per_document(docs, labels, spark)[0][name](docs.where("doc_id in (4, 1152921504606846977)")).collect()]
        assert len({str(r) for r in rows}) == 1


def test_simhash_edges(spark, docs):
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.grouped(docs).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (5, zero, 1)} <= got
    assert {r[2] for r in got if r[0] in (4, 2**60 + 1)} == {4}


def test_suffix_edges(spark, docs):
    got = suffixes.covered(docs).collect()
    assert len(got) == len(set(ROWS)) - 0
    by = {(r.id, r.n_bytes): [tuple(s) for s in r.spans] for r in got}
    period = len("the quick brown fox jumps over the lazy dog near licence 42 km from Paris. ")
    assert by[(3, len(LONG))] == [(period, len(LONG))]
    assert by[(1, 0)] == by[(2, 0)] == [] and by[(None, 5)] == []
    assert suffixes.covered(docs.limit(0)).collect() == []


def test_stages_keep_columns_and_odd_rows(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for stage in (quality.keep_good, simhash.keep_first, suffixes.without_repeats, decontamination.keep_clean):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.collect()
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    ids = [r.doc_id for r in simhash.keep_first(spark, docs, str(tmp_path)).collect()]
    assert ids.count(4) == 2 and 2**60 + 1 not in ids and None in ids and 2 not in ids
    cut = {r.doc_id: r for r in suffixes.without_repeats(spark, docs, str(tmp_path)).collect()}
    assert len(cut[3].text) == cut[3].n_chars == 75 and cut[1].text is None


def test_empty_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, bench).collect() == []


def test_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.score, 9) for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.7}
    rude = docs.select("doc_id", F.lit("you idiot, you scum").alias("text"))
    assert all(r.score > 0.5 for r in toxicity.score(rude, toxicity.train(docs, none, words=("Idiot", "scum"))).collect())
    assert len({r.score for df in (docs, rude) for r in toxicity.score(df, toxicity.train(docs, none)).collect()}) == 1


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/x"), (5, "http://www.example.com/en/x"), (6, "ftp://a.NET/es/?q"), (7, "x://anet/es/"), (8, "https://b.com?x"), (9, "http://www.example.com"), (None, "http://é.net/fr/" + "a" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert {k: (r.host, r.rule) for k, r in got.items()} == {
        1: ("", None), 2: ("", None), 3: ("", None), 4: ("example.com", "example.com/en/"), 5: ("www.example.com", "www.example.com/en/"), 6: ("a.net", "net/es/"),
        7: ("anet", None), 8: ("b.com", None), 9: ("www.example.com", None), None: ("é.net", "net/fr/")}
    assert [got[k].verdict for k in (4, 5, 6, None)] == ["block", "allow", "block", "block"]
    assert urls.judge(df.limit(0)).collect() == []
    judged = urls.judge(spark.createDataFrame([(1, "https://m.poker-slots.example.org/en/4"), (2, "https://blog.thering.example.org/en/4")], "page_id long, url string"))
    assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "allow"}


def test_warc_of_null_and_repeated_ids(spark):
    long = "p" * 150
    rows = [(1, long), (1, long), (2, long), (None, long), (None, "q" * 150), (None, "q" * 150), (3, "short"), (3, "short"), (None, "short"), (4, None), (5, "r" * 99), (6, "r" * 99)]
    df = spark.createDataFrame([(i, "u", h, h) for i, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    for same in (df, df.dropDuplicates()):  # with and without repeated rows
        back = warc.read_bundles(warc.write_bundles(same)).collect()
        assert sorted((str(r.page_id), r.stored_bytes) for r in back) == sorted((str(r.page_id), len(r.html or "")) for r in same.collect())
        kinds = sorted((r.stored_digest[:4], r.record_type, str(r.page_id), str(r.refers_to)) for r in back if r.stored_bytes >= 100)
        p, q = (k[0] for k in (kinds[0], kinds[-1]))
        assert len({p, q}) == 2 and [k[1] for k in kinds].count("response") == 2
        assert all(k[3] in ("1", "None") for k in kinds) and ("response", "1", "None") in [k[1:] for k in kinds]
        assert ("revisit", "None", "1") in [k[1:] for k in kinds]
        assert all(r.record_type == "response" for r in back if r.stored_bytes < 100)
    bundles = warc.write_bundles(df.withColumn("day", F.lit("2024-05-06T07:08:09Z")), date="day").collect()
    assert all(f["WARC-Date"] == "2024-05-06T07:08:09Z" for b in bundles for _, f, _ in warc.Bundle(bytes(b.archive)))


def test_null_ids_link_their_neighbours(spark, monkeypatch):
    """1 - null - 2: the fingerprint of the row without an id is within reach of both."""
    fps = {1: 0, None: 0b11, 2: 0b1111, 3: 0xFF00}
    made = spark.createDataFrame([(i, f, f"{f:016x}") for i, f in fps.items()], "doc_id long, fp long, fingerprint string")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: made)
    got = {r.doc_id: r.component_id for r in simhash.grouped(made).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}
