"""Byte-level BPE against the library, and the window against merges over whole words."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brookmart.llm import bytepairs

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def own():
    return bytepairs.Encoder(bytepairs.load(bytepairs.default_path()))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bytepairs.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def ids(encoder, text):
    out = []
    encoder.encode(text, out)
    return out


def test_every_character(own, library):
    """Splitting, in a letter's, a digit's and a space's neighbourhood, for each character there is."""
    texts = [f"a{c}{c}b {c}1{c}\n{c}" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(texts), 50_000):
        part = texts[at : at + 50_000]
        assert all(ids(own, t) == e.ids for t, e in zip(part, library.encode_batch(part, add_special_tokens=False), strict=True))


@pytest.mark.parametrize("seed", range(12))
def test_long_words(own, library, seed):
    rng = random.Random(seed)
    letters = [chr(c) for c in (*range(97, 123), 0xC3, 0xC2, 0x4E2D, 0x6587)]
    words = [t for t in (r.decode("utf-8", "ignore") for r in own.bytes.values()) if t.isalpha()]
    text = "".join(rng.choice(words if seed % 2 else letters[: 2 + seed]) for _ in range(9000)) + " - " + rng.choice(["-", "=", "aA", "_"]) * 9000
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_enough(own):
    """What a prefix of a word has fixed stays, whatever follows; the window never holds more than its bound."""
    rng = random.Random(3)
    for _ in range(60):
        raw = "".join(rng.choice("abcdeint-=") for _ in range(900)).encode() if rng.random() < 0.7 else b"-" * 900
        whole, cut = own.merged(raw), rng.randint(own.lookahead + 1, 890)
        part, end = own.merged(raw[:cut]), 0
        for a, b in zip(part, whole):  # noqa: B905
            end += len(own.bytes[a])
            if end > cut - own.lookahead:
                break
            assert a == b


def test_pieces_of_any_size(own, monkeypatch):
    monkeypatch.setattr(bytepairs, "STEP", 50)
    raw = ("antidisestablishment" * 200 + "-" * 700).encode()
    for n in (1, 7, 1000):
        assert list(own.stream(raw[k : k + n] for k in range(0, len(raw), n))) == own.merged(raw)


def test_decoder(own, library):
    rng, d = random.Random(9), bytepairs.Decoder(own.bytes)
    for _ in range(500):
        some = [rng.randrange(50_257) for _ in range(rng.randint(0, 40))]
        assert "".join(d.feed(some)) == library.decode(some, skip_special_tokens=False)
    assert "".join(d.feed([None, 10**6, 64])) == "".join(d.feed([64]))


def test_what_is_refused():
    good = bytepairs.load(bytepairs.default_path())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": good["model"] | {"dropout": 0.1}}, {"model": good["model"] | {"merges": list(reversed(good["model"]["merges"]))}},
                   {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bytepairs.Encoder(good | change)


def test_frames(spark, library):
    rows = [(1, None), (2, ""), (3, "the cat " * 30_000), (None, "x<|endoftext|>'s  \n y"), (4, "日本語テキスト" * 3000), (4, "é" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("kept"))
    path = bytepairs.default_path()
    got = bytepairs.decode(bytepairs.encode(df, path), path, out="back")
    assert got.columns == ["doc_id", "text", "decoded", "ids", "back"]
    for r in got.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.back == library.decode(want, skip_special_tokens=False) and r.decoded == "kept"
    assert bytepairs.decode(bytepairs.encode(df.limit(0), path), path).collect() == []
    over = bytepairs.encode(df, path, out="text")
    assert over.columns == ["doc_id", "ids", "decoded", "text"] and dict(over.dtypes)["text"] == "array<int>"


def test_bytes_that_are_no_utf8(spark):
    df = spark.range(1).select("id", F.expr("cast(x'61ff62' as string)").alias("text"))
    path = bytepairs.default_path()
    assert bytepairs.decode(bytepairs.encode(df, path), path, out="back").first().back == "a�b"


def test_query(spark, tmp_path, library):
    texts = [(1, "Some text, with 12 words"), (2, None), (3, "ünïcode 😀😀 <|endoftext|>")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bytepairs.op13_byte_bpe(spark, str(tmp_path)).collect():
        text = dict(texts)[r.doc_id] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(",".join(map(str, want))), sha(text))


def test_many_words_at_once(own):
    """The merges of many words together are those of each."""
    rng = random.Random(11)
    tokens = list(own.bytes.values())
    words = [b"", b"a", b"zz", *(b"".join(rng.choices(tokens, k=rng.randint(1, 4)))[:24] for _ in range(9000)), *(rng.randbytes(rng.randint(1, 24)) for _ in range(500))]
    assert own.merged_many(words) == [tuple(own.merged(w)) for w in words]
