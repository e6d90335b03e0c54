"""Models with a character map of their own, against the library."""

from __future__ import annotations

import random

import numpy as np
import pytest

from brookmart.llm import pieces
from brookmart.llm.normaliser import Normaliser, rules

sentencepiece = pytest.importorskip("sentencepiece")


def number(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def charsmap(rule: str) -> bytes:
    proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    return dict(pieces.fields(next(v for n, v in pieces.fields(proto) if n == 3))).get(2, b"")


def with_normaliser(rule: str, prefix: int, tidy: int) -> bytes:
    """The public model with another normaliser: messages of the format that follow each other are merged."""
    found = charsmap(rule)
    spec = (b"\x12" + number(len(found)) + found if found else b"") + b"\x18" + bytes([prefix]) + b"\x20" + bytes([tidy])
    with open(pieces.MODEL, "rb") as f:
        return f.read() + b"\x1a" + number(len(spec)) + spec


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    letter = lambda: chr(rng.choice([rng.randint(32, 127), rng.randint(0xA0, 0x600), rng.randint(0x1E00, 0x33FF), rng.randint(0xF900, 0xFFEF), 32, 32, 32, 9, 10]))
    fixed = ["", "   ", "a  b ", "ﬁ Ａ  x́ ㌔", "▁▁ x▁ ", "ａ　ｂ\tc\n\nd", "①②Å ẛ̣ ½"]
    return fixed + ["".join(letter() for _ in range(rng.randint(1, 60))) for _ in range(300)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize(("prefix", "tidy"), [(0, 0), (0, 1), (1, 0), (1, 1)])
def test_equals_the_library(rule, prefix, tidy):
    model = with_normaliser(rule, prefix, tidy)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Transducer(model)
    for t in texts(prefix * 2 + tidy):
        assert np.frombuffer(own.encode(t), "<i4").tolist() == library.encode(t), t


def test_rules():
    found = rules(charsmap("nmt_nfkc"))
    assert found["ﬁ"] == "fi" and found["Ａ"] == "A" and len(found) > 200_000
    assert Normaliser(b"", True)("  a  b ▁") == "a b" and Normaliser(b"", False)(" a  b ") == " a  b "


def test_a_model_with_a_map_over_a_table(spark, tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(with_normaliser("nmt_nfkc", 1, 1))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rows = [(1, "ﬁne  Ｔext "), (2, None), (3, "plain")]
    got = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), model=str(path)), model=str(path)).collect()
    by = {r.doc_id: r.asDict() for r in got}
    assert list(by[1]["ids"]) == library.encode("ﬁne  Ｔext ") and "fine Text" in map(str, by[1].values())
