"""Learnt words of nine letters or more keep their tolerance for spelling errors."""

from __future__ import annotations

import random

from brookmart.llm import toxicity


def test_long_learnt_words_are_found_misspelled(spark):
    rng = random.Random(5)
    marks = [f"{a}{b}" for a in ("grobling", "snarkwat", "fumblegu") for b in ("ster", "tion", "x")]  # 8 letters alike
    marks += ["vexatious", "quagmired"]
    plain = [f"word{k}" for k in range(200)]
    rows = [(" ".join(rng.sample(plain, 20) + ([rng.choice(marks)] * (k % 2))), k % 2) for k in range(800)]
    sample = spark.createDataFrame(rows, "text string, label int").selectExpr("cast(text as binary) payload", "label")
    terms = toxicity.learn_terms(sample)
    words = [t.text for t in terms if not t.stem]
    assert set(words) >= set(marks) and not any(t.text.startswith("word") for t in terms)
    x = toxicity.Lexicon(terms)
    for m in marks:
        assert x.find(m)[1] == 0 and x.find(m + "ish")[1] == 0
        for wrong in (m[:3] + m[4:], m[:2] + "0" + m[3:], m[:5] + "q" + m[5:]):
            assert x.find(wrong)[1] == 1, wrong
    few = toxicity.learn_terms(sample, limit=len(marks))  # beginnings take no word's place
    assert {t.text for t in few if not t.stem} == set(marks)
