"""A text goes to Python in slices of its words."""

from __future__ import annotations

from brookmart.functions.text import tokenize


def test_long_texts_go_in_slices(spark):
    text = " ".join(f"the{'x' * (k % 5)}" for k in range(1000))
    out = tokenize(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "none")], "id int, text string"), "text", ("the", "he", "th"), compounds=True, rest=False)
    assert [tuple(r) for r in out.groupBy("id").count().collect()] == [(1, 3000)]
    assert [r.keyword for r in out.limit(6).collect()] == ["the", "th", "he"] * 2
    assert "slice(" in out._jdf.queryExecution().optimizedPlan().toString()
