"""Typed change rows, and the automaton against a search at every place."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from brookmart.functions.text import Automaton, _split, tokenize
from brookmart.operators import changes
from brookmart.sources import io

#: Columns as a bond trade has them: whole numbers of two sizes, decimals, floats, text, and a flag.
TRADE = "id bigint, side int, price double, amount decimal(16,2), code string, live boolean"


def test_typed_rows_keep_their_types(spark, tmp_path):
    row = lambda n, **more: {"id": n, "side": 1, "price": n * 1.5, "amount": 10.25, "code": f"c{n}", "live": n % 2 == 0} | more
    log = [
        {"database": "d", "tableName": "t", "type": "read", "before": None, "after": row(1)}, {"database": "d", "tableName": "t", "type": "insert", "after": row(2**40)},
        {"database": "d", "tableName": "t", "type": "update", "before": row(1), "after": row(1, price=None, code="new")}, {"database": "d", "tableName": "t", "type": "delete", "before": row(2**40), "after": None},
        {"database": "d", "tableName": "t", "type": "insert", "after": row(3, price="dear", amount=None)}, {"database": "d", "tableName": "t", "type": "update", "before": row(4, side=2**40), "after": row(4)},
        {"database": "d", "tableName": "t", "type": "insert", "after": {"id": 5, "price": "2.5", "extra": [1]}}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/0.json").write_text("".join(json.dumps(x) + "\n" for x in log) + "no json\n")
    good, bad = io.read_typed_changelog(spark, str(tmp_path / "log"), TRADE)
    assert dict(good.dtypes)["after"] == "struct<id:bigint,side:int,price:double,amount:decimal(16,2),code:string,live:boolean>"
    assert sorted(map(str, (r.errors for r in bad.collect()))) == ["['after.price']", "['before.side']", "['json']"]
    assert all(r.value for r in bad.collect())
    numbered = good.withColumn("seq", F.monotonically_increasing_id())
    table = {r.id: r.row for r in changes.replay(numbered).collect()}
    assert set(table) == {1, 5} and (table[1].price, table[1].code, float(table[1].amount)) == (None, "new", 10.25) and (table[5].price, table[5].side) == (2.5, None)
    flags = changes.to_retract(numbered).select("seq", "flag", "row.id", "row.price").orderBy("seq", "step").collect()
    assert [(r.flag, r.id, r.price) for r in flags] == [(True, 1, 1.5), (True, 2**40, 1.5 * 2**40), (False, 1, 1.5), (True, 1, None), (False, 2**40, 1.5 * 2**40), (True, 5, 2.5)]
    kept = changes.filter_columns(good.withColumn("sinkColumns", F.lit("id,amount"))).where("after.id = 1").select(F.to_json("after").alias("j"), "after.amount")
    assert {r.j for r in kept.collect()} == {'{"id":1,"amount":10.25}'} and kept.schema["amount"].dataType.simpleString() == "decimal(16,2)"


def brute(run, entries):
    found = sorted((s, -e) for s in range(len(run)) for e in range(s + 1, len(run) + 1) if run[s:e] in entries)
    covered = {k for s, e in found for k in range(s, -e)}
    return [run[s:-e] for s, e in sorted(found + [(k, -k - 1) for k in range(len(run)) if k not in covered])]


def test_automaton_finds_every_entry():
    rng = random.Random(6)
    for _ in range(400):
        letters = "中国人民大学"[: rng.randint(1, 6)]
        entries = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
        assert _split(run, Automaton(entries)) == brute(run, entries)
    nested = Automaton(["a", "aa", "aaa", "b", "", "aab"])
    assert sorted(nested.find("aaab")) == sorted((s, e) for s in range(4) for e in range(s + 1, 5) if "aaab"[s:e] in ("a", "aa", "aaa", "b", "aab"))


def test_unspaced_text_and_compounds(spark):
    df = spark.createDataFrame([(1, "北京大学 Haustür x"), (2, None), (3, "")], "id long, text string")
    fine = tokenize(df, "text", ["北京", "北京大学", "大学", "haus", "tür"])
    assert [r.keyword for r in fine.collect()] == ["北京大学", "北京", "大学", "haustür", "x"]
    parts = tokenize(df, "text", ["haus", "tür", "au"], compounds=True, rest=False)
    assert [r.keyword for r in parts.collect()] == ["haus", "au", "tür"]
