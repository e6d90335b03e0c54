from __future__ import annotations

import os

import pytest

from brookmart.jobs.queries import QUERIES, SQL
from tests.oracle import connect, rows

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), connect(DATA).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_plans(spark):
    """One exchange by device for flag, visits and jumps; no Python in built-in operators; dimensions are broadcast."""
    from pyspark.sql import functions as F

    from brookmart.jobs import inputs
    from brookmart.operators import visits

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    pages = inputs.page_log(spark, DATA)
    assert plan(visits.user_jumps(pages)).count("Exchange hashpartitioning(mid") == 1
    # what runs in the end: statistics of visitors scan and shuffle the log once, routes come from one join over one scan
    for name, exchanges in (("agg1_visitor_stats", 1), ("cdc2_route", 0), ("cdc3_filter_columns", 0)):
        df = QUERIES[name](spark, DATA)
        df.collect()
        final = plan(df).split("== Initial Plan ==")[0]
        assert final.count("FileScan parquet") == 1 and final.count("Exchange hashpartitioning(mid") == exchanges, final
    for name in QUERIES:
        if name in ("agg2_product_stats", "agg1_visitor_stats", "cdc2_route", "joi6_7_product_dims"):
            text = plan(QUERIES[name](spark, DATA))
            assert "Python" not in text and "Pandas" not in text
    assert "Broadcast" in plan(QUERIES["joi5_province_dim"](spark, DATA))
    assert "ReadSchema: struct<event_id" in plan(inputs.events(spark, DATA).where(F.col("seq") > 5))


def test_reports_read_their_days_only(spark):
    """The range of days reaches the scans; revenue by product reads orders and lines once each."""
    def scans(name):
        df = QUERIES[name](spark, DATA)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return [line for line in text.splitlines() if "FileScan parquet" in line]

    for name in ("rpt2_gmv_by_trademark", "rpt3_gmv_by_category3", "rpt4_gmv_by_spu", "rpt6_amount_by_province"):
        found = scans(name)
        for table, column in (("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
            one = [s for s in found if f"/{table}.parquet" in s]
            assert len(one) == 1 and f"GreaterThanOrEqual({column}" in one[0] and f"LessThan({column}" in one[0], (name, one)
    assert all("GreaterThanOrEqual(ts" in s for s in scans("rpt11_keyword_ranking"))
    for s in scans("rpt1_gmv"):
        assert "GreaterThanOrEqual(" in s or not any(f"/{t}.parquet" in s for t in ("orders", "lineitem", "events")), s
