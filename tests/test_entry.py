from __future__ import annotations

import __spark_entry__ as e


def test_every_sql_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"prj1_parse_log", "win3_user_jumps", "agg2_product_stats", "rpt11_keyword_ranking"} <= set(e.queries())
