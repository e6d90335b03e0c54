"""URL filters: held-out accuracy, rules against SQL, ties."""

from __future__ import annotations

import random

import duckdb
import numpy as np

from brookmart.llm import urls

SPLIT = r"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM h"""


def test_rules_equal_sql(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.www.Example.COM", "xexample.com", "net", "a.net", "anet", "com", "b.org", "", "é.net"]
    paths = ["", "/", "/en/", "/en", "/EN/x", "/es/1", "/fr/", "/fr?x=/en/", "?/en/", "#/es/", "//en/"]
    rows = [(k, rng.choice(("http://", "ftp://", "", "x", "a://b://")) + rng.choice(hosts) + rng.choice(paths)) for k in range(800)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(SPLIT).fetchall()}
    got = {r.page_id: (r.host, r.path, r.rule) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == want and len({r for *_, r in want.values()}) == 6


def test_first_of_equal_rules_wins(spark):
    df = spark.createDataFrame([(1, "http://a.b.cc/x/y")], "page_id long, url string")
    rules = [("block", "b.cc", "/x/"), ("allow", "b.cc", "/x/"), ("allow", "cc", "/x/y")]
    assert [r.verdict for r in urls.judge(df, rules=rules).collect()] == ["block"]
    assert [r.verdict for r in urls.judge(df, rules=[rules[1], rules[0], rules[2]]).collect()] == ["allow"]


def margins(w: np.ndarray, rows: list[tuple[str, int]]) -> np.ndarray:
    """Scores by a plain sum over each url's n-grams."""
    out = []
    for url, _ in rows:
        host, _, path = url.split("://")[1].partition("/")
        g, n = np.unique(urls.grams(host, "/" + path.split("?")[0]), return_counts=True)
        out.append(1 / (1 + np.exp(-(w[g] @ n / max(1.0, np.linalg.norm(n)) + w[-1]))))
    return np.array(out)


def test_held_out_hosts(spark):
    """Every fifth url of the labelled table, and hosts of it alone, are left out of training."""
    rows = urls.labelled_urls()
    held, kept = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    p, y = margins(urls.train(kept), held) > 0.5, np.array([v for _, v in held]) == 1
    assert (p & y).sum() / p.sum() >= 0.9 and (p & y).sum() / y.sum() >= 0.75, ((p & y).sum() / p.sum(), (p & y).sum() / y.sum())
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r.page_id: r.unwanted for r in urls.judge(df, labelled=kept).collect()}
    assert np.allclose([got[k] for k in range(len(held))], margins(urls.train(kept), held), atol=1e-5)


def test_names_without_meaning_are_let_through():
    """Hosts of invented syllables are unlike any unwanted word."""
    rng = random.Random(9)
    names = ["".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ti", "es", "or", "is", "al")) for _ in range(rng.randint(2, 5))) for _ in range(300)]
    rows = [(f"https://{rng.choice(('www.', 'm.', ''))}{n}.example.org/en/{k}", 0) for k, n in enumerate(names)]
    assert (margins(urls.train(urls.labelled_urls()), rows) > 0.5).mean() <= 0.05
