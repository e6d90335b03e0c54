"""URL filters: host rules, then a logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled URL table (the caller's, or the one below). Defined results: a null url or
one without "://" has empty host and path, fits no rule and is judged by the model's intercept; of rules of equal length
that fit, the first listed wins; repeated rows and rows with null ids are judged alike; an empty table gives no rows; urls
of any length are read whole; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (action, host, path prefix). Hosts cover their subdomains; the longest rule that fits wins.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Words of hosts that filters of unwanted pages and that reading lists are usually made of.
UNWANTED = (
    "adult ads affiliate bets betting bingo bitcoin bonus cams casino cheap clickbait coupon crack dating deals diet discount download escort "
    "fake free gamble giveaway hack jackpot keygen loan lottery lucky mortgage nude offers payday pharma pills poker popup porn prize profit "
    "replica roulette serial sexy slots spam sweepstake torrent tracker viagra warez weightloss win xxx"
).split()
WANTED = (
    "academy archive art astronomy author biology books bridge building care chemistry children church city climate college community cooking "
    "country court culture data design doctor economy education energy engineering farm film forest forum garden geography government harbour "
    "health heritage history hospital house island journal kitchen language law letters library literature magazine market mathematics "
    "medicine mountain museum music nation nature news ocean office opera orchestra paper park philosophy physics planet poetry post press "
    "project public radio research review river school science society software sport station street student teacher theatre today town track "
    "travel university village voice water weather world writing"
).split()
PATHS = ("/", "/about", "/en/12", "/de/431.html", "/es/77/", "/fr/905?page=2", "/index.html", "/a/b/c")
TOPS, SUBS = ("com", "net", "org"), ("", "www.", "blog.", "m.")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted): every word alone, before and behind another word of its kind, or behind any name of letters,
    under the same tops, subdomains and paths for both labels. The partners are drawn with a fixed seed."""
    rng, out = random.Random(42), []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for w in words:
            name = "".join(rng.choice("aeiou" if k % 2 else "bcdfghklmnprstvw") for k in range(rng.randint(4, 9)))
            others = rng.sample([x for x in words if x != w], 3)
            hosts = [w, f"{w}-{others[0]}", f"{others[1]}{w}", f"{w}{others[2]}", f"{name}-{w}"]
            hosts += [name] if label == 0 else []
            for host in hosts:
                out.append((f"https://{rng.choice(SUBS)}{host}.example.{rng.choice(TOPS)}{rng.choice(PATHS)}", label))
    return out


def host_column(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or none."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower)


def path_column(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; plain SQL conditions, no Python."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # later conditions stand in front
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def grams(host: str, path: str, sizes: Sequence[int] = (3, 4, 5), buckets: int = 1 << 15) -> list[int]:
    """Hashed n-grams; host and path have salts of their own. Digits count as one, so that numbers carry nothing."""
    out = []
    for salt, text in ((1, f"^{host}$"), (2, f"^{re.sub(r'[0-9]+', '0', path)}$")):
        data = text.encode()
        out += [zlib.crc32(data[k : k + n], salt) % buckets for n in sizes for k in range(len(data) - n + 1)]
    return out


def train(rows: Sequence[tuple[str, int]], buckets: int = 1 << 15, rounds: int = 300, rate: float = 0.5, l2: float = 1e-3) -> np.ndarray:
    """Weights, with the intercept last; full-batch gradient steps on the small table, the same on every run."""
    cut = re.compile(r"://([^/?#]*)([^?#]*)")
    found = [np.array(grams(m[1].lower(), m[2], buckets=buckets) if (m := cut.search(url)) else [], np.int64) for url, _ in rows]
    used = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))  # only buckets that occur have weights
    x = np.zeros((len(rows), len(used) + 1), np.float32)
    for r, g in enumerate(found):
        np.add.at(x[r], np.searchsorted(used, g), 1)
        x[r] /= max(1.0, float(np.linalg.norm(x[r])))
    x[:, -1] = 0.1
    y, w = np.array([v for _, v in rows], np.float32), np.zeros(len(used) + 1, np.float32)
    step = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = 0.9 * step + rate * (x.T @ (y - p) / max(1, len(rows)) * 10 - l2 * w)
        w += step
    out = np.zeros(buckets + 1, np.float32)
    out[used], out[-1] = w[:-1], w[-1] * 0.1
    return out


def score(df: DataFrame, weights: np.ndarray, key: str, host: str = "host", path: str = "path") -> DataFrame:
    """Adds the probability that a url is unwanted to all columns of df."""
    buckets = len(weights) - 1
    sent = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def model(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        """n-grams once per distinct url of a batch, all sums in one go."""
        w, (spot, pairs) = sent.value, pd.factorize(pd.MultiIndex.from_arrays([hosts, paths]))
        found = [np.unique(np.array(grams(*hp, buckets=buckets), np.int64), return_counts=True) for hp in pairs]
        owner = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
        g, n = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        size = np.sqrt(np.bincount(owner, n * n, len(found)))
        sums = np.bincount(owner, w[g] * n, len(found)) / np.maximum(1.0, size) + float(w[-1])
        return pd.Series(1 / (1 + np.exp(-sums[spot])))

    return df.withColumn("unwanted", model(F.col(host), F.col(path)))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES,
          labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, unwanted): the rule's action, else the model's."""
    weights = train(labelled_urls() if labelled is None else labelled)
    rows = pages.select(key, host_column(F.col(url)).alias("host"), path_column(F.col(url)).alias("path"))
    rows = rows.select(key, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    found = score(rows, weights, key).withColumn("hit", rule_column(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("hit.action"), F.when(F.col("unwanted") > threshold, "block").otherwise("allow"))
    return found.select(key, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "unwanted")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url")).drop("unwanted")

