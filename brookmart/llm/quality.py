"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features, are added up into one lookup table per feature and, after that, one
per chosen pair; a score is the sum of table entries at a row's bins, through the logistic function. The features are
counts over the whole text only (never label, language, source or id).

Training takes at most TRAINING_ROWS labelled rows (those with the smallest id hash) of the training folds; only their
numbers reach the driver. Defined results: null text is empty text and gets a score like any other; without labels
every score is the prior, 0.7; repeated rows and rows with null ids are scored alike; rows without a label are only
scored; an empty table gives no rows; texts of any length count whole; other columns stay as they are, but for one named
like the new column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAINING_ROWS = 8000
NAMES = ("size", "words", "word_size", "upper", "digits", "symbols", "bars", "marks", "points", "foreign", "blank", "fresh", "stutter", "lines", "line_repeats", "short")

_CLASS = np.zeros(256, np.int64)  # 0 lower-case letters
for _k, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*#$%&@^~<>{}\\=+", b"|", b"!?", b".,;:'\"()-_/[]`", bytes(range(128, 256)), bytes(range(33)) + b"\x7f"), 1):
    _CLASS[list(_set)] = _k


def features(data: bytes) -> list[float]:
    """One number per name: shares of kinds of bytes, words that are new, words equal to the one before, lines seen before."""
    n = max(1, len(data))
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=9)
    words = data.split()
    m = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = max(1.0, kinds[0] + kinds[1])
    repeats = sum(map(bytes.__eq__, words[1:], words))
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), (n - kinds[8]) / m, kinds[1] / letters, kinds[2] / n, kinds[3] / n, kinds[4] / n,
        kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, len(set(words)) / m, repeats / m, float(np.log1p(len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), float(len(words) < 5),
    ]


@dataclass
class Model:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[b[:, j]]
        for (j, k), t in self.pairs.items():
            out += t[_coarse(b[:, j], self.tables[j]), _coarse(b[:, k], self.tables[k])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


#: Bins of a feature on its own, and of each side of a pair.
FINE, COARSE = 48, 8


def _coarse(b: np.ndarray, table: np.ndarray) -> np.ndarray:
    return b * COARSE // len(table)


def _step(g: np.ndarray, h: np.ndarray, depth: int, l2: float = 2.0) -> np.ndarray:
    """Leaf values, by bin, of the tree of that depth that best fits gradient sums g with curvatures h."""
    value = g.sum() / (h.sum() + l2)
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + l2) + 1e-9:
            return np.concatenate([_step(g[:k], h[:k], depth - 1, l2), _step(g[k:], h[k:], depth - 1, l2)])
    return np.full(len(g), value)


def _pair_step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over a pair: one cut along the first feature, then one along the second on each side."""
    best, out = -1.0, np.zeros_like(g)
    for k in range(1, len(g)):
        rows = [_step(g[s].sum(0), h[s].sum(0), 1) for s in (slice(0, k), slice(k, None))]
        gain = sum(float((r * g[s].sum(0)).sum()) for r, s in zip(rows, (slice(0, k), slice(k, None)), strict=True))
        if gain > best:
            best, out = gain, np.vstack([np.tile(rows[0], (k, 1)), np.tile(rows[1], (len(g) - k, 1))])
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, n_pairs: int = 6, pair_rounds: int = 30) -> Model:
    """Cyclic boosting. Without both labels only the prior remains: (ones + 7) / (rows + 10)."""
    prior = (y.sum() + 7) / (len(y) + 10)
    width = x.shape[1] if x.ndim == 2 and len(x) else len(NAMES)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, FINE + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(width)]
    model = Model(float(np.log(prior / (1 - prior))), edges, [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    f = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            move = rate * _step(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], h, len(t)), 2)
            t += move
            f += move[b[:, j]]
    c = np.stack([_coarse(b[:, j], t) for j, t in enumerate(model.tables)], axis=1)
    at = {(j, k): c[:, j] * COARSE + c[:, k] for j in range(width) for k in range(j + 1, width)}
    g, h = slopes()
    gain = {p: float((np.bincount(i, g, COARSE**2) ** 2 / (np.bincount(i, h, COARSE**2) + 2)).sum()) for p, i in at.items()}
    for p in sorted(gain, key=lambda p: (-gain[p], p))[:n_pairs]:
        model.pairs[p] = np.zeros((COARSE, COARSE))
    for _ in range(pair_rounds):
        for p, t in model.pairs.items():
            g, h = slopes()
            sums = [np.bincount(at[p], v, COARSE**2).reshape(COARSE, COARSE) for v in (g, h)]
            move = rate * _pair_step(*sums)
            t += move
            f += move.ravel()[at[p]]
    return model


def _numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"x": [features(bytes(d)) for d in b["payload"]], "label": b["label"].to_numpy()})


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = TRAINING_ROWS, folds: int = 4, held: int = 2) -> Model:
    """Fits on the folds other than `held`; the bounded sample of ids is broadcast, the texts stay where they are."""
    common.small_batches(docs.sparkSession)
    sample = common.labelled(docs, labels, "quality", common.fold(key, folds) != held, rows, key)
    got = sample.select("payload", F.col("label").cast("int")).mapInPandas(_numbers, "x array<double>, label int").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(NAMES))
    order = np.lexsort((*x.T, got["label"].to_numpy())) if len(got) else []
    return fit(x[order], got["label"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds a column with the score to all columns of docs."""
    common.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(payload: pd.Series) -> pd.Series:
        if not len(payload):
            return pd.Series([], dtype="float64")
        return pd.Series(sent.value.score(np.array([features(bytes(d)) for d in payload])))

    return docs.withColumn(name, scored(common.utf8(text)))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (common.fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier accepts. Columns of any name stay as they are."""
    model = train(docs, common.table(spark, sf_dir, "labels"))
    (name,) = common.fresh(docs, "score")
    return score(docs, model, name=name).where(F.col(name) >= 0.7).select([F.col(f"`{c}`") for c in docs.columns])
