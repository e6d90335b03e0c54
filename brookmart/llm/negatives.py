"""Hard-negative mining by exact inner-product search over norm buckets.

Candidates are sorted by norm and packed into buckets of BUCKET vectors, one row of arrays each; anchors are packed into
blocks the same way. Blocks of a bounded size go to all tasks and meet the buckets there. By Cauchy-Schwarz a bucket
whose largest norm times an anchor's stays under the lower limit of a window, or under the score of the k-th row found so
far, holds nothing for that window: the join leaves such buckets out for a whole block, the task for single anchors.
What tasks found is merged by window. Scores are whole numbers, so results are exact.

Rows with a null id, label, vector or component, a component that isn't finite, or one that reaches LARGEST after scaling
take no part. Components that a shorter vector lacks count as zero; an empty vector is zero. Repeated rows are rows of
their own: each is an anchor and each can be found, told apart by a number of the row; ties of score and id go to the
smaller such number, which only chooses between rows of one id. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: log2 of the vectors in a bucket and of the anchors in a block; bytes of anchors that one pass sends to the tasks.
BUCKET, BLOCK, PASS_BYTES = 11, 8, 32 * 2**20
#: Components are smaller than this after scaling, so that scores of up to 32,768 components fit a long.
LARGEST = 2**24
LOWEST, HIGHEST = -(2**62), 2**62


def prepared(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, vector, below) of the rows that take part: components are floor(scale * x) of the double x, and `below` is
    the squared norm with a minus, by which rows are sorted."""
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    bounded = F.forall("vector", lambda x: F.coalesce(F.abs(x * scale) < LARGEST, F.lit(False)))  # false for NaN and infinity
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & bounded)
    whole = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("int")))
    norm2 = F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long"))
    return whole.withColumn("below", -norm2)


def packed(rows: DataFrame, bits: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Runs of 2^bits neighbours by place as one row each: (pack, top, width, ids, labels, rows, vectors). Vectors lie one
    after the other, filled up with zeros to the longest; `more` are other arrays, of expressions over the sorted rows `all`."""
    runs = rows.groupBy(F.shiftright("place", bits).alias("pack")).agg(
        F.sort_array(F.collect_list(F.struct("place", *(c for c in rows.columns if c != "place")))).alias("all"), F.max(F.size("vector")).alias("width"))
    part = lambda name: F.transform("all", lambda r: r[name])
    filled = F.flatten(F.transform("all", lambda r: F.concat(r["vector"], F.array_repeat(F.lit(0), F.col("width") - F.size(r["vector"])))))
    top = F.sqrt(-F.get("all", F.lit(0))["below"].cast("double"))
    return runs.select(
        "pack", top.alias("top"), "width", part("id").alias("ids"), part("label").alias("labels"), part("row").alias("rows"), filled.alias("vectors"), *(v.alias(n) for n, v in (more or {}).items()))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: by doubles where no sum can leave what they hold exactly."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if not w:
        return np.zeros((len(a), len(b)), "int64")
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * w
    if most < 2**53:
        return (a.astype("float64") @ b.astype("float64").T).astype("int64")
    return a.astype("int64") @ b.astype("int64").T


class Block:
    """Windows of a block of anchors and the best rows found for each so far."""

    def __init__(self, k: int, ids, labels, rows, vectors, counts, lows, highs):
        self.k, self.ids, self.labels, self.rows, self.vectors = k, ids, labels, rows, vectors
        self.norms = np.sqrt((vectors.astype("float64") ** 2).sum(axis=1)) * (1 + 1e-9)  # rounded up: a bound may only err on the safe side
        self.owner = np.repeat(np.arange(len(ids)), counts)
        self.tag = np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.zeros(0, int)
        self.low, self.high = lows, highs
        self.kth = np.full(len(self.owner), LOWEST)
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in self.owner]  # (-score, id, row), sorted

    def visit(self, top: float, ids, labels, rows, vectors, same: bool) -> None:
        least = np.maximum(self.low, self.kth)
        live = np.flatnonzero(self.norms[self.owner] * (top * (1 + 1e-9)) >= least)
        if not len(live):
            return
        anchors = np.unique(self.owner[live])
        scores = _inner(self.vectors[anchors], vectors)
        if same:
            fits = (self.labels[anchors][:, None] == labels) & (self.rows[anchors][:, None] != rows)
        else:
            fits = self.labels[anchors][:, None] != labels
        scores[~fits] = LOWEST - 1
        at = np.searchsorted(anchors, self.owner[live])
        for j in range(int(self.tag[live].max()) + 1):  # one window of each anchor at a time
            mine = live[self.tag[live] == j]
            s = scores[at[self.tag[live] == j]]
            inside = (s >= least[mine][:, None]) & (s <= self.high[mine][:, None])
            for w, row, ok in zip(mine, s, inside, strict=True):
                if ok.any():
                    self._merge(w, row, np.flatnonzero(ok), ids, rows)

    def _merge(self, w: int, scores, hits, ids, rows) -> None:
        if len(hits) > 4 * self.k:  # all that reach the k-th best of these
            s = scores[hits]
            hits = hits[s >= np.partition(s, -self.k)[-self.k]]
        new = zip((-scores[hits]).tolist(), ids[hits].tolist(), rows[hits].tolist(), strict=True)
        best = self.found[w] = sorted([*self.found[w], *new])[: self.k]
        if len(best) == self.k:
            self.kth[w] = -best[-1][0]

    def results(self) -> Iterator[tuple[int, int, int, int, int]]:
        for w, best in enumerate(self.found):
            for s, i, r in best:
                yield int(self.rows[self.owner[w]]), int(self.tag[w]), -s, i, r


def search(buckets: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor_row, tag, score, id, row): for each window of each anchor the k best rows by score, then id. `same` takes rows of
    the anchor's label but not itself, else rows of other labels. Buckets are scanned once for each pass over the blocks."""
    blocks = blocks.withColumnsRenamed({c: f"a_{c}" for c in ("pack", "top", "width", "ids", "labels", "rows", "vectors")})
    pairs = buckets.join(F.broadcast(blocks), F.col("top") * F.col("a_top") * (1 + 1e-9) >= F.col("least"))  # the caller bounds the pass

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, Block] = {}
        for b in batches:
            for k_ in range(b.num_rows):
                get = lambda name, b=b, k_=k_: b.column(b.schema.get_field_index(name))[k_]
                array = lambda name, get=get: get(name).values.to_numpy(zero_copy_only=False)
                matrix = lambda name, n, get=get, array=array: array(name).reshape(n, -1)
                block = get("a_pack").as_py()
                if block not in state:
                    own = array("a_ids")
                    state[block] = Block(k, own, array("a_labels"), array("a_rows"), matrix("a_vectors", len(own)), array("counts"), array("lows"), array("highs"))
                ids = array("ids")
                state[block].visit(get("top").as_py(), ids, array("labels"), array("rows"), matrix("vectors", len(ids)), same)
        out = [r for s in state.values() for r in s.results()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(5)], names=["anchor_row", "tag", "score", "id", "row"])

    spark = buckets.sparkSession
    common.small_batches(spark)
    found = pairs.mapInArrow(visits, "anchor_row long, tag long, score long, id long, row long")
    best = Window.partitionBy("anchor_row", "tag").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def by_passes(buckets: DataFrame, anchors: DataFrame, k: int, same: bool) -> tuple[DataFrame, list[str]]:
    """search() for all anchors, which have a place and `windows` (lo, hi): as many passes as PASS_BYTES asks for."""
    flat = lambda name: F.flatten(F.transform("all", lambda r: F.transform(r["windows"], lambda w: w[name])))
    blocks = packed(anchors, BLOCK, {
        "counts": F.transform("all", lambda r: F.size(r["windows"])), "lows": flat("lo"), "highs": flat("hi"),
        "least": F.array_min(flat("lo")).cast("double")})
    blocks, path = common.stored(blocks, "blocks")
    paths = [path]
    size = blocks.agg(F.max("width").alias("width"), F.max("pack").alias("last")).first()
    a_pass = max(1, PASS_BYTES // (4 * (1 << BLOCK) * max(size.width or 1, 16)))
    out = None
    for first in range(0, (size["last"] or 0) + 1, a_pass):
        found, path = common.stored(search(buckets, blocks.where(F.col("pack").between(first, first + a_pass - 1)), k, same), "found")
        paths.append(path)
        out = found if out is None else out.unionByName(found)
    return out, paths


def mine(rows: DataFrame, anchor: Column, lower: tuple[int, int] = (50, 100), upper: tuple[int, int] = (95, 100), positives: int = 5, negatives: int = 3) -> DataFrame:
    """Hard negatives of prepared() rows. Anchors are the rows for which `anchor` (over id, label) holds. A negative's score n
    lies between lower and upper, fractions as (numerator, denominator), of the positive's score p; none does if p < 0."""
    placed, paths = common.placed(rows.withColumn("tree", F.lit(0)), ("below", "id"))
    placed, path = common.stored(placed.select("id", "label", "vector", "below", "row", "place"), "by-norm")
    paths.append(path)
    buckets, path = common.stored(packed(placed, BUCKET), "buckets")
    paths.append(path)
    own, more = common.placed(placed.where(anchor).select("id", "label", "vector", "below", F.col("row").alias("number"), F.lit(0).alias("tree")), ("below", "id"))
    own, path = common.stored(own.select("id", "label", "vector", "below", F.col("number").alias("row"), "place"), "anchors")
    paths += [*more, path]
    everything = F.array(F.struct(F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi")))
    near, more = by_passes(buckets, own.withColumn("windows", everything), positives, True)
    paths += more
    p = F.col("score")
    # whole-number limits: ceil(p * a / b) and floor(p * a / b) for p >= 0
    low, high = F.expr(f"(score * {lower[0]} + {lower[1] - 1}) div {lower[1]}"), F.expr(f"score * {upper[0]} div {upper[1]}")
    pairs = near.where(p >= 0).select("anchor_row", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("lo"), high.alias("hi"))
    ranges = pairs.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score", "lo", "hi"))).alias("windows"))
    asked, path = common.stored(own.join(ranges.withColumnRenamed("anchor_row", "row"), "row"), "asked")
    paths.append(path)
    far, more = by_passes(buckets, asked, negatives, False)
    paths += more
    named = asked.select(F.col("id").alias("anchor_id"), F.col("row").alias("anchor_row"), F.posexplode("windows").alias("tag", "w")).select(
        "anchor_id", "anchor_row", F.col("tag").cast("long").alias("tag"), "w.positive_id", "w.positive_score")
    out = far.join(named, ["anchor_row", "tag"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = common.written(out, "negatives")
    for path in paths:
        common.discard(rows.sparkSession, path)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id is divisible by 50 are anchors; the label of those divisible by 7 moves on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label, 256)
    return mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3)
