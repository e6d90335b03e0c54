"""Suffix-array deduplication: removes every byte covered by a string of `length` bytes that also starts earlier.

Strings of that length are compared on the input, over all documents, whole texts, as UTF-8 bytes; an earlier start has
a smaller id, or lies earlier in the same document. The result is exact, without looking at every pair of places:

1. Of equal documents all but the first are covered whole; their texts take no part in the joins.
2. Prefix polynomial hashes give the hash of every gram of GRAM bytes. Each window of `length` bytes picks the gram
   with the smallest hash in it (the last of equals), so equal windows pick equal grams at equal offsets. Neighbouring
   windows that pick the same gram form a segment; one row per segment is shuffled by the gram's hash.
3. Segments with equal content (equal gram and equal content, by two independent 64-bit hashes): all but the first are
   covered; those that a task has seen before are settled there and spread over all tasks. Where one gram has several
   contents, the first segment of each content goes on with its bytes.
4. There the suffixes that start at each window are sorted, gram by gram, in a mergesort whose comparisons find the
   common extension by binary search over prefix polynomial hashes; equal neighbours are verified byte by byte. A gram
   with more than MANY contents is split into its windows, which are grouped by their bytes in SQL: exact as well.
5. Each document's covered intervals are joined to its text, once.

Defined results: null text is empty text; texts under `length` bytes lose nothing; rows with equal id and text count
as one document and get equal results; rows with equal id and different texts are ordered by the texts' digests;
null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, GRAM = 100, 32
#: Contents of one gram up to which they are sorted together, and windows sorted at a time.
MANY, AT_ONCE = 3000, 200_000
#: Bytes of text that are hashed at a time.
PIECE = 1 << 18
_LOW = (1 << 28) - 1
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Hashed:
    """Prefix polynomial hashes of a buffer, modulo 2 ** 64: H[i] sums value(byte j) * BASE ** j over j < i."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hashed._powers) < n + 1:
            size = 1 << max(19, (n + 1).bit_length())
            run = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
            Hashed._powers, Hashed._inverse = run(_BASE), run(pow(_BASE, -1, 1 << 64))
        self.data = data
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * Hashed._powers[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.data) - k + 1
        x = (self.sums[k:] - self.sums[:n]) * Hashed._inverse[:n]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))

    def common_extension(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Length, up to `most`, of the common prefix of the suffixes at x and at y; binary search."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most)
        sx, sy, ix, iy = self.sums[x], self.sums[y], Hashed._inverse[x], Hashed._inverse[y]
        for _ in range(int(most).bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.sums[x + mid] - sx) * ix == (self.sums[y + mid] - sy) * iy
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def before(self, x: np.ndarray, y: np.ndarray, most: int, equal: bool) -> np.ndarray:
        """Whether the suffix at x sorts before that at y (or is equal to it, if `equal`) in its first `most` bytes."""
        n = self.common_extension(x, y, most)
        less = self.data[np.minimum(x + n, len(self.data) - 1)] < self.data[np.minimum(y + n, len(self.data) - 1)]
        return np.where(n >= most, equal, less)


def merge_sorted(text: Hashed, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes at `at` within each run of equal `group` (adjacent): a stable bottom-up mergesort in which
    all merges of a level are done together, each suffix finding its place in the sibling run by binary search."""
    order = np.arange(len(at))
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    sizes = np.diff(np.append(starts, len(at)))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    rank = order - first
    width = 1
    while width < (sizes.max() if len(sizes) else 0):
        here = np.flatnonzero(size > width)
        r, f, m = rank[here], first[here], size[here]
        block = r // (2 * width) * (2 * width)
        right = r - block >= width
        low = np.where(right, block, np.minimum(block + width, m))
        high = np.where(right, np.minimum(block + width, m), np.minimum(block + 2 * width, m))
        base = low.copy()
        x = at[order[here]]
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            other = at[order[f[live] + mid]]
            # a suffix of the right run goes behind equal ones of the left run
            ahead = np.where(right[live], text.before(other, x[live], most, True), text.before(other, x[live], most, False))
            low[live] = np.where(ahead, mid + 1, low[live])
            high[live] = np.where(ahead, high[live], mid)
            live = live[low[live] < high[live]]
        own = r - block - np.where(right, width, 0)
        to = f + block + own + (low - base)
        moved = order.copy()
        moved[to] = order[here]
        order = moved
        width *= 2
    return order


def repeated(text: Hashed, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Whether each suffix's first `most` bytes are those of one before it in its group. Equal neighbours in the sorted
    order are verified byte by byte."""
    order = merge_sorted(text, at, group, most)
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(group[a] == group[b])
    same = same[text.common_extension(at[a[same]], at[b[same]], most) >= most]
    out = np.zeros(len(at), bool)
    for s in range(0, len(same), 20_000):
        part = same[s : s + 20_000]
        x, y = (text.data[at[i[part]][:, None] + np.arange(most)] for i in (a, b))
        out[b[part[(x == y).all(1)]]] = True
    return out


def pieces(ids: list[int], texts: list[bytes], most: int = PIECE, length: int = LENGTH) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents by the megabyte: (ids, starts, bytes). A longer one is cut so that each window lies in one piece."""
    out: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for i, t in zip(ids, texts, strict=True):
        for s in range(0, max(1, len(t) - length + 1), most):
            part = t[s : s + most + length - 1]
            if size and size + len(part) > most:
                yield out
                out, size = ([], [], []), 0
            for x, v in zip(out, (i, s, part), strict=True):
                x.append(v)
            size += len(part)
    if size:
        yield out


def segments(ids: list[int], starts: list[int], texts: list[bytes], length: int = LENGTH, k: int = GRAM) -> pd.DataFrame:
    """Rows (gram, content, doc, place) of pieces of documents, ordered by id and start. place holds the first window's start << 16, the
    gram's offset in it << 8, the number of windows, and 128 where equal content stands before in these documents."""
    none = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("gram", "content", "doc", "place")})
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = b"".join(texts)
    if len(buffer) < length:
        return none
    data = np.frombuffer(buffer, np.uint8)
    hashes = Hashed(data).grams(k)
    width = length - k + 1
    spots = np.arange(len(hashes), dtype=np.uint64)
    ranked = (hashes & ~np.uint64(_LOW)) | (np.uint64(_LOW) - spots)
    n = len(data) - length + 1
    rows = np.full(-(-len(ranked) // width) * width, np.uint64(2**64 - 1))
    rows[: len(ranked)] = ranked
    rows = rows.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    picked = _LOW - (least & np.uint64(_LOW)).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + length <= ends[owner]
    new = inside & np.concatenate([[True], (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    total = np.concatenate([[0], np.cumsum(inside)])
    count = total[np.append(first[1:], n)] - total[first]
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(buffer[s:e]) for s, e in zip(first.tolist(), (first + count - 1 + length).tolist(), strict=True)), np.uint64, len(first))
    offset = picked[first] - first
    content ^= offset.astype(np.uint64) * np.uint64(_BASE)
    gram = hashes[picked[first]]
    start = first - (ends - sizes)[owner[first]] + np.array(starts, np.int64)[owner[first]]
    order = np.lexsort((np.arange(len(first)), content, gram))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (gram[order[1:]] == gram[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    place = (start << 16) | (offset << 8) | count | np.where(again, 128, 0)
    gram = np.where(again, gram ^ content ^ place.astype(np.uint64), gram)  # settled here: any task will do
    return pd.DataFrame({"gram": gram.view(np.int64), "content": content.view(np.int64), "doc": np.array(ids, np.int64)[owner[first]], "place": place})


class Seen:
    """What a task remembers of the segments it has sent: per slot one (gram, content) and its least place. Segments with
    equal content that stands before are settled in the task, so that a passage which many documents share sends about
    one row a task to its gram. A slot is taken over by the next content that falls on it; results don't change."""

    def __init__(self, slots: int = 1 << 18):
        self.rows = np.zeros((4, slots), np.int64)
        self.rows[3] = -1

    def settle(self, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([rows[c].to_numpy() for c in ("gram", "content", "doc", "place")])
        fresh = np.flatnonzero((x[3] & 128) == 0)
        g, c, doc, place = x[:, fresh]
        slot = (g ^ c) & (self.rows.shape[1] - 1)
        old = self.rows[:, slot]
        same = (old[0] == g) & (old[1] == c) & (old[3] >= 0)
        before = (old[2] < doc) | (old[2] == doc) & (old[3] >> 16 < place >> 16)
        hit = same & before
        keep = np.flatnonzero(~hit)
        self.rows[:, slot[keep]] = x[:, fresh[keep]]
        done = fresh[hit]
        x[3, done] |= 128
        x[0, done] ^= x[1, done] ^ x[3, done]  # settled: any task will do
        return pd.DataFrame(dict(zip(("gram", "content", "doc", "place"), x, strict=True)))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by gram, content, doc, place. Covered segments (open false), and the first of each content of a gram with
    several (open true). Streams: only one row is held back."""
    last = first = None
    several = False
    for t in common.gathered(batches, 1 << 16):
        rows = np.stack([t[c].to_numpy() for c in ("gram", "content", "doc", "place")])
        settled = (rows[3] & 128) > 0
        shut, opened = [rows[:, settled]], []
        rows = rows[:, ~settled]
        if rows.shape[1]:
            g, c = rows[:2]
            new_gram = np.concatenate([[last is None or last[0] != g[0]], g[1:] != g[:-1]])
            new = new_gram | np.concatenate([[last is None or last[1] != c[0]], c[1:] != c[:-1]])
            shut.append(rows[:, ~new])
            firsts = np.flatnonzero(new)
            run = np.cumsum(new_gram)[firsts]  # 0: the gram that the table before ended with
            counts = np.bincount(run, minlength=int(new_gram.sum()) + 1)
            if counts[0] and not several:
                opened.append(first)
                several = True
            opened.append(rows[:, firsts[(counts[run] > 1) | (run == 0)]])
            if new_gram.any():
                several = counts[-1] > 1
                first = rows[:, firsts[run == run[-1]][:1]]
            last = g[-1], c[-1]
        for part, flag in ((shut, False), (opened, True)):
            if part:
                x = np.concatenate(part, axis=1)
                yield pa.RecordBatch.from_arrays([*map(pa.array, x), pa.array(np.full(x.shape[1], flag))], ["gram", "content", "doc", "place", "open"])


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of each open segment, from the texts."""
    for b in batches:
        places, parts = [], []
        for data, p in zip(b["data"], b["places"], strict=True):
            places.append(np.asarray(p, np.int64))
            start = places[-1] >> 16
            end = start + (places[-1] & 127) - 1 + LENGTH
            parts += [bytes(data[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        sizes = [len(p) for p in places]
        yield pd.DataFrame({"gram": np.concatenate(list(b["grams"])), "doc": np.repeat(b["doc"].to_numpy(), sizes), "place": np.concatenate(places), "bytes": parts})


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by gram, doc, place: the covered runs of windows, from suffix sorts of whole grams at a time."""
    kept = None
    for t in common.gathered(batches, AT_ONCE // 34):
        rows = t if kept is None else pa.concat_tables([kept, t])
        g = rows["gram"].to_numpy()
        cut = int(np.flatnonzero(g == g[-1])[0])
        if cut:
            yield _covered(rows.slice(0, cut).to_pandas())
        kept = rows.slice(cut)
    if kept is not None:
        yield _covered(kept.to_pandas())


def _runs(doc, start, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, start, windows)], ["doc", "start", "windows"])


def _covered(rows: pd.DataFrame) -> pa.RecordBatch:
    place = rows["place"].to_numpy(np.int64)
    count, offset = place & 127, (place >> 8) & 255
    sizes = np.array([len(x) for x in rows["bytes"]], np.int64)
    text = Hashed(np.frombuffer(b"".join(rows["bytes"]), np.uint8))
    seg = np.repeat(np.arange(len(rows)), count)
    t = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[seg] + t
    gram = np.cumsum(np.diff(rows["gram"].to_numpy(), prepend=rows["gram"].iloc[0]) != 0)
    group = gram[seg] * 256 + offset[seg] - t + 128  # equal windows hold the gram at equal offsets
    order = np.lexsort((np.arange(len(seg)), group))
    again = np.zeros(len(seg), bool)
    again[order] = repeated(text, at[order], group[order], LENGTH)
    hit = np.flatnonzero(again)
    if not len(hit):
        return _runs([], [], [])
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])])
    s = hit[new]
    n = np.diff(np.append(np.flatnonzero(new), len(hit)))
    return _runs(rows["doc"].to_numpy()[seg[s]], (place[seg[s]] >> 16) + t[s], n)


def union(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals; touching ones are one."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct (id, text): id, digest (SHA-256 of the text), n_bytes, data and spans, an array of
    struct(start, end). Copies of earlier documents have null data and one span; documents that lose nothing have null
    data and no span; others carry their text once through the joins."""
    spark = docs.sparkSession
    common.small_batches(spark)
    own = docs.select(F.col(key).alias("id"), F.sha2(common.utf8(text), 256).alias("digest"), F.octet_length(common.utf8(text)).cast("long").alias("n_bytes"))
    own = common.written(own.groupBy("id", "digest").agg(F.first("n_bytes").alias("n_bytes")), "texts")
    # of equal texts the first row; ids that repeat with other texts are told apart by the digest
    firsts = own.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNotNull().alias("known"), "id")).alias("m"))
    copies = own.join(firsts.where("n > 1").select("digest", F.col("m.id").alias("first")), "digest").where(~F.col("id").eqNullSafe(F.col("first")))
    copies = common.written(copies.select("id", "digest"), "copies")
    if not own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return _renumbered(docs, own, key, text)
    texts = docs.select(F.col(key).alias("id"), common.utf8(text).alias("data")).where(F.octet_length("data") >= LENGTH)
    return _covered_texts(own, texts, copies)


def _renumbered(docs: DataFrame, own: DataFrame, key: str, text: str) -> DataFrame:
    """The same where ids repeat or are null: every distinct (id, text) gets a number that grows in their order."""
    numbers = own.orderBy(F.col("id").asc_nulls_first(), "digest").select(
        F.col("id").alias("old"), F.col("digest").alias("of"), F.monotonically_increasing_id().alias("number"))
    numbers = common.written(numbers, "numbers")
    same = F.col(key).eqNullSafe(F.col("old")) & (F.sha2(common.utf8(text), 256) == F.col("of"))
    fresh = docs.select(key, text).join(numbers, same).groupBy("number").agg(F.first(text).alias("text"))
    found = covered(common.written(fresh, "numbered"), "number", "text")
    return found.withColumnRenamed("id", "number").join(numbers, "number").select(F.col("old").alias("id"), "digest", "n_bytes", "data", "spans")


def _covered_texts(own: DataFrame, texts: DataFrame, copies: DataFrame) -> DataFrame:
    spark = own.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for b in batches:
            b = b.sort_values("id", kind="stable")
            for part in pieces(b["id"].tolist(), [bytes(d) for d in b["data"]]):
                yield seen.settle(segments(*part))

    found = texts.mapInPandas(cut, "gram long, content long, doc long, place long")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = found.repartition(width, "gram").sortWithinPartitions("gram", "content", "doc", "place")
    met = common.written(met.mapInArrow(_met, "gram long, content long, doc long, place long, open boolean"), "segments")
    shut = met.where("not open").select("doc", F.shiftright("place", 16).alias("start"), F.col("place").bitwiseAND(F.lit(127)).alias("windows"))
    by_doc = met.where("open").groupBy("doc").agg(F.collect_list(F.struct("gram", "place")).alias("todo"))
    by_doc = by_doc.join(shut.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("done")), "doc", "full")
    by_doc = by_doc.join(copies.select(F.col("id").alias("doc")), "doc", "left_anti")
    # one shuffle of texts; copies, and those with neither open nor shut segments, end here
    with_text = common.written(texts.withColumnRenamed("id", "doc").join(by_doc, "doc"), "texts-met")
    todo = with_text.where("todo is not null").select("doc", "data", F.col("todo.gram").alias("grams"), F.col("todo.place").alias("places"))
    contexts = todo.mapInPandas(_contexts, "gram long, doc long, place long, bytes binary")
    contexts = common.written(contexts, "contexts")
    large = common.written(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("gram"), "large-grams")
    few = contexts.join(large, "gram", "left_anti").repartition(width, "gram").sortWithinPartitions("gram", "doc", "place")
    few = few.mapInArrow(_sorted_windows, "doc long, start long, windows long")
    window = contexts.join(large, "gram").select(
        "doc", F.shiftright("place", 16).alias("at"), "bytes", F.explode(F.sequence(F.lit(0), F.col("place").bitwiseAND(F.lit(127)).cast("int") - 1)).alias("t"))
    window = window.select("doc", (F.col("at") + F.col("t")).alias("start"), F.expr(f"substring(bytes, t + 1, {LENGTH})").alias("bytes"))
    first = window.groupBy("bytes").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bytes", "first")
    many = window.join(first, "bytes").where(F.struct("doc", "start") > F.col("first")).select("doc", "start", F.lit(1).cast("long").alias("windows"))
    more = few.unionByName(many).groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("more"))

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def merged(starts: pd.Series, windows: pd.Series) -> pd.Series:
        runs = [union(s := np.asarray(a, np.int64), s + np.asarray(n, np.int64) - 1 + LENGTH) for a, n in zip(starts, windows, strict=True)]
        return pd.Series([[{"start": s, "end": e} for s, e in r] for r in runs])

    none = F.array().cast("array<struct<start:bigint,windows:bigint>>")
    joined = with_text.select("doc", "data", "done").join(more, "doc", "left").withColumn("runs", F.concat(F.coalesce("done", none), F.coalesce("more", none)))
    cut_texts = joined.where(F.size("runs") > 0).select(F.col("doc").alias("id"), "data", merged("runs.start", "runs.windows").alias("spans"))
    base = own.join(copies.select("id", F.lit(True).alias("copy")), "id", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return base.join(cut_texts, "id", "left").select(
        "id", "digest", "n_bytes", "data", F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", empty)).alias("spans"))


@F.pandas_udf(T.BinaryType())
def kept(data: pd.Series, spans: pd.Series) -> pd.Series:
    """The bytes outside the spans."""
    out = []
    for d, cut in zip(data, spans, strict=True):
        at, parts = 0, []
        for s in cut if d is not None else ():
            parts.append(bytes(d[at : s["start"]]))
            at = s["end"]
        out.append(None if d is None else b"".join([*parts, bytes(d[at:])]))
    return pd.Series(out)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covered(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    digest = F.when(F.size("spans") == 0, F.col("digest")).when(F.col("data").isNull(), F.lit(hashlib.sha256().hexdigest())).otherwise(F.sha2(kept("data", "spans"), 256))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), digest.alias("kept_sha256"))


def on_characters(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans, and the whole of each UTF-8 character that is only partly covered."""
    out, at = [], 0
    for s, e in spans:
        while s < e and data[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeated passages; every document stays, cut between characters. Bytes that
    aren't UTF-8 stay as they are, and so do columns of any name."""
    found = covered(docs.select("doc_id", "text")).where(F.size("spans") > 0)

    @F.pandas_udf(T.BinaryType())
    def cut(data: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b"" if d is None else on_characters(bytes(d), [(s["start"], s["end"]) for s in runs]) for d, runs in zip(data, spans, strict=True)], dtype=object)

    id_, digest, short = common.fresh(docs, "cut_id", "cut_digest", "cut_text")
    cuts = found.select(F.col("id").alias(id_), F.col("digest").alias(digest), cut("data", "spans").cast("string").alias(short))
    joined = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts[id_]) & (F.sha2(common.utf8(), 256) == cuts[digest]), "left")
    new = {"text": F.coalesce(short, "text"), "n_chars": F.when(F.col(short).isNotNull(), F.length(short).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return joined.select([new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])
