"""SimHash near-duplicates through an inverted index on the bytes of fingerprints and their positions.

A fingerprint bit is set where over half of the shingles' hashes have it. Two fingerprints that differ in at most k bits
share at least (bytes - k) positional bytes, which is the count filter's guaranteed minimum; the index's keys join
several positional bytes, so that a list stays short, and cover every way to choose the guaranteed ones. For each pair
that meets in a list the shared positional bytes are tallied, pairs under the minimum go, the rest are verified.

Exact links (linked): at most k = 2 of 64 bits. The four pairs of bytes leave two untouched, so six keys find every
link. Lists of over LIST distinct fingerprints aren't paired: their fingerprints meet at every fingerprint one bit away
from them, which two fingerprints share exactly if they differ in at most two bits; such a meeting has at most 65
members and yields a star. So no link is lost and no list gives its square in pairs.

Near-duplicates (similar): five-word shingles; every pair whose shingle sets have a Jaccard similarity of 0.8 is a link.
Candidates come from the positional index of 256-bit fingerprints (keys of three random bytes; of each text the one it
shares most keys with) and from lists of rare shingles: each text posts its rarest ones, so many that two texts of the
similarity share one. In a list all texts are paired with its hub. What isn't in one component after these links is
compared in full, but for pairs that sizes, places and the tally of shared rare shingles rule out. So no component is missed, and a group of near copies
costs about as many pairs as it has members, since they meet at the hub.

Defined results: null text is empty text; no words give fingerprint zero, linked like any other; exact copies are
grouped before any pairing. A null id has the smallest known id of its component, or null, and links its neighbours like
any other; the stage leaves rows with null ids alone. Rows that repeat an id take part each with its text.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .components import components

#: Distinct fingerprints of an index list up to which its pairs are formed at once.
LIST = 48
SEED = 42
#: Frequent shingles that are told from rare ones (sent to every task, 16 bytes each), and shingles that a task counts at a
#: time. The order of shingles only decides how short the lists are; every order gives the same links.
FREQUENT, AT_ONCE = 200_000, 1_000_000
#: Texts with a shingle beyond which its list is kept in parts, and the bits of a key that number the parts.
SPLIT, SALT = 50_000, 0xFFFF


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words (all of a shorter text; none of a text without words). A-Z are lower-cased."""
    w = data.lower().split()  # on bytes: A-Z, and the white space 9-13 and 32
    if not w:
        return np.zeros(0, np.uint64)
    text, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(text, SEED)], np.uint64)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    return np.fromiter((h(text[s : e - 1], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)), np.uint64, len(w) - words + 1)


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n further 64-bit words of each hash."""
    out = np.empty((len(h), n), np.uint64)
    out[:, 0] = h
    for k in range(1, n):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(h: np.ndarray, n: int = 1) -> np.ndarray:
    """n words of 64 bits; bit j of a word is bit j of the hashes' majority."""
    ones = np.zeros(64 * n, np.int64)
    for s in range(0, len(h), 1 << 14):
        bits = np.unpackbits(np.ascontiguousarray(_mixed(h[s : s + (1 << 14)], n)).view(np.uint8).reshape(-1, 8 * n), axis=1, bitorder="little")
        for r in range(0, len(bits), 255):
            ones += bits[r : r + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp long, fingerprint of 16 hexadecimal digits)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(bytes(d), words))[0] for d in b["payload"]], np.uint64)
            yield pd.DataFrame({key: b[key], "fp": fp.view(np.int64), "fingerprint": [f"{x:016x}" for x in fp.tolist()]})

    return common.map_rows(docs, key, {"payload": common.utf8(text)}, run, "fp long, fingerprint string")


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the positions at which two 64-bit fingerprints have the same byte."""
    x = a.bitwiseXOR(b)
    return sum(((_byte(x, k) == 0).cast("int") for k in range(8)), F.lit(0))


def linked(fps: DataFrame, k: int = 2, most: int = LIST) -> DataFrame:
    """(a, b): links between rows of (id, fp long), each fp once, that differ in at most k <= 2 bits, as far as their
    components need them: all links in short lists, stars of links in long ones."""
    if not 0 <= k <= 2:
        raise ValueError("k is 0, 1 or 2")
    pairs = [(i, j) for i in range(4) for j in range(i)]
    part = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))  # noqa: E731  two positional bytes
    keys = F.array(*(F.struct(F.lit(n).alias("n"), F.shiftleft(part(i), 16).bitwiseOR(part(j)).alias("bytes")) for n, (i, j) in enumerate(pairs)))
    lists = fps.select("id", "fp", F.explode(keys).alias("key")).select("id", "fp", "key.n", "key.bytes")
    sizes = lists.groupBy("n", "bytes").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = common.written(lists.join(sizes, ["n", "bytes"]), "index-lists")
    short = met.where(F.col("size") <= most)
    a, b = (short.select("n", "bytes", F.col("id").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    near = a.join(b, ["n", "bytes"]).where("fp_a < fp_b")
    near = near.where(shared_bytes(F.col("fp_a"), F.col("fp_b")) >= 8 - k).where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= k).select("a", "b")
    hot = met.where(F.col("size") > most).select("id", "fp").distinct()
    if k == 2:
        flips = [F.lit(0).cast("long"), *(F.lit(v - (1 << 64) if v >> 63 else v) for v in (1 << s for s in range(64)))]
        at = hot.select("id", F.explode(F.array(*(F.col("fp").bitwiseXOR(f) for f in flips))).alias("spot"))
        first = at.groupBy("spot").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("spot", "a")
        far = at.join(first, "spot").select("a", F.col("id").alias("b")).where("a <> b")
    else:  # one or no bit apart: the other is one of the 65 flips
        flips = [F.lit(v - (1 << 64) if v >> 63 else v) for v in (1 << s for s in range(64))] if k else []
        at = hot.select("id", F.explode(F.array(*(F.col("fp").bitwiseXOR(f) for f in flips))).alias("fp")) if k else hot.limit(0)
        far = at.join(hot.select(F.col("id").alias("b"), "fp"), "fp").select(F.col("id").alias("a"), "b").where("a <> b")
    return near.unionByName(far)


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, k: int = 2) -> DataFrame:
    """(key, fingerprint, component_id): the smallest id reachable over links of at most k bits, itself included."""
    rows = common.written(fingerprints(docs, key, text, words), "fingerprints")
    classes = common.written(rows.groupBy("fp").agg(F.min(key).alias("first")), "fingerprint-classes")
    # fingerprints are linked, not ids: one whose rows have no id still joins its neighbours
    found = components(linked(classes.select(F.col("fp").alias("id"), "fp"), k))
    parts = classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    names = parts.join(parts.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fp", "component_id")
    return rows.join(names, "fp").select(key, "fingerprint", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


# Near-duplicates by similarity


def _frequent(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of all texts, sorted, and in about how many texts each one is. Tasks count what repeats among
    their own texts, so that only such shingles are shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []

        def counted() -> pd.DataFrame:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *kept]), return_counts=True)
            kept.clear()
            return pd.DataFrame({"shingle": h[n > 1].view(np.int64), "n": n[n > 1]})

        for b in batches:
            kept += [np.unique(shingle_hashes(bytes(d), words)) for d in b["payload"]]
            if sum(map(len, kept)) > AT_ONCE:
                yield counted()
        yield counted()

    common.small_batches(docs.sparkSession)
    found = docs.select(common.utf8(text).alias("payload")).mapInPandas(run, "shingle long, n long")
    top = found.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    h, count = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def rarest(h: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray, salt: int = 0, split: int = SPLIT) -> np.ndarray:
    """Keys of a text's rarest distinct shingles, in the order of all texts: so many that two texts of at least the
    similarity have one in common. A key is the shingle's hash with its last 16 bits replaced by 0, or, where a shingle
    is in more than `split` texts, by one of as many numbers from 1 on as keep its lists that short."""
    if not len(h):
        return np.zeros(0, np.int64)
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    count = np.zeros(len(h), np.int64)
    if len(frequent):
        spot = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        count = np.where(frequent[spot] == h, counts[spot], 0)
    first = np.lexsort((h, count))[:n]
    lists = np.minimum(count[first] // split, SALT - 1)
    salts = np.where(lists > 0, 1 + salt % np.maximum(lists + 1, 1), 0)
    return ((h[first] & ~np.uint64(SALT)) | salts.astype(np.uint64)).view(np.int64)


def _wide(docs: DataFrame, key: str, text: str, words: int, n: int, similarity: float) -> DataFrame:
    """(key, digest of the words, number of distinct shingles, fingerprint of n words, keys of the rarest shingles)."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, text, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d in b["payload"]:
                h = np.unique(shingle_hashes(bytes(d), words))
                digest = xxhash.xxh3_128_digest(b" ".join(bytes(d).lower().split()))
                out.append((digest, len(h), fingerprint(h, n).tobytes(), rarest(h, similarity, *sent.value, salt=int.from_bytes(digest[:4], "big"))))
            t = pd.DataFrame(out, columns=["digest", "size", "fp", "rarest"])
            t.insert(0, key, b[key].to_numpy())
            yield t

    return common.map_rows(docs, key, {"payload": common.utf8(text)}, run, "digest binary, size int, fp binary, rarest array<long>")


def _sets(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    @F.pandas_udf("array<long>")
    def shingles(payload: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(bytes(d), words).view(np.int64)) for d in payload])

    return docs.select(key, shingles(common.utf8(text)).alias("shingles"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key and id: pairs of each member with its list's first and with the four members before it. What the
    next table needs of the last list is its key, its first member and its last four."""
    key = first = None
    tail = np.zeros(0, np.int64)
    for t in common.gathered(batches, 1 << 16):
        old = len(tail)
        k = np.concatenate([np.full(old, key if old else 0), t["key"].to_numpy()])
        ids = np.concatenate([tail, t["id"].to_numpy()])
        spot = np.arange(len(k))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), spot, 0))
        head = ids[start]
        if old:
            head = np.where(start == 0, first, head)
        a, b = [], []
        for d in range(1, 5):
            here = np.flatnonzero((spot >= max(d, old)) & (spot - start >= d))
            a.append(ids[here - d])
            b.append(ids[here])
        far = np.flatnonzero((spot >= old) & (head != ids) & ((spot - start > 4) | (start == 0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, head[far]])), pa.array(np.concatenate([*b, ids[far]]))], ["a", "b"])
        key, first, tail = k[-1], head[-1], ids[max(start[-1], len(ids) - 4) :]


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, n: int = 4, keys: int = 48) -> DataFrame:
    """(id, component) of documents that have a copy or a neighbour of at least that similarity of shingle sets."""
    spark = docs.sparkSession
    docs = docs.where(F.col(key).isNotNull())  # a row without an id can't be named as gone
    rows, rows_path = common.stored(_wide(docs, key, text, words, n, similarity).withColumnRenamed(key, "id"), "wide-fingerprints")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"))
    copies = common.written(rows.select("id", "digest").distinct().join(first, "digest").where("id <> first"), "copies")
    classes = rows.where("size > 0").join(common.small(copies.select("id", "digest")), ["id", "digest"], "left_anti")
    near, near_path = common.stored(met_by_bytes(classes.select("id", "fp"), n, keys), "pairs")
    met, met_path = common.stored(shingle_lists(classes), "shingle-lists")
    common.discard(spark, rows_path)
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    links = _verified(_enough(near.unionByName(stars(met, similarity)).distinct(), met, similarity), texts, words, similarity)
    more = _verified(_enough(rest(met, components(links), similarity), met, similarity), texts, words, similarity)
    common.discard(spark, near_path)
    common.discard(spark, met_path)
    return components(links.unionByName(more).unionByName(copies.select(F.col("first").alias("a"), F.col("id").alias("b"))))


def met_by_bytes(fps: DataFrame, n: int = 4, keys: int = 48) -> DataFrame:
    """(a, b) from (id, fp of n words): of each text the one it shares most of its index keys with, two at least."""
    chosen = _key_positions(n, keys)

    def posted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.frombuffer(b"".join(map(bytes, b["fp"])), np.uint8).reshape(len(b), -1).astype(np.int64)
            spot = np.arange(keys)[None, :]
            for column in chosen.T:
                spot = (spot << 8) | fp[:, column]
            yield pd.DataFrame({"key": spot.ravel(), "id": np.repeat(b["id"].to_numpy(), keys)})

    kind = dict(fps.dtypes)["id"]
    width = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = fps.mapInPandas(posted, f"key long, id {kind}").repartition(width, "key").sortWithinPartitions("key", "id")
    pairs = lists.mapInArrow(_neighbours, f"a {kind}, b {kind}").where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    return pairs.where("met > 1").groupBy("b").agg(F.max(F.struct("met", "a")).alias("nearest")).select("nearest.a", "b")


def shingle_lists(classes: DataFrame) -> DataFrame:
    """(key, whole key without its salt, id, size, what is left of the text's shingles from that one on, hub) of texts
    that share the key of one of their rarest shingles with another. The hub of a list is the text with most left: the
    one with the fewest shingles of its own, which is most like all the others. Lists of frequent shingles come in parts."""
    posts = classes.select("id", "size", F.posexplode("rarest").alias("pos", "key")).select("key", "id", "size", (F.col("size") - F.col("pos")).alias("left"))
    whole = Window.partitionBy("key")
    rows = posts.select("*", F.max(F.struct("left", "id", "size")).over(whole).alias("hub"), F.min("id").over(whole).alias("low"), F.max("id").over(whole).alias("high"))
    salted = F.col("key").bitwiseAND(F.lit(SALT)) != 0
    return rows.where((F.col("low") < F.col("high")) | salted).select("key", F.col("key").bitwiseAND(F.lit(~SALT)).alias("shingle"), "id", "size", "left", "hub")


def _can_link(a: dict[str, Column], b: dict[str, Column], similarity: float) -> Column:
    """Whether sizes and what is left from a shared shingle on allow the similarity. At the first one shared, what is
    left of either text must make up the overlap that the two need."""
    need = similarity / (1 + similarity) * (a["size"] + b["size"]) - 1e-6
    return (F.least(a["size"], b["size"]) >= similarity * F.greatest(a["size"], b["size"]) - 1e-6) & (F.least(a["left"], b["left"]) >= need)


def _of(prefix: str) -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("size", "left")}


def stars(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text with the hub of its lists; hubs of the parts of one list with the first of them. As many pairs
    as the lists have rows, at most."""
    own = met.where("id <> hub.id").where(_can_link(_of(""), _of("hub."), similarity)).select("id", F.col("hub.id").alias("hub"))
    heads = met.where("key <> shingle").select("shingle", "hub").distinct()
    top = heads.select("shingle", "hub", F.max("hub").over(Window.partitionBy("shingle")).alias("top")).where("hub.id <> top.id")
    parts = top.where(_can_link(_of("hub."), _of("top."), similarity)).select(F.col("hub.id").alias("id"), F.col("top.id").alias("hub"))
    return own.unionByName(parts).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))


def rest(met: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b): every pair that shares a list, isn't in one component yet, and that sizes and places don't rule out. Only
    texts outside the component that has most of a list are compared to the whole of it; long lists are left to the
    skew join."""
    rows = met.join(found, "id", "left").select("shingle", "id", "size", "left", F.coalesce("component", "id").alias("component"))
    most = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(
        F.max(F.struct("n", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("shingle", "main")
    mixed = rows.join(most, "shingle")
    x, y = (mixed.select("shingle", "main", *(F.col(c).alias(f"{s}_{c}") for c in ("id", "size", "left", "component"))) for s in "xy")
    both = x.where("x_component <> main").drop("main").join(y, "shingle").where("x_component <> y_component and (y_component = main or x_id < y_id)")
    return both.where(_can_link(_of("x_"), _of("y_"), similarity)).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def _enough(pairs: DataFrame, met: DataFrame, similarity: float) -> DataFrame:
    """Pairs of (a, b) that share enough of their rarest shingles: the shingles behind the last of them, of the text whose
    last comes first, are the most that can be shared besides."""
    some = met.groupBy("id").agg(F.collect_set("shingle").alias("keys"), F.first("size").alias("size"))  # one text's rarest
    x, y = (some.select(F.col("id").alias(s), F.col("keys").alias(f"keys_{s}"), F.col("size").alias(f"size_{s}")) for s in "ab")
    behind = lambda c: F.ceil(F.col(c) * similarity - 1e-9) - 1
    both = pairs.join(x, "a").join(y, "b")
    need = similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    return both.where(F.size(F.array_intersect("keys_a", "keys_b")) + F.greatest(behind("size_a"), behind("size_b")) >= need).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those pairs of (a, b) whose shingle sets have at least the similarity."""
    spark = texts.sparkSession
    pairs, pairs_path = common.stored(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets, sets_path = common.stored(_sets(texts.join(common.small(wanted), "id", "left_semi"), "id", "text", words), "shingle-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = common.written(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")
    common.discard(spark, pairs_path)
    common.discard(spark, sets_path)
    return links


def _key_positions(n: int, keys: int, size: int = 3) -> np.ndarray:
    rng = random.Random(SEED)
    return np.array([rng.sample(range(8 * n), size) for _ in range(keys)])


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the smallest id stays."""
    found = similar(docs)
    gone = found.where("id <> component").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
