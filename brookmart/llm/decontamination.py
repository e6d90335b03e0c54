"""Benchmark decontamination by template: re-parameterised questions are found as well as literal copies.

Numbers, names (capitalised words inside a sentence) and units (after a number) become typed placeholders, runs of one
type a single one. Windows of WINDOW canonical tokens are hashed; documents' windows are joined to the benchmark's by
hash and checked token by token. A filter of a fixed size, set from all of the benchmark's windows, goes to the tasks, so
that windows which meet nothing aren't shuffled; a benchmark that fills it only lets more windows through to the join. Windows that meet at one offset form an alignment. Slots must be consistent: in an
alignment, one value of the benchmark may stand for one value of the document only; windows with slots that break this
do not count. A document is contaminated by an item if the windows that count make up half of the item's windows, or
RUN of them.

Windows with fewer than LEAST_WORDS plain words say nothing and are left out on both sides; items shorter than a window
are one window of their own length, for which SHORT_WORDS plain words of SHORT tokens at least are enough. Beside the
templates stand literal windows, of lower-cased tokens as they are (numbers, names and units too), under the same rule:
so an item is found word for word, in any case, whatever its template says. An item of one to three tokens counts only
as a literal copy and if it has LEAST_LETTERS characters; too_short() lists the others. Items that differ in nothing but
slot values are searched for as one class. Defined results: null text is
empty text without windows; null ids take part like other ids; equal items each give their row; repeated documents are
judged alike; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, LEAST_WORDS, RUN = 8, 4, 8
SHORT, SHORT_WORDS = 5, 3
#: Tokens from which a literal item counts however short they are; below, it has so many characters (single spaces included).
LEAST_TOKENS, LEAST_LETTERS = 4, 16
#: The filter of benchmark windows has 2 ** FILTER bits (1 MB), of which each window sets two.
FILTER = 23
#: Units.
UNITS = frozenset(
    "km m cm mm mi mile miles ft foot feet inch inches yd yard yards kg g mg lb lbs oz ton tons l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh km/h % percent $ € £ usd eur gbp "
    "dollar dollars euro euros cent cents ° c f k hz khz mhz ghz w kw v a n j kj cal kcal pa bar mol".split())
TOKEN = re.compile(r"[^\W\d_]\w*|\d+(?:[.,:/]\d+)*|[.!?\n]|[%$€£°]")
END = frozenset(".!?\n")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Numbers(dict):
    """Raw token -> number; unknown ones get theirs from the owner."""

    def __init__(self, new):
        self.new = new

    def __missing__(self, t: str) -> int:
        return self.new(t)


class Canon:
    """Canonical tokens of texts, by arrays; what is known of each distinct raw token is remembered."""

    TYPES = ("", "<number>", "<unit>", "<name>")

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.ids = Numbers(self.number)
        self.low: list[str] = []
        self.kind = np.zeros(1 << 16, np.int64)  # 0 end of a sentence, 1 number, 2 word, 3 capitalised word; 4 more for units
        self.hash = np.zeros(1 << 16, np.uint64)

    def number(self, t: str) -> int:
        low = t.lower()
        capital = low != t and t[0] != low[0] and (len(t) == 1 or t[1:] == low[1:])
        kind = 0 if t in END else 1 if t[0].isdigit() else (3 if capital else 2) + 4 * (low in UNITS)
        n = self.ids[t] = len(self.low)
        if n == len(self.kind):
            self.kind, self.hash = np.concatenate([self.kind, self.kind]), np.concatenate([self.hash, self.hash])
        self.low.append(low)
        self.kind[n], self.hash[n] = kind, xxhash.xxh3_64_intdigest(low)
        return n

    def __call__(self, texts: list[str]) -> Tokens:
        if len(self.ids) > 500_000:
            self.forget()
        known = self.ids.__getitem__
        found = [list(map(known, TOKEN.findall(t))) for t in texts]
        counts = [len(f) for f in found]
        ids = np.fromiter(chain.from_iterable(found), np.int64, sum(counts))
        owner = np.repeat(np.arange(len(texts)), counts)
        top = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(ids)]
        before = lambda x: np.concatenate([[False], x[:-1]])[: len(ids)] & ~top
        kind = self.kind[ids]
        end, number = kind == 0, kind == 1
        unit = (kind > 4) & before(number)
        name = (kind & 3 == 3) & ~top & ~before(end) & ~unit
        types = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))[~end]
        ids, owner = ids[~end], owner[~end]
        first = np.concatenate([[True], (types[1:] == 0) | (types[1:] != types[:-1]) | (owner[1:] != owner[:-1])])[: len(ids)]
        starts = np.flatnonzero(first)
        return Tokens(self, ids, types[starts], starts, owner[starts], owner)


@dataclass
class Tokens:
    """Canonical tokens of several texts: their types, where each one's raw tokens start (a run of one placeholder type
    is one), and the number of its text; and the number of each raw token's text."""

    canon: Canon
    ids: np.ndarray
    types: np.ndarray
    starts: np.ndarray
    owner: np.ndarray
    raw_owner: np.ndarray

    def hashes(self) -> np.ndarray:
        return np.where(self.types == 0, self.canon.hash[self.ids[self.starts]], self.types.astype(np.uint64))

    def window(self, s: int, e: int) -> tuple[list[str], list[str]]:
        """Tokens, and the slot values (empty for plain words)."""
        low, tokens, values = self.canon.low, [], []
        for k in range(s, e):
            t = int(self.types[k])
            raw = self.ids[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else None].tolist()
            tokens.append(Canon.TYPES[t] if t else low[raw[0]])
            values.append(" ".join(low[i] for i in raw) if t else "")
        return tokens, values


def canonical(text: str) -> tuple[list[str], list[str]]:
    """Canonical tokens of one text, and each one's slot value (empty for plain words)."""
    t = Canon()([text])
    return t.window(0, len(t.starts))


def hashed_windows(h: np.ndarray, plain: np.ndarray | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows that have enough plain words; of all windows, hashed otherwise, if plain is None."""
    n = len(h) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.full(n, length + (WINDOW if plain is None else 0), np.uint64)
    for k in range(length):
        x = (x ^ (x >> np.uint64(29))) * _STEP + h[k : k + n]
    x ^= x >> np.uint64(32)
    if plain is None:
        return np.arange(n), x.view(np.int64)
    words = np.concatenate([[0], np.cumsum(plain)])
    keep = np.flatnonzero(words[length:] - words[:n] >= (SHORT_WORDS if SHORT <= length < WINDOW else LEAST_WORDS))
    return keep, x.view(np.int64)[keep]


_MASK = (1 << FILTER) - 1


def _set(wanted: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (wanted[bit >> 6] >> (bit & 63)) & 1 == 1


def window_filter(items: DataFrame) -> np.ndarray:
    """Words of the filter from (hash): the bits are put together by Spark, and at most 2 ** FILTER / 64 words come back."""
    bit = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(_MASK)), F.shiftright("hash", FILTER).bitwiseAND(F.lit(_MASK))))
    words = items.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (FILTER - 6), np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def _windows(canon: Canon, texts: list[str], lengths: list[int] | None, wanted: np.ndarray | None) -> list[tuple]:
    """(number of the text, start, length, hash, template, slot values) of windows inside one text; literal windows have
    negative lengths and no slots. Lengths None: the only text's own windows."""
    tokens = canon(texts)
    if not len(tokens.starts):
        return []
    h, plain, raw = tokens.hashes(), tokens.types == 0, canon.hash[tokens.ids]
    if lengths is None:
        low = [canon.low[i] for i in tokens.ids.tolist()]
        literal = len(low) >= LEAST_TOKENS or len(" ".join(low)) >= LEAST_LETTERS
        lengths = [min(WINDOW, len(h)), *([-min(WINDOW, len(low))] if literal else [])]
    tops = [np.searchsorted(owner, np.arange(len(texts))) for owner in (tokens.owner, tokens.raw_owner)]
    out = []
    for length in lengths:
        long, literal = abs(length), length < 0
        start, x = hashed_windows(raw, None, long) if literal else hashed_windows(h, plain, long)
        owner, top = (tokens.raw_owner, tops[1]) if literal else (tokens.owner, tops[0])
        if wanted is not None and len(x):
            met = np.flatnonzero(_set(wanted, x & _MASK))
            met = met[_set(wanted, (x[met] >> FILTER) & _MASK)]
            start, x = start[met], x[met]
        keep = owner[start] == owner[start + long - 1]
        for s, v in zip(start[keep].tolist(), x[keep].tolist(), strict=True):
            words, values = ([canon.low[i] for i in tokens.ids[s : s + long].tolist()], []) if literal else tokens.window(s, s + long)
            out.append((int(owner[s]), int(s - top[owner[s]]), length, v, " ".join(words), [w for w in values if w]))
    return out


COLUMNS = "start int, length int, hash long, template string, slots array<string>"


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """Windows of the items. `pattern` tells which slots of an item hold the same value, by the number of the value in the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for b in batches:
            rows = []
            for k, d in zip(b[key], b["payload"], strict=True):
                number: dict[str, str] = {}
                for _, *w in _windows(canon, [bytes(d).decode(errors="replace")], None, None):
                    rows.append((k, *w, [number.setdefault(v, str(len(number))) for v in w[-1]]))
            yield pd.DataFrame(rows, columns=[key, "start", "length", "hash", "template", "slots", "pattern"])

    rows = common.map_rows(benchmark, key, {"payload": common.utf8(text)}, run, COLUMNS + ", pattern array<string>")
    twice = benchmark.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("_k"))
    # numbers are of one text; where several texts share an id, the values speak for themselves
    rows = rows.join(twice.withColumn("_t", F.lit(True)), F.col(key).eqNullSafe(F.col("_k")), "left")
    return rows.withColumn("pattern", F.when(F.col("_t"), F.col("slots")).otherwise(F.col("pattern"))).drop("_k", "_t")


def classes(items: DataFrame, item: str) -> DataFrame:
    """(item, form, wording) of item_windows(): items of one form have the same template windows and the same pattern of equal
    slots, so that a document meets all of them or none by template; items of one wording have the same literal windows too."""
    shape = lambda kind, *columns: F.sort_array(F.collect_list(F.when(kind, F.struct(*columns))))
    literal = F.col("length") < 0
    by = items.groupBy(item).agg(shape(~literal, "start", "length", "template", "pattern").alias("t"), shape(literal, "start", "length", "template").alias("l"))
    name = lambda *parts: F.sha2(F.to_json(F.struct(*parts)).cast("binary"), 256)
    return by.select(item, F.when(F.size("t") > 0, name("t")).otherwise(name("t", "l")).alias("form"), name("t", "l").alias("wording"))


def document_windows(docs: DataFrame, lengths: list[int], wanted: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of whole texts that pass the filter."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for b in batches:
            texts, keys = [bytes(d).decode(errors="replace") for d in b["payload"]], b[key].tolist()
            rows = []
            for s in range(0, len(texts), 32):
                rows += [(keys[s + i], *w) for i, *w in _windows(canon, texts[s : s + 32], lengths, sent.value)]
            yield pd.DataFrame(rows, columns=[key, "start", "length", "hash", "template", "slots"])

    return common.map_rows(docs, key, {"payload": common.utf8(text)}, run, COLUMNS)


@dataclass
class Found:
    """What met: hits of classes, and what their members are told from."""

    forms: DataFrame  # (key, form, matched, windows)
    wordings: DataFrame  # (key, wording, matched, windows)
    members: DataFrame  # (item, form, wording)
    items: DataFrame  # windows of the items
    sound: DataFrame  # (key, form, item_start, slots): template windows that count


def enough(matched: str, windows: str) -> Column:
    return (F.col(matched) * 2 >= F.col(windows)) | (F.col(matched) >= RUN)


def same(*columns: str) -> Column:
    """Equality of columns with those of the other side, which have a mark before their names; nulls are equal."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def marked(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"_{c}") for c in columns), *(c for c in df.columns if c not in columns))


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> Found:
    """Documents against classes of items. Windows meet forms first; by their literal windows only those documents and forms
    are looked at that didn't meet and have enough windows in common to make a wording of the form."""
    items = common.written(item_windows(benchmark, item), "benchmark-windows")
    members = common.written(classes(items, item), "benchmark-classes")
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most twice WINDOW values
    found = common.written(document_windows(docs, lengths, window_filter(items), key, text), "windows-found")
    on = ["hash", "length", "template"]
    classed = items.join(marked(members, item), same(item))
    of_forms = classed.where("length > 0").select("form", F.col("start").alias("item_start"), *on, "pattern").dropDuplicates(["form", "item_start", *on])
    met = found.where("length > 0").join(of_forms, on)
    met = met.select(key, "form", (F.col("start") - F.col("item_start")).alias("offset"), "item_start", "slots", F.arrays_zip(F.col("pattern").alias("a"), F.col("slots").alias("b")).alias("pairs"))
    met = common.written(met, "windows-met")
    # slots of an alignment: at most the item's length
    pairs = met.select(key, "form", "offset", F.explode("pairs").alias("p")).groupBy(key, "form", "offset", "p.a").agg(F.countDistinct("p.b").alias("values"))
    broken = pairs.where("values > 1").groupBy(key, "form", "offset").agg(F.collect_set("a").alias("broken"))
    joined = met.join(marked(broken, key, "form", "offset"), same(key, "form", "offset"), "left")
    sound = joined.where(F.col("broken").isNull() | ~F.arrays_overlap(F.transform("pairs", lambda p: p["a"]), F.coalesce("broken", F.array().cast("array<string>"))))
    sound = sound.select(key, "form", "item_start", "slots")
    sizes = of_forms.groupBy("form").agg(F.countDistinct("item_start").alias("windows"))
    forms = sound.groupBy(key, "form").agg(F.countDistinct("item_start").alias("matched")).join(sizes, "form").where(enough("matched", "windows"))
    forms = common.written(forms.select(key, "form", "matched", "windows"), "forms-met")

    of_wordings = classed.where("length < 0").select("form", "wording", F.col("start").alias("item_start"), *on).dropDuplicates(["wording", "item_start", *on])
    sizes = of_wordings.groupBy("form", "wording").agg(F.countDistinct("item_start").alias("windows"))
    least = sizes.groupBy("form").agg(F.min("windows").alias("least"))
    times = of_wordings.groupBy("form", "wording", *on).agg(F.count(F.lit(1)).alias("n")).groupBy("form", *on).agg(F.max("n").alias("n"))
    near = found.where("length < 0").select(key, *on).distinct().join(times, on)
    most = near.groupBy(key, "form").agg(F.sum("n").alias("most")).join(least, "form").where(enough("most", "least")).select(key, "form")
    left = most.join(marked(forms.select(key, "form"), key, "form"), same(key, "form"), "left_anti")
    rest = near.join(marked(left, key, "form"), same(key, "form"), "left_semi").drop("n")
    hits = rest.join(of_wordings, ["form", *on]).groupBy(key, "wording").agg(F.countDistinct("item_start").alias("matched"))
    wordings = hits.join(sizes.drop("form"), "wording").where(enough("matched", "windows")).select(key, "wording", "matched", "windows")
    return Found(forms, common.written(wordings, "wordings-met"), members, items, sound)


def condemned(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, items, literal, matched, windows, share): one row per contaminated document and class of items, with the
    smallest item of the class and their number; `literal` if only its literal windows find it. Rows grow with documents
    and classes, not with the items of one template."""
    f = search(docs, benchmark, key, item, text)
    of = lambda kind: f.members.groupBy(kind).agg(F.min(item).alias(item), F.count(F.lit(1)).alias("items"))
    rows = [hits.join(of(kind), kind).select(key, item, "items", F.lit(literal).alias("literal"), "matched", "windows", (F.col("matched") / F.col("windows")).alias("share"))
            for hits, kind, literal in ((f.forms, "form", False), (f.wordings, "wording", True))]
    return rows[0].unionByName(rows[1])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, matched, windows, share, changed): condemned() with a row for each item of a class, for those who need the
    pairs; changed tells whether slot values differ from the item's."""
    f = search(docs, benchmark, key, item, text)
    hits = f.forms.join(f.members.select(item, "form"), "form")
    slots = f.items.where("length > 0").select(F.col(item).alias(f"_{item}"), F.col("start").alias("_item_start"), F.col("slots").alias("own"))
    windows = f.sound.join(f.members.select(item, "form"), "form").join(slots, same(item, "item_start"))
    differs = F.exists(F.arrays_zip(F.col("own").alias("a"), F.col("slots").alias("b")), lambda p: p["a"] != p["b"])
    changed = windows.groupBy(key, item).agg(F.max(differs).alias("changed"))
    share = (F.col("matched") / F.col("windows")).alias("share")
    by_form = hits.join(marked(changed, key, item), same(key, item)).select(key, item, "matched", "windows", share, "changed")
    by_wording = f.wordings.join(f.members.select(item, "wording"), "wording").select(key, item, "matched", "windows", share, F.lit(False).alias("changed"))
    return by_form.unionByName(by_wording)


def too_short(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Items that no document is searched for, and why: those with a text but no window (see LEAST_TOKENS, LEAST_LETTERS). As
    single words of the language they would condemn most documents; whoever needs them can ask for them by equality."""
    windows = item_windows(benchmark, item, text).select(F.col(item).alias(f"_{item}")).distinct()
    return benchmark.join(windows, same(item), "left_anti").where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0).select(item, text)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return condemned(docs, common.table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark item stay."""
    f = search(docs, common.table(spark, sf_dir, "benchmark"))
    gone = f.forms.select("doc_id").union(f.wordings.select("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
