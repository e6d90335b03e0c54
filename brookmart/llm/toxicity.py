"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the hits' context windows.

The lexicon has the words and word beginnings that the training documents mark, those found in a far larger share of
toxic than of other documents, and the caller's own words, if any; a word stands beside its beginning, since beginnings
are taken as they are and only words with errors. It is compiled into a trie; the trie is intersected with the
Levenshtein automaton (one error for words of five letters or more) and made deterministic on demand, so that a word
costs a few table steps. Every hit is weighed by its window: quotation marks and words of reporting, or direct address.
A logistic regression on the whole text's hit counts gives the score.

Training takes at most TRAINING_ROWS labelled rows (smallest id hash) of the training folds. Defined results: null text
is empty text; texts without words have no hits and get the score of clean text; texts of any length are scored whole;
without labels the caller's words alone decide, and without those all rows score alike; repeated rows and rows with null ids are scored alike; an empty table gives no
rows; other columns, of whatever names, aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAINING_ROWS = 8000
#: Weight of the caller's words that no label speaks of.
GIVEN = 6.0
REPORTING = frozenset("said says wrote called quote quoted quotes according dijo dit sagte schrieb word term".split())
ADDRESS = frozenset("you your youre du dein deine tu tes ton vous tú usted eres".split())
#: Words to each side of a hit that are looked at.
WINDOW = 6
WORD = re.compile(r"[^\W_]+")
QUOTES = re.compile(r"[\"“”„«»‹›]")
STEM = range(5, 9)
#: Letters of the shortest word that is learnt: shorter ones are within an error or two of most others.
LETTERS = 3


@dataclass(frozen=True)
class Term:
    text: str
    weight: float
    stem: bool = False


class Lexicon:
    """Trie x Levenshtein automaton. find(word) gives (weight, errors) of the best term, or None."""

    def __init__(self, terms: Iterable[Term]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[float, int, bool]]] = [[]]
        for t in sorted(terms, key=lambda t: (t.stem, t.text)):
            node = 0
            for c in t.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append((t.weight, 0 if t.stem or len(t.text) < 5 else 1, t.stem))
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[float, int] | None] = []
        self.sure: list[tuple[float, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo = list(pairs)
        while todo:  # a letter of the term may be missing in the word
            node, errors = todo.pop()
            if errors < 1:
                for child in self.children[node].values():
                    if (child, errors + 1) not in pairs:
                        pairs.add((child, errors + 1))
                        todo.append((child, errors + 1))
        state = frozenset(p for p in pairs if p[1] == 0 or (p[0], 0) not in pairs)
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            ends = [(e[0], errors, e[2]) for node, errors in state for e in self.ends[node] if errors <= e[1]]
            best = lambda found: min(((w, x) for w, x, _ in found), key=lambda f: (f[1], -f[0]), default=None)
            self.accepts.append(best(ends))
            self.sure.append(best([e for e in ends if e[2]]))
        return self.number[state]

    def _step(self, state: int, c: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, errors in self.states[state]:
            if c in self.children[node]:
                pairs.add((self.children[node][c], errors))
            if errors < 1:
                pairs.add((node, 1))
                pairs.update((child, 1) for child in self.children[node].values())
        to = self._state(pairs) if pairs else -1
        self.steps[state][c] = to
        return to

    def find(self, word: str) -> tuple[float, int] | None:
        state, stem = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return stem
            stem = stem or self.sure[state]
        return self.accepts[state] or stem


HITS = ("strong", "fuzzy", "weak", "quoted", "addressed", "weight")


def hits(text: str, lexicon: Lexicon, known: dict[str, tuple[float, int] | None]) -> tuple[int, list[float]]:
    """Number of words, and the counts named in HITS over the whole text."""
    lower = text.lower()
    words = WORD.findall(lower)
    marked = {}
    for w in set(words):
        if w in known:
            h = known[w]
        else:
            if len(known) > 500_000:
                known.clear()
            h = known[w] = lexicon.find(w)
        if h:
            marked[w] = h
    out = [0.0] * len(HITS)
    if not marked:
        return len(words), out
    spots = [m.span() for m in WORD.finditer(lower)]
    for i, w in enumerate(words):
        if w not in marked:
            continue
        weight, errors = marked[w]
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        s, e = spots[i]
        before, after = QUOTES.search(lower, max(0, s - 40), s), QUOTES.search(lower, e, e + 40)
        quoted = bool(before and after) or not REPORTING.isdisjoint(near)
        out[1 if errors else 0 if weight >= 3.5 else 2] += 1
        out[3] += quoted
        out[4] += not ADDRESS.isdisjoint(near)
        out[5] += weight * (0.5 if quoted else 1)
    return len(words), out


def numbers(n_words: int, counts: list[float]) -> list[float]:
    rate = [100 * c / max(n_words, 20) for c in counts]
    return [math.log1p(counts[0]), math.log1p(counts[1]), math.log1p(counts[2]), min(rate[0], 5), min(rate[1], 5), min(rate[2], 5),
            min(rate[5], 20) / 4, min(rate[3], 5), min(rate[4], 5), float(counts[0] + counts[1] > 0), float(counts[2] > 1), float(rate[2] > 1.2), float(rate[0] > 1)]


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document counts of words and word beginnings, by label; the sample's bound is this counter's bound too."""
    n: Counter = Counter()
    for b in batches:
        for data, label in zip(b["payload"], b["label"], strict=True):
            words = set(WORD.findall(bytes(data).decode(errors="replace").lower()))
            n.update((w, False, int(label)) for w in words if len(w) >= LETTERS)
            n.update((p, True, int(label)) for p in {w[:k] for w in words for k in STEM if len(w) >= k})
            n[("", False, int(label))] += 1
    keys = list(n)
    for s in range(0, len(keys), 10_000):
        part = keys[s : s + 10_000]
        yield pd.DataFrame({"term": pd.Series([k[0] for k in part], dtype=object), "stem": [k[1] for k in part], "label": [k[2] for k in part], "n": [n[k] for k in part]})


def learn_terms(sample: DataFrame, least: int = 6, odds: float = 4.0, limit: int | None = None) -> list[Term]:
    """Terms in at least `least` toxic documents whose share of them is `odds` times that of others, ranked by likelihood
    ratio. The sample bounds how many there are; a limit keeps the first so many words, and so many of the beginnings
    that are left after merging."""
    rows = sample.mapInPandas(_terms, "term string, stem boolean, label int, n long")
    n = rows.groupBy("term", "stem").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    n = common.written(n.where((F.col("a") >= least) | (F.col("term") == "")), "term-counts")
    total = n.where("term = ''").collect()
    if not total or not total[0]["a"] or not total[0]["b"]:
        return []
    toxic, other = float(total[0]["a"]), float(total[0]["b"])
    share = (F.col("a") + 0.5) / (toxic + 1)
    ratio = share / ((F.col("b") + 0.5) / (other + 1))
    top = n.where((F.col("term") != "") & (F.col("a") >= least)).withColumn("ratio", ratio).where(F.col("ratio") >= odds)
    top = top.where((F.col("a") >= 3 * least) | (F.col("ratio") >= 3 * odds)).withColumn("rank", F.col("a") * F.log("ratio"))
    top = top.orderBy(F.desc("rank"), "term", "stem").collect()  # words of the bounded sample
    stems = {r["term"]: r["a"] for r in top if r["stem"]}
    words = {r["term"]: r["a"] for r in top if not r["stem"]}
    merged = {t[:k] for t, a in stems.items() for k in range(STEM[0], len(t)) if a >= 0.95 * stems.get(t[:k], math.inf)}
    # a beginning that only one word has is that word
    merged |= {t for t, a in stems.items() if words.get(t, 0) >= 0.9 * a}
    term = lambda r: Term(r["term"], round(math.log(r["ratio"]), 6), r["stem"])
    return [term(r) for r in top if not r["stem"]][:limit] + [term(r) for r in top if r["stem"] and r["term"] not in merged][:limit]


@dataclass
class Model:
    terms: list[Term]
    weights: np.ndarray


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Newton steps; the intercept is last. Without both labels: the counts of strong hits alone."""
    if len(np.unique(y)) < 2:
        w = np.zeros(len(numbers(0, [0.0] * len(HITS))) + 1)
        w[0], w[1], w[-1] = 4.0, 3.0, -2.0
        return w
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = TRAINING_ROWS, folds: int = 5, held: int = 0, words: Iterable[str] = ()) -> Model:
    """A model from the labelled rows of the folds but `held`, and the caller's words."""
    common.small_batches(docs.sparkSession)
    sample = common.labelled(docs, labels, "toxic", common.fold(key, folds) != held, rows, key).select("payload", F.col("label").cast("int").alias("label"))
    sample, path = common.stored(sample, "toxic-sample")  # texts are read once to learn, and once to score
    learned = learn_terms(sample)
    seen = {t.text for t in learned}
    terms = learned + [Term(w, GIVEN) for w in sorted({w.lower() for w in words if w} - seen)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, known = Lexicon(terms), {}
        for b in batches:
            yield pd.DataFrame({"x": [numbers(*hits(bytes(d).decode(errors="replace"), lexicon, known)) for d in b["payload"]], "label": b["label"].to_numpy()})

    got = sample.mapInPandas(run, "x array<double>, label int").toPandas()
    common.discard(docs.sparkSession, path)
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(numbers(0, [0.0] * len(HITS))))
    order = np.lexsort((*x.T, got["label"].to_numpy())) if len(got) else []
    return Model(terms, _logistic(x[order], got["label"].to_numpy(np.float64)[order]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, hits named in HITS, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        lexicon, known = Lexicon(m.terms), {}
        for b in batches:
            found = [hits(bytes(d).decode(errors="replace"), lexicon, known) for d in b["payload"]]
            x = np.array([numbers(*f) for f in found])
            out = pd.DataFrame([[n, *c] for n, c in found], columns=["n_words", *HITS]).astype({"n_words": "int64"})
            out.insert(0, key, b[key].to_numpy())
            yield out.assign(score=1 / (1 + np.exp(-(x @ m.weights[:-1] + m.weights[-1]))) if len(found) else [])

    fields = ", ".join(f"{h} double" for h in HITS)
    return common.map_rows(docs, key, {"payload": common.utf8(text)}, run, f"n_words long, {fields}, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
