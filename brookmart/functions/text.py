"""Table function that splits search phrases into words."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters or digits of scripts that put spaces between words, or single ideographs.
_WORD = r"(?:[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+)|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"


#: Words of a text that go to Python at once.
SLICE = 32


class Automaton:
    """All entries of a word list in one pass over a text: a trie whose nodes know where to go on when a character doesn't fit
    (the longest proper suffix that is in the trie) and the lengths of all entries that end there."""

    def __init__(self, entries: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for w in sorted(set(entries)):
            node = 0
            for c in w:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                node = self.next[node][c]
            if w:
                self.ends[node] = (len(w),)
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for c, child in self.next[node].items():
                back = self.back[node]
                while back and c not in self.next[back]:
                    back = self.back[back]
                self.back[child] = self.next[back].get(c, 0)
                self.ends[child] += self.ends[self.back[child]]
                queue.append(child)

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every entry at every place, overlaps included."""
        node, step, back, ends = 0, self.next, self.back, self.ends
        for k, c in enumerate(text, 1):
            while node and c not in step[node]:
                node = back[node]
            node = step[node].get(c, 0)
            for n in ends[node]:
                yield k - n, k


def tokenize(df: DataFrame, text: str, lexicon: Iterable[str] | None = None, out: str = "keyword", compounds: bool = False, rest: bool = True) -> DataFrame:
    """One row per word of `text`; other columns stay. Without a lexicon a run of an unspaced script is one word; with
    one it is split as finely as the lexicon allows: every entry found in the run, and single characters in no entry
    (unless not `rest`). `compounds` splits the runs of spaced scripts too. The lexicon is compiled once and sent to the
    tasks; it is the caller's word list, of a size that fits a worker."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({_WORD})"), 1)
    if lexicon is None:
        return df.withColumn(out, F.explode(words))
    sent = df.sparkSession.sparkContext.broadcast(Automaton(w.lower() for w in lexicon))

    @F.pandas_udf("array<string>")
    def fine(runs: pd.Series) -> pd.Series:
        automaton = sent.value
        return pd.Series([[w for run in r for w in _split(run, automaton, compounds, rest)] for r in runs], dtype=object)

    # a batch of whole texts would be as large as they are; in slices it holds a bounded number of words
    pieces = F.expr(f"transform(sequence(0, greatest(size(_words) - 1, 0), {SLICE}), k -> slice(_words, k + 1, {SLICE}))")
    rows = df.withColumn("_words", F.explode(F.array(words))).withColumn("_words", F.explode(pieces))  # exploded, so that the words are found once
    return rows.withColumn(out, F.explode(fine("_words"))).drop("_words")


def _split(run: str, automaton: Automaton, compounds: bool = False, rest: bool = True) -> list[str]:
    if not compounds and (run.isascii() or not any("\u0e00" <= c <= "\u0e7f" or c >= "\u3040" for c in run)):
        return [run]
    found, covered = [], bytearray(len(run))
    for s, e in automaton.find(run):
        found.append((s, -e))
        covered[s:e] = b"\1" * (e - s)
    if rest:
        found += [(k, -k - 1) for k in range(len(run)) if not covered[k]]
    return [run[s:-e] for s, e in sorted(found)]
