"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into machines: the normaliser (one state; a space becomes the mark ▁, everything else stays, and
one mark is put in front), the pieces (a trie whose final states put out a piece's id at the weight -score) and byte
fallback (a character without a piece goes through arcs that put out its UTF-8 bytes, at a weight above that of any
piece). Normaliser and pieces are composed when the model is compiled: the result reads raw text. It is composed with
each input as far as states are reached, and the shortest path in the tropical semiring (least sum of weights) is the
encoding. For BPE models one more machine, an acceptor of pairs, is composed too: two pieces may follow each other exactly
if merging their joined text gives them back. A state of the composition is then a place and the piece that ends there,
and paths of such pairs are merge results, so the shortest path equals what merging by rank gives, not just what the
weights favour. Unigram models go without that machine.

A model with a character map of its own (or that drops extra spaces) has its normaliser compiled from it; as its rules look
ahead, it runs over the input before the composed machines.

A text falls apart where no piece can lie: before each run of marks, at line ends, and, if the model has no piece with
both, between Latin letters and other characters. Equal segments are encoded once per task.

Defined results: null text is empty text: no ids, decoded to the empty text; bytes that aren't UTF-8 become U+FFFD
first; a text with the mark itself decodes to a space there, which `round_trip` tells; repeated rows are encoded alike,
and null ids stay null; an empty table gives no rows; other columns aren't read. Texts of any length are encoded whole:
a segment is as long as a word, in the worst case (one run without a space) as the text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .normaliser import Normaliser

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Segments and pairs that a task remembers.
REMEMBERED = 500_000
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Weight of one byte of a character without a piece, above that of any piece.
BYTE_WEIGHT = 1e12


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message in the protocol buffer wire format; fixed-size values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


#: The normaliser's arcs that change their character; all others put out what they read.
NORMALISER = {" ": MARK, MARK: MARK}


def trie(pieces: dict[str, int]) -> tuple[list[dict[str, int]], list[int]]:
    """(arcs of each state, id that a final state puts out, or -1); state 0 is the start."""
    arcs: list[dict[str, int]] = [{}]
    final = [-1]
    for p, i in pieces.items():
        state = 0
        for c in p:
            if c not in arcs[state]:
                arcs[state][c] = len(arcs)
                arcs.append({})
                final.append(-1)
            state = arcs[state][c]
        final[state] = i
    return arcs, final


def composed(changes: dict[str, str], arcs: list[dict[str, int]], final: list[int]) -> tuple[list[dict[str, int]], list[int]]:
    """Composition of a one-state transducer with a trie: its arcs read what the transducer reads."""
    reads: dict[str, list[str]] = {}
    for a, b in changes.items():
        reads.setdefault(b, []).append(a)
    return [{a: to for c, to in out.items() for a in reads.get(c, [] if c in changes else [c])} for out in arcs], final


def linked(arcs: list[dict[str, int]], final: list[int]) -> dict[str, tuple]:
    """The start state; a state is a dictionary from what is read to (what the next state puts out or -1, next state)."""
    states: list[dict[str, tuple]] = [{} for _ in arcs]
    for state, out in zip(states, arcs, strict=True):
        state.update((c, (final[to], states[to])) for c, to in out.items())
    return states[0]


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe, spec = False, {}
        for n, v in fields(model):
            if n == 1:
                p = dict(fields(v))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif n == 2:
                self.bpe = dict(fields(v)).get(3, 1) == 2
            elif n == 3:
                spec |= dict(fields(v))
        charsmap, self.prefix, tidy = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if any(t == USER for *_, t in self.pieces):
            raise ValueError("models with user-defined pieces aren't read")
        self.normalise = Normaliser(charsmap, tidy) if charsmap or tidy else None
        self.byte = [0] * 256
        self.weight = [-s for _, s, _ in self.pieces]
        self.raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        for i, (p, _, kind) in enumerate(self.pieces):
            self.raw.append(b"" if kind == CONTROL else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode())
            if kind == BYTE:
                self.byte[int(p[3:5], 16)] = i
            elif kind == NORMAL:
                self.ids[p] = i
        self.start = linked(*composed(NORMALISER, *trie(self.ids)))
        self.fallback: dict[str, tuple[float, list[int]]] = {}
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece holds a mark after another character")
        meet = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False) if MARK not in (a, b)}
        latin = re.compile(f"[{LATIN}]").match
        mixed = any(bool(latin(a)) != bool(latin(b)) for a, b in meet)
        apart = "\n" if not any("\n" in p for p in self.ids) else ""
        marks = "".join(a for a, b in NORMALISER.items() if b == MARK)
        runs = f"[{marks}]*[^{marks}{apart}]+" if mixed else f"[{marks}]*[{LATIN}]+|[{marks}]*[^{LATIN}{marks}{apart}]+"
        self.cut = re.compile(f"{runs}|[{marks}]+" + (f"|{apart}" if apart else ""))
        self.cost = {p: self.weight[i] for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[int]:
        """Ids that merging adjacent symbols, best score first and leftmost of equals, ends with."""
        symbols, cost, none = list(text), self.cost.get, float("inf")
        found = [cost(a + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
        while found and (best := min(found)) < none:
            k = found.index(best)
            symbols[k] += symbols.pop(k + 1)
            del found[k]
            if k:
                found[k - 1] = cost(symbols[k - 1] + symbols[k], none)
            if k < len(found):
                found[k] = cost(symbols[k] + symbols[k + 1], none)
        return [self.ids.get(s, -1) for s in symbols]

    def follows(self, a: int, b: int) -> bool:
        """The acceptor of pairs."""
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self.merged(self.pieces[a][0] + self.pieces[b][0]) == [a, b]
        return ok

    def bytes_of(self, c: str) -> tuple[float, list[int]]:
        """The fallback arcs of a character, joined: weight and output."""
        data = c.encode()
        out = self.fallback[c] = len(data) * BYTE_WEIGHT, [self.byte[b] for b in data]
        return out

    def shortest_path(self, segment: str) -> bytes:
        """Ids of a segment of raw text, as little-endian 32-bit numbers. The states of the composition are relaxed place
        by place: reached[j] maps what the acceptor of pairs must know (the last piece; -1 for none) to the least weight
        so far, the place and state before, and the output."""
        n, start, weight, bpe, known = len(segment), self.start, self.weight, self.bpe, self.pairs.get
        reached: list[dict[int, tuple] | None] = [{-1: (0.0, -1, -1, -1)}, *[None] * n]
        for i in range(n):
            here = reached[i]
            if here is None:
                continue
            prior = [(last << 32 if bpe and last >= 0 else -1, last, path[0]) for last, path in here.items()]
            arc, j = start.get(segment[i]), i
            if arc is None or arc[0] < 0:
                more = (self.fallback.get(segment[i]) or self.bytes_of(segment[i]))[0]
                there = reached[i + 1] = reached[i + 1] or {}
                for _, last, cost in prior:
                    if -1 not in there or cost + more < there[-1][0]:
                        there[-1] = (cost + more, i, last, -1)
            while arc is not None:
                j += 1
                piece, state = arc
                if piece >= 0:
                    for pair, last, cost in prior:
                        if pair >= 0:
                            ok = known(pair | piece)
                            if ok is None:
                                ok = self.follows(last, piece)
                            if not ok:
                                continue
                        total, to, there = cost + weight[piece], piece if bpe else -1, reached[j]
                        if there is None:
                            reached[j] = {to: (total, i, last, piece)}
                        elif to not in there or total < there[to][0]:
                            there[to] = (total, i, last, piece)
                arc = state.get(segment[j]) if j < n else None
        out: list[int] = []
        j, state = n, min(reached[n], key=lambda k: reached[n][k][0])
        while j:
            _, i, before, piece = reached[j][state]
            out += [piece] if piece >= 0 else reversed(self.fallback[segment[i]][1])
            j, state = i, before
        return struct.pack(f"<{len(out)}i", *reversed(out))

    def encode(self, text: str) -> bytes:
        if self.normalise:
            text = self.normalise(text)
        if not text:
            return b""
        segments = self.cut.findall(" " + text if self.prefix else text)
        out = list(map(self.known.get, segments))
        if None in out:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for k, s in enumerate(segments):
                if out[k] is None:
                    out[k] = self.known.get(s) or self.shortest_path(s)
                    if len(s) < 64:
                        self.known[s] = out[k]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<i4").tolist()]).decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def load(path: str = MODEL) -> bytes:
    """The model file's bytes, read on the driver and sent with the tasks; a tokenizer file has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, n_tokens, ids, round_trip): ids as an array of ints; round_trip tells whether they decode to the text."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compiled(sent.value)
        for b in batches:
            ids = [t.encode(bytes(d).decode(errors="replace")) for d in b["payload"]]
            back = [t.decode(i).encode() == bytes(d) for i, d in zip(ids, b["payload"], strict=True)]
            yield pd.DataFrame({key: b[key], "n_tokens": [len(i) // 4 for i in ids], "ids": [np.frombuffer(i, "<i4") for i in ids], "round_trip": back})

    return common.map_rows(docs, key, {"payload": common.utf8(text)}, run, "n_tokens long, ids array<int>, round_trip boolean")


def decode(ids: DataFrame, column: str = "ids", model: str = MODEL) -> DataFrame:
    """Adds column `decoded`."""
    sent = ids.sparkSession.sparkContext.broadcast(load(model))

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        t = compiled(sent.value)
        return pd.Series([None if v is None else t.decode(np.asarray(v, "<i4").tobytes()) for v in values], dtype=object)

    return ids.withColumn("decoded", text(column))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """(key, n_tokens, ids_sha256 of the ids as little-endian 32-bit numbers, decoded_sha256, round_trip), in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = compiled(sent.value)
        for b in batches:
            rows = []
            for k, d in zip(b[key], b["payload"], strict=True):
                data = bytes(d)
                ids = t.encode(data.decode(errors="replace"))
                back = t.decode(ids).encode()
                rows.append((k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == data))
            yield pd.DataFrame(rows, columns=[key, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return common.map_rows(docs, key, {"payload": common.utf8(text)}, run, "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document encoded, and decoded again as a test. Rows as encode() has them."""
    return encode(docs)
