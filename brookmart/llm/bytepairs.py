"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder as a machine over bytes.

A merge list applied by rank fixes a token as soon as enough bytes behind it are known. How many are enough follows from
the list alone (`lookahead`), so a word of any length is encoded with a window of constant size: bytes go in, the tokens
that can't change any more come out. Decoding keeps at most three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed value: the splitting pattern of byte-level vocabularies. White space is the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes that a full window emits at least; words of up to KEPT letters are remembered, at most twice MEMORY of them at a time.
STEP, KEPT, MEMORY = 4096, 64, 400_000
#: Letters of the texts whose new words are merged together.
TOGETHER = 2**20
#: Words of up to so many bytes need no heap; the rank of what is no merge.
SHORT, NONE = 24, 2**31


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Known(dict):
    """Ids of words that came before; what is missing is made. When full, the words become the old ones, of which those that
    come again are kept."""

    def __init__(self, make: Callable[[str], Iterable[int]]):
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> Iterable[int]:
        found = self.old.get(word) or tuple(self.make(word))  # tuples of numbers cost the garbage collector nothing
        if len(word) <= KEPT:
            self.add([word], [found])
        return found

    def add(self, words: list[str], found: list[Iterable[int]]) -> None:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self.update(zip(words, found, strict=True))


class Encoder:
    """Compiled merge list. `pairs` maps a pair of ids to (rank, id of the merged token)."""

    def __init__(self, spec: dict):
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE model")
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only texts that aren't normalised and are split by the byte-level pattern")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.ids: dict[str, int] = model["vocab"]
        self.single = [self.ids[c] for c in letters]
        self.bytes: dict[int, bytes] = {}
        for token, n in self.ids.items():
            self.bytes[n] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        made = set(self.single)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = self.ids[a], self.ids[b]
            if left not in made or right not in made:
                raise ValueError(f"merge {rank} comes before one that makes its parts")
            self.pairs.setdefault((left, right), (rank, self.ids[a + b]))
            made.add(self.ids[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.made = dict(self.pairs.values())
        keys = np.array([a << 20 | b for a, b in self.ranks] or [-1], "int64")
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([*self.ranks.values()] or [NONE], "int64")[order]
        self.made_by_rank = np.zeros(len(model["merges"]) + 1, "int64")
        self.made_by_rank[list(self.made)] = list(self.made.values())
        self.added: dict[str, int] = {}
        for t in spec.get("added_tokens") or []:
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError("added tokens that look at their neighbours")
            self.added[t["content"]] = t["id"]
            self.bytes.setdefault(t["id"], bytes(byte_of[c] for c in t["content"]) if all(c in byte_of for c in t["content"]) else t["content"].encode())
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.known = _Known(self.word)
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes behind a token's end after which nothing that follows can change it.

        Take a text and the same text with more behind it, and apply the merges rank by rank to both. Where they first
        differ moves to the left only by a merge (u, v) that one of them makes across that place, and by the length of u.
        The next merge that moves it, of a later rank, must have a right part that begins with u, with u on its left spine.
        So the way to the left is at most the longest chain of such merges, each counted with the length of its left part.
        """
        first: dict[int, int] = {}  # left part of each token
        best: dict[int, int] = {}  # of the merges so far: the longest chain that ends with this left part
        longest = 0
        for (u, v), (_, made) in self.pairs.items():  # in order of rank
            chain, t = 0, v
            while True:
                chain = max(chain, best.get(t, 0))
                if t not in first:
                    break
                t = first[t]
            reach = chain + len(self.bytes[u])
            best[u] = max(best.get(u, 0), reach)
            longest = max(longest, reach)
            first.setdefault(made, u)
        return longest

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a bounded piece: the pair of the least rank first, the leftmost of equals."""
        pairs, tokens = self.pairs, [self.single[b] for b in piece]
        n = len(tokens)
        if n <= SHORT:
            return self._few(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], k, found[1]) for k in range(n - 1) if (found := pairs.get((tokens[k], tokens[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, k, made = heapq.heappop(heap)
            right = after[k]
            if tokens[k] < 0 or right >= n or pairs.get((tokens[k], tokens[right]), (-1,))[0] != rank:
                continue
            tokens[k], tokens[right] = made, -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if found := pairs.get((made, tokens[right])):
                    heapq.heappush(heap, (found[0], k, found[1]))
            left = before[k]
            if left >= 0 and (found := pairs.get((tokens[left], made))):
                heapq.heappush(heap, (found[0], left, found[1]))
        return [t for t in tokens if t >= 0]

    def _few(self, tokens: list[int]) -> list[int]:
        """The same for a few tokens: ranks of neighbours in a list."""
        ranks = self.ranks.get
        found = list(map(ranks, zip(tokens, tokens[1:]), repeat(NONE)))  # noqa: B905
        while found and (least := min(found)) < NONE:
            k = found.index(least)
            made = tokens[k] = self.made[least]
            del found[k], tokens[k + 1]
            if k:
                found[k - 1] = ranks((tokens[k - 1], made), NONE)
            if k < len(found):
                found[k] = ranks((made, tokens[k + 1]), NONE)
        return tokens

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; NONE where they don't merge."""
        pair = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.key_ranks[at], NONE)

    def merged_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """merged() of many short pieces, a merge of every piece at a time."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda k: len(pieces[k]))
        single = np.array(self.single, "int64")
        for start in range(0, len(order), 4096):  # of similar length
            rows = np.array(order[start : start + 4096])
            width = max(len(pieces[k]) for k in rows)
            if not width:
                continue
            raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width)
            sizes = np.array([len(pieces[k]) for k in rows])
            tokens = np.where(np.arange(width) < sizes[:, None], single[raw], -1)
            ranks = np.full((len(rows), width), NONE)
            ranks[:, :-1] = np.where(tokens[:, 1:] >= 0, self._rank(tokens[:, :-1], tokens[:, 1:]), NONE)
            place = np.arange(width)
            while len(rows):
                k = ranks.argmin(axis=1)  # the leftmost of the least
                line = np.arange(len(rows))
                least = ranks[line, k]
                done = least == NONE
                if done.any():
                    for row, found, n in zip(rows[done].tolist(), tokens[done].tolist(), sizes[done].tolist(), strict=True):
                        out[row] = tuple(found[:n])
                    go = ~done
                    rows, tokens, ranks, sizes, k, least = rows[go], tokens[go], ranks[go], sizes[go], k[go], least[go]
                    line = np.arange(len(rows))
                    if not len(rows):
                        break
                later = np.minimum(place + (place > k[:, None]), width - 1)
                tokens = np.take_along_axis(tokens, later, 1)
                ranks = np.take_along_axis(ranks, np.minimum(place + (place >= k[:, None]), width - 1), 1)
                sizes -= 1
                tokens[line, k] = self.made_by_rank[least]
                ranks[:, -1] = NONE
                left = line[k > 0]
                ranks[left, k[left] - 1] = self._rank(tokens[left, k[left] - 1], tokens[left, k[left]])
                right = line[k + 1 < sizes]
                ranks[right, k[right]] = self._rank(tokens[right, k[right]], tokens[right, k[right] + 1])
                last = line[k + 1 >= sizes]
                ranks[last, k[last]] = NONE
        return out

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one word that comes in pieces. What a window of lookahead + STEP bytes has fixed is emitted; the window
        goes on at the end of the last token emitted, and no token crosses that place, so it starts anew there."""
        window = bytearray()
        full = self.lookahead + STEP
        for chunk in chunks:
            window += chunk
            while len(window) >= full:
                end, done = 0, bytes(window[:full])
                for t in self.merged(done):
                    if end + len(self.bytes[t]) > full - self.lookahead:
                        break
                    end += len(self.bytes[t])
                    yield t
                if not end:  # a token longer than STEP: look further
                    full += STEP
                    continue
                del window[:end]
                full = self.lookahead + STEP
        yield from self.merged(bytes(window))

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        return self.merged(raw) if len(raw) <= STEP else list(self.stream(raw[k : k + STEP] for k in range(0, len(raw), STEP)))

    def learn(self, words: Iterable[str]) -> None:
        """Makes the short ones of these words known together."""
        new = [w for w in set(words) - self.known.keys() if w not in self.known.old and len(w) <= SHORT]
        if len(new) >= 64:
            raws = [w.encode() for w in new]
            self.known.add(new, self.merged_many(raws))

    def encode(self, text: str, out: list[int]) -> None:
        """Appends the ids of a text; added tokens are found first, the longest at a place."""
        at = 0
        for m in self.cut.finditer(text) if any(t in text for t in self.added) else ():
            self._plain(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        self._plain(text[at:] if at else text, out)

    def encode_all(self, texts: list[str], out: list[int]) -> list[int]:
        """encode() of some texts; the length of `out` after each. Words that are new to them are merged together."""
        plain = [None if any(a in t for a in self.added) else self.words.findall(t) for t in texts]
        self.learn(chain.from_iterable(filter(None, plain)))
        ends = []
        for t, words in zip(texts, plain, strict=True):
            if words is None:
                self.encode(t, out)
            else:
                out.extend(chain.from_iterable(map(self.known.__getitem__, words)))
            ends.append(len(out))
        return ends

    def _plain(self, text: str, out: list[int]) -> None:
        out.extend(chain.from_iterable(map(self.known.__getitem__, self.words.findall(text))))


class Decoder:
    """Text of token ids, fed piece by piece: whole characters go out, the bytes of an unfinished one wait. Bytes that are no
    UTF-8 become U+FFFD, one for each maximal part; ids that the vocabulary lacks are skipped."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        machine, known, none, ids = codecs.getincrementaldecoder("utf-8")("replace"), self.tokens.get, repeat(b""), iter(ids)
        while part := list(islice(ids, STEP)):
            yield machine.decode(b"".join(map(known, part, none)))
        yield machine.decode(b"", True)


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer's file, read on the driver and sent to the tasks once: a file of fixed size, not data."""
    return spark.sparkContext.broadcast(load(path))


#: Compiled once in a Python worker.
_compiled: dict[int, Encoder] = {}


def _encoder(sent) -> Encoder:
    key = id(sent.value)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Encoder(sent.value)
    return _compiled[key]


def _extended(df: DataFrame, source: str, out: str, kind: str, run: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with one more column (or `out` replaced) made from another, batch by batch; the others pass as they are."""
    kept = [c for c in df.columns if c != out]
    if source in kept:
        work, place = df.select(*(F.col(f"`{c}`") for c in kept)), kept.index(source)
    else:  # out replaces its own source: it goes last
        work, place = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{source}`")), len(kept)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields[: len(kept)]), f"`{out}` {kind}"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], run(b.column(place))], names=[*kept, out])

    return work.mapInArrow(batches, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df and the token ids of its texts (array of int). A null text counts as empty and has no ids; bytes that aren't UTF-8
    count as U+FFFD. Other columns, whatever they are called, stay; repeated rows are encoded each."""
    common.small_batches(df.sparkSession)
    sent = vocabulary(df.sparkSession, path)

    def run(texts: pa.Array) -> pa.Array:
        encoder, ids, ends, batch = _encoder(sent), [], [0], []
        for raw in [*texts.cast(pa.binary()), None]:
            if raw is not None:
                batch.append((raw.as_py() or b"").decode("utf-8", "replace"))
            if batch and (raw is None or sum(map(len, batch)) >= TOGETHER):
                ends += encoder.encode_all(batch, ids)
                batch = []
        return pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.array(ids, "int32")))

    return _extended(df, text, out, "array<int>", run)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df and the texts of its ids. Null ids, alone or as a whole array, count as absent: an array of none gives an empty text."""
    common.small_batches(df.sparkSession)
    sent = vocabulary(df.sparkSession, path)

    def run(lists: pa.Array) -> pa.Array:
        decoder, values, ends = _decoder(sent), lists.values, lists.offsets.to_pylist()
        values = values.to_pylist() if values.null_count else values.to_numpy().tolist()  # the latter is ten times as fast
        return pa.array(["".join(decoder.feed(values[a:b])) for a, b in zip(ends, ends[1:])], pa.string())  # noqa: B905

    return _extended(df, ids, out, "string", run)


_decoders: dict[int, Decoder] = {}


def _decoder(sent) -> Decoder:
    key = id(sent.value)
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(_encoder(sent).bytes)
    return _decoders[key]


def default_path() -> str:
    """The public vocabulary of the box; a caller names any other file of the kind."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every whole text, decodes what came out, and returns the digests of both."""
    path = default_path()
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode(docs, path).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"))
    return decode(ids, path, out="decoded").select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
