"""Byte-pair encoding of whole texts by a lazily determinised transducer, and its streaming inverse.

The merges of a public tokenizer are compiled into a trie of the tokens' bytes and a test of neighbours: two tokens may
stand side by side if and only if encoding their joint bytes gives just these two. An encoding is right if and only if
all its neighbours may stand side by side, and the encoding of a prefix is unique. Reading a text byte by byte, the
non-deterministic machine therefore keeps one item per open token: its place in the trie, the token before it, and the
tokens that are not settled yet. Sets of items, with what all share emitted, are the states of the deterministic
machine; they are made when they are first met. An item lives at most as long as the longest token, so lookahead is bounded.

Texts are cut into pieces by the tokenizer's own pattern inside the JVM; a piece is a path through the machine, and
paths that were walked before are looked up as a whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F, types as T

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"

#: White space as Unicode defines it; Java's \s is ASCII only.
BLANK = "\\t-\\r\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
# Fixed value: the pattern that cuts text before the merges of the byte-level vocabularies.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"

STATES, PATHS = 200_000, 400_000
SLICE = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable bytes for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Compiled merges. `spec` is the content of a byte-level vocabulary file (model.vocab and model.merges)."""

    def __init__(self, spec: bytes):
        model = json.loads(spec)["model"]
        letters = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        used = set(letters) | {a + b for a, b in merges}
        self.bytes_of = {vocab[t]: bytes(letters[c] for c in t) for t in used if t in vocab}
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pair: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.pair[x, y] = i
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = i, x, y
        self.child: dict[int, int] = {}
        self.token = [-1]
        for t, raw in self.bytes_of.items():
            node = 0
            for b in raw:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = t
        self.sound: dict[int, bool] = {}
        self.beside: dict[int, bool] = {}
        self.paths: dict[str, tuple[int, ...]] = {}
        self._forget()

    def _forget(self) -> None:
        """Start with the initial state only; states are derived again when met."""
        self.states: list[tuple[tuple[int, int, tuple[int, ...]], ...]] = [((0, -1, ()),)]
        self.number = {self.states[0]: 0}
        self.step: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _stay_apart(self, a: int, b: int, limit: float) -> bool:
        """No merge of rank below `limit` joins the end of a with the start of b while both are being built.

        Undoes the merges next to the border, latest first; of merges of one rank the left one happened first.
        """
        rank, pair = self.rank, self.pair
        while True:
            m = pair.get((a, b))
            if m is not None and m < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def _sound(self, t: int) -> bool:
        """The encoding of the token's own bytes is the token."""
        got = self.sound.get(t)
        if got is None:
            r = self.rank[t]
            got = r < 0 or self._sound(self.left[t]) and self._sound(self.right[t]) and self._stay_apart(self.left[t], self.right[t], r)
            self.sound[t] = got
        return got

    def _beside(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.beside.get(key)
        if got is None:
            got = self.beside[key] = self._stay_apart(a, b, float("inf"))
        return got

    def _advance(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Derive one transition: the next state and the tokens settled by it."""
        items, whole = [], None
        for node, last, pending in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            items.append((node, last, pending))
            t = self.token[node]
            if whole is None and t >= 0 and self._sound(t) and (last < 0 or self._beside(last, t)):
                whole = (0, t, (*pending, t))
        items.append(whole)  # single bytes are tokens and prefixes have an encoding, so there is one
        shared = os.path.commonprefix([p for _, _, p in items])
        target = tuple((n, last, p[len(shared):]) for n, last, p in items)
        to = self.number.get(target)
        if to is None:
            to = self.number[target] = len(self.states)
            self.states.append(target)
        self.step[state << 8 | byte] = found = to, tuple(shared)
        return found

    def run(self, raw: bytes) -> tuple[int, ...]:
        """Token ids of one piece."""
        if len(self.states) > STATES:
            self._forget()
        state, out, step = 0, [], self.step
        for b in raw:
            got = step.get(state << 8 | b) or self._advance(state, b)
            state = got[0]
            if got[1]:
                out += got[1]
        if raw:
            out += next(p for n, _, p in reversed(self.states[state]) if n == 0)
        return tuple(out)

    def path(self, piece: str) -> tuple[int, ...]:
        got = self.paths.get(piece)
        if got is None:
            if len(self.paths) >= PATHS:
                self.paths.clear()
            got = self.run(piece.encode("utf-8", "surrogatepass"))
            if len(piece) <= 64:
                self.paths[piece] = got
        return got

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, given out as soon as characters are complete."""
        machine = Utf8Machine()
        for i in ids:
            if got := machine.feed(self.bytes_of[i]):
                yield got
        if got := machine.close():
            yield got


class Utf8Machine:
    """Incremental UTF-8 decoder: a state is the number of bytes that are due and the bounds of the next one.

    Ill-formed input gives U+FFFD for each maximal part that could have begun a character.
    """

    def __init__(self):
        self.due, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.due, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.code = 2, b & 0x0F
                self.low, self.high = (0xA0, 0xBF) if b == 0xE0 else (0x80, 0x9F) if b == 0xED else (0x80, 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.due, self.code = 3, b & 0x07
                self.low, self.high = (0x90, 0xBF) if b == 0xF0 else (0x80, 0x8F) if b == 0xF4 else (0x80, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.due, self.low, self.high = self.due, 0, 0x80, 0xBF
        return "�" if left else ""


_compiled: dict[int, Transducer] = {}


def _machine(spec: bytes) -> Transducer:
    """One machine per worker process and vocabulary; it keeps what it learned from task to task."""
    key = hash(spec)
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Transducer(spec)
    return _compiled[key]


def _slices(pieces: pa.ListArray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Rows' numbers of pieces and the pieces, some hundred thousand pieces at a time; one long row stays whole."""
    counts = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
        yield counts[lo:hi], pieces.slice(lo, hi - lo).flatten()
        lo = hi


def _looked_up(machine: Transducer, values: pa.Array) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), [machine.path(p) for p in coded.dictionary.to_pylist()]


def _encode_rows(machine: Transducer, pieces: pa.ListArray) -> pa.Array:
    parts = []
    for counts, values in _slices(pieces):
        index, paths = _looked_up(machine, values)
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        flat = np.fromiter((i for p in paths for i in p), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        until = np.cumsum(each)
        total = int(until[-1]) if len(until) else 0
        ids = flat[np.arange(total) + np.repeat(starts[index] - (until - each), each)]
        offsets = np.concatenate(([0], np.concatenate(([0], until))[np.cumsum(counts)])).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def _count_rows(machine: Transducer, pieces: pa.ListArray) -> pa.Array:
    parts = [np.empty(0, np.int64)]
    for counts, values in _slices(pieces):
        index, paths = _looked_up(machine, values)
        until = np.concatenate(([0], np.cumsum(np.fromiter(map(len, paths), np.int64, len(paths))[index]))) if len(index) else np.zeros(1, np.int64)
        ends = np.cumsum(counts)
        parts.append(until[ends] - until[ends - counts])
    return pa.array(np.concatenate(parts), pa.int64())


def pieces_of(text: Column) -> Column:
    """The pieces of a text in order; none for null and empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


def _spec(spark: SparkSession, tokenizers: str, vocabulary: str):
    with open(os.path.join(tokenizers, vocabulary), "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # the vocabulary file, 1.6 MB, whatever the corpus


def encode(spark: SparkSession, text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Token ids (array<int>) of each text without special tokens; an empty array for empty and for null text.

    Strings of special tokens inside a text are ordinary text. Texts of any length are encoded whole.
    """
    spec = _spec(spark, tokenizers, vocabulary)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(spec.value)
        for pieces in batches:
            yield _encode_rows(machine, pieces)

    return ids(pieces_of(text))


def count(spark: SparkSession, text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Number of token ids of each text (bigint), 0 for empty and for null text."""
    spec = _spec(spark, tokenizers, vocabulary)

    @F.arrow_udf(T.LongType())
    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(spec.value)
        for pieces in batches:
            yield _count_rows(machine, pieces)

    return sizes(pieces_of(text))


def decode(spark: SparkSession, ids: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Text of each list of ids, decoded as a stream; null for a null list, '' for an empty one."""
    spec = _spec(spark, tokenizers, vocabulary)

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _machine(spec.value)
        for rows in batches:
            yield pa.array([None if r is None else "".join(machine.decode(r)) for r in rows.to_pylist()], pa.string())

    return texts(ids)
