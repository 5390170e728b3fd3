"""Byte-level BPE encoding and decoding.

A piece that is not itself a token is encoded by backtracking over the tokens that an Aho-Corasick automaton finds in
it (bytes are mapped to Latin-1, which pyahocorasick takes as text). At every place the longest token is tried first.
It fits if it is compatible with the token before it: merging the bytes of the two by rank gives back just these two.
That test is memoised, and a place from which no encoding leads on is marked and never entered again, so the work is
linear in the length of the piece. A sequence of tokens whose neighbours are all compatible is the result of the merges.

Texts are cut at blanks before the pattern is applied: a blank starts a new match of the pattern, unless it is amid
white space (see _AMID). So most of a text is looked up in a memo of bounded size, word by word.

Defined results: a null text is the empty text and has no ids; null doc_ids and repeated rows are kept as they are; other
columns pass through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: A blank that does not start a match of its own: white space before it and no word after it.
_AMID = re.compile(r"\s (?!\S)")
_MARKS = frozenset(",.;:!?")
MEMO = 400_000
LONG = 64
SLICE = 512


def _pack(code: str):
    """Ids as little-endian unsigned integers; for few ids faster than an array of numpy."""
    return lambda ids: struct.pack(f"<{len(ids)}{code}", *ids)


_PACK = {code: _pack(code) for code in "HI"}


class _Memo(dict):
    """Results by key, computed when missing. When it holds half of ``most``, these become the old half, of which what is met again
    is taken over; so keys that are met once don't push out the others."""

    def __init__(self, compute, most: int = MEMO):
        super().__init__()
        self.compute, self.half, self.old = compute, most // 2, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONG:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


_WORKER: dict[str, object] = {}


def per_worker(key: str, make):
    """What ``make()`` gives, kept by this worker process for the tasks to come; one object at a time."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def forget(key: str) -> None:
    """Let this worker's object of that key forget what it remembers of texts."""
    if key in _WORKER:
        _WORKER[key].forget()


@contextmanager
def without_collector() -> Iterator[None]:
    """Encoding makes very many short-lived lists and no cycles; looking for cycles among the memos' entries costs a tenth of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def fingerprint(*things) -> str:
    return hashlib.sha256(repr(things).encode()).hexdigest()


class _Words(_Memo):
    """Ids of words that follow a blank, blank and all."""

    def __init__(self, splitter: PatternSplitter, encode_word, most: int):
        super().__init__(None, most)
        self.splitter, self.encode_word = splitter, encode_word

    def __missing__(self, w: str) -> bytes:
        value = self.old.pop(w, None)
        if value is None:
            # A blank and letters alone are one match of the pattern; so are a mark that ends the word, and a line's end amid it.
            if w.isalpha():
                value = self.encode_word(w)
            elif w[-1:] in _MARKS and w[:-1].isalpha():
                value = self[w[:-1]] + self.splitter.pieces[w[-1]]
            else:
                head, line, tail = w.partition("\n")
                if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
                    value = self[head] + self.splitter.pieces[line] + self.splitter.first[tail]
                else:
                    value = self.splitter.whole(" " + w)
        if len(w) <= LONG:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[w] = value
        return value


class PatternSplitter:
    """Encodes texts by pieces: ``encode_piece`` gives the ids of one match of ``pattern`` as bytes, ``encode_word`` those of a blank and
    letters. ``memo``: words that are remembered."""

    def __init__(self, pattern: str, encode_piece, encode_word=None, memo: int = MEMO):
        import regex

        find = regex.compile(pattern).findall
        self.pieces = pieces = _Memo(encode_piece, memo // 2)
        self.whole = lambda text: b"".join(map(pieces.__getitem__, find(text)))
        self.first = _Memo(lambda text: pieces[text] if text.isalpha() else self.whole(text), memo // 4)
        self.after_blank = _Words(self, encode_word or (lambda w: encode_piece(" " + w)), memo)

    def forget(self) -> None:
        for memo in (self.pieces, self.first, self.after_blank):
            memo.clear()
            memo.old = {}

    def encode(self, text: str) -> bytes:
        if _AMID.search(text):
            return self.whole(text)
        words = text.split(" ")
        head = self.first[words[0]]
        del words[0]
        return head + b"".join(map(self.after_blank.__getitem__, words))


class ByteBpe:
    """BPE over bytes with ranks as ids, encoding by automaton and backtracking."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.found_by = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.found_by.add_word(b.decode("latin-1"), i)
        self.found_by.make_automaton()
        self.most = max(map(len, ranks), default=0)
        self.fits: dict[tuple[int, int], bool] = {}
        self.prefix: dict[int, int] = {}
        self.text = PatternSplitter(pattern, lambda p: _PACK["I"](self.encode_piece(p.encode())))

    def merge(self, piece: bytes) -> list[int]:
        """The definition: again and again join the adjacent pair of least rank, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.ranks) + 256
        while len(parts) > 1:
            scores = [self.ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(scores)
            if best == none:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= 4 * MEMO:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        known = self.prefix.get(token)
        if known is None:
            b = self.token[token]
            known = self.prefix[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), -1)
        return known

    def longest(self, text: str, piece: bytes, at: int) -> int:
        """The longest token at a place, or -1. The automaton's trie bounds the length that is tried."""
        end = at + self.found_by.longest_prefix(text[at : at + self.most])
        while end > at:
            token = self.ranks.get(piece[at:end])
            if token is not None:
                return token
            end -= 1
        return -1

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, text = len(piece), piece.decode("latin-1")
        length, fits = self.length, self.fits
        dead = bytearray(n + 1)
        out: list[int] = []
        at, last, token = 0, -1, self.longest(text, piece, 0)
        while at < n:
            if token < 0:  # nothing fits here: mark the place and shorten the token before it
                dead[at] = 1
                if not out:
                    raise ValueError("a byte of the text is no token")
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self.shorter(token)
                continue
            to = at + length[token]
            if not dead[to] and (last < 0 or (fits[last, token] if (last, token) in fits else self.compatible(last, token))):
                out.append(token)
                at, last = to, token
                token = self.longest(text, piece, at)
            else:
                token = self.shorter(token)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of the text, as little-endian unsigned 32-bit integers."""
        return self.text.encode(text)

    def forget(self) -> None:
        """Drop what is remembered of texts; the vocabulary stays."""
        self.text.forget()
        self.fits.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, so that a worker holds little at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_columns(df: DataFrame, added: dict[str, T.DataType], make, source: str, done=lambda: None) -> DataFrame:
    """``df`` plus columns; ``make()`` gives a worker's function from the values of ``source`` to the columns' Arrow arrays. ``done()`` is
    called when a task ends."""
    names = list(added)
    schema = T.StructType([f for f in df.schema.fields if f.name not in added] + [T.StructField(n, kind) for n, kind in added.items()])
    kept = [f.name for f in schema.fields[: -len(names)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        try:
            for part in slices(batches):
                apply = apply or make()
                with without_collector():
                    made = apply(part.column(source))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *made], [*kept, *names])
        finally:
            done()

    return df.mapInArrow(lean(run), schema)


def _joiner(token: dict[int, bytes]):
    return lambda ids: b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _binary(values: list) -> pa.Array:
    return pa.array(values, pa.binary())


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` plus a binary column: the ids of text; with ``decoded``, another one: the bytes that these ids stand for, decoded where
    they were encoded. The vocabulary, a file of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = fingerprint(sorted(ranks.items()), pattern)

    def make():
        bpe = per_worker(key, lambda: ByteBpe(shared.value, pattern))
        join = _joiner(bpe.token)

        def apply(texts: pa.Array) -> list[pa.Array]:
            made = [bpe.encode(t or "") for t in texts.to_pylist()]
            return [_binary(made), *([_binary([join(x) for x in made])] if decoded else [])]

        return apply

    return with_columns(docs, dict.fromkeys([ids, *([decoded] if decoded else [])], T.BinaryType()), make, "text", lambda: forget(key))


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` plus a binary column: the bytes that the ids stand for; null ids give null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def make():
        join = _joiner({i: b for b, i in shared.value.items()})
        return lambda col: [_binary([None if x is None else join(x) for x in col.to_pylist()])]

    return with_columns(encoded, {out: T.BinaryType()}, make, ids)


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    both = encode_documents(docs.select("doc_id", "text"), ranks, pattern, decoded="decoded")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
