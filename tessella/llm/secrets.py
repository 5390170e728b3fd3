"""Secret scans: fixed patterns, and character Markov models of random strings and of identifiers.

Two models of order two give the log-likelihood of a string as a random secret and as an ordinary identifier. In a run of
key characters the stretch between '=', '/' and the run's ends whose ratio is greatest is a secret if that passes the
margin, unless a pattern has found it already; what is left on either side of it is searched in the same way. The models are trained
from labelled samples: seeded random strings over the usual alphabets (secret), and words and identifiers made from at most
``WORDS`` words of at most ``SAMPLE`` documents of the corpus, those of least hash (ordinary); the margin is set on a quarter of
these words, held out. The bounds limit the training sample alone; every whole text is scanned.

Spans are (kind, start, end) in code points, end exclusive, sorted by start, then by kind in the order of KINDS.

Defined results: a null text is the empty text without spans; null doc_ids and repeated rows are kept; other columns
pass through unchanged (one named spans is replaced); an empty table gives an empty result and models of the random
strings alone.
"""

from __future__ import annotations

import base64
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_columns

KINDS = ("assign", "access", "hex", "model")
SAMPLE, WORDS = 400, 60_000
SHORTEST = 16
LEAST, SLACK = 4.0, 1.0

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_HINTS = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEY = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_OTHER = re.compile(r"[^A-Za-z0-9+/_=-]")
_PIECE = re.compile(r"[^=/]+")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


class MarkovModel:
    """Log-probabilities of characters after the two before them, smoothed by the model of order one."""

    def __init__(self, strings: list[str], weight: float = 4.0):
        n = len(_ALPHABET) + 1  # the last code stands for what is before a string
        pairs, triples = np.ones((n, n)), np.zeros((n, n, n))
        for s in strings:
            a = b = n - 1
            for c in map(_ALPHABET.find, s):
                if c >= 0:
                    pairs[b, c] += 1
                    triples[a, b, c] += 1
                    a, b = b, c
        first = pairs / pairs.sum(1, keepdims=True)
        second = (triples + weight * first) / (triples.sum(2, keepdims=True) + weight)
        self.log = np.log(second)


def random_secrets(count: int = 3000, seed: int = 11) -> list[str]:
    """Labelled samples of secrets: base64, URL-safe base64, alphanumeric, upper-case and hex strings."""
    rng = random.Random(seed)
    plain = _ALPHABET[:62]
    kinds = [
        lambda: base64.b64encode(rng.randbytes(rng.randint(15, 48))).decode(),
        lambda: base64.urlsafe_b64encode(rng.randbytes(rng.randint(15, 48))).decode(),
        lambda: "".join(rng.choices(plain, k=rng.randint(20, 64))),
        lambda: "".join(rng.choices(_ALPHABET[:26] + "0123456789", k=rng.randint(16, 40))),
        lambda: rng.randbytes(rng.randint(10, 32)).hex(),
    ]
    return [kinds[i % len(kinds)]() for i in range(count)]


def identifiers(words: list[str], count: int = 6000, seed: int = 12) -> list[str]:
    """Labelled samples of ordinary strings: words, alone and joined as identifiers and paths are."""
    rng = random.Random(seed)
    if not words:
        return []
    out = rng.choices(words, k=count // 2)
    for i in range(count // 2):
        some = rng.choices(words, k=rng.randint(2, 5))
        joined = ("_".join, "-".join, "/".join, lambda x: "".join(w.capitalize() for w in x), lambda x: "".join(x))[i % 5](some)
        out.append(joined + (str(rng.randint(0, 9999)) if rng.random() < 0.2 else ""))
    return out + [w.upper() for w in out[: count // 8]]


def sample_words(docs: DataFrame) -> list[str]:
    """At most ``WORDS`` words of at most ``SAMPLE`` documents, those of least hash; a document without an id is hashed by its text."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.col("text").cast("binary")))).cast("binary"))
    rows = docs.where("text is not null").select(key.alias("key"), "text")
    keys = [r.key for r in rows.select("key").distinct().orderBy("key").limit(SAMPLE).collect()]
    words = rows.where(F.col("key").isin(keys)).dropDuplicates(["key"]).select("key", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("pos", "word"))
    return [r.word for r in words.orderBy(F.xxhash64("key", "pos"), "key", "pos").limit(WORDS).collect()]


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Differences of the two models' log-probabilities, by the codes of three characters, and the margin: what no ordinary string of
    a held-out quarter of the sampled words reaches, and LEAST at any rate."""
    words = sample_words(docs)
    held_out, rest = words[::4], [w for i, w in enumerate(words) if i % 4]
    model = MarkovModel(random_secrets()).log - MarkovModel(identifiers(rest)).log
    ordinary = [_OTHER.sub("", x) for x in identifiers(held_out, seed=13)]
    return model, max([LEAST, *[log_ratio(model, x) + SLACK for x in ordinary if len(x) >= SHORTEST]])


def log_ratio(model: np.ndarray, string: str) -> float:
    """Log-likelihood of a random secret over that of an identifier."""
    codes = np.array([len(_ALPHABET)] * 2 + [_ALPHABET.index(c) for c in string])
    return float(model[codes[:-2], codes[1:-1], codes[2:]].sum())


def secret_runs(model: np.ndarray, run: str, margin: float) -> list[tuple[int, int]]:
    """Stretches of a run that pass the margin, best first within what is left. Padding at the end of the run belongs to it."""
    pieces = [m.span() for m in _PIECE.finditer(run)]
    if not pieces:
        return []
    if run.endswith("="):
        pieces[-1] = pieces[-1][0], len(run)
    before = len(_ALPHABET)
    codes = np.array([before] * 2 + [_ALPHABET.index(c) for c in run])
    sums = np.concatenate([[0], np.cumsum(model[codes[:-2], codes[1:-1], codes[2:]])])
    # The first two characters of a stretch have nothing before them, whatever the run has there.
    opening = {a: float(model[before, before, codes[a + 2]] + model[before, codes[a + 2], codes[a + 3]] - sums[a + 2]) for a, _ in pieces if a + 2 <= len(run)}
    found, todo = [], [(0, len(pieces))]
    while todo:
        lo, hi = todo.pop()
        best, start, at = None, None, lo
        for i in range(lo, hi):
            end = pieces[i][1]
            while at <= i and end - pieces[at][0] >= SHORTEST:
                start = at if start is None or opening[pieces[at][0]] > opening[pieces[start][0]] else start
                at += 1
            if start is not None:
                score = opening[pieces[start][0]] + float(sums[end])
                best = (score, start, i) if best is None or score > best[0] else best
        if best and best[0] >= margin:
            found.append((pieces[best[1]][0], pieces[best[2]][1]))
            todo += [(lo, best[1]), (best[2] + 1, hi)]
    return sorted(found)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    data = text.encode().lower()
    if any(h in data for h in _HINTS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return found


def scan(text: str, model: np.ndarray, margin: float) -> list[tuple[str, int, int]]:
    """All spans of a text: those of the patterns, and those that the models add."""
    found = base_spans(text)
    keys = []
    at = 0
    for word in text.split():
        if len(word) < 16:
            continue
        start = text.index(word, at)  # runs of the other patterns have no white space: only long words can hold them
        at = start + len(word)
        found += [("access", start + m.start(), start + m.end()) for m in _ACCESS.finditer(word)]
        found += [("hex", start + m.start(), start + m.end()) for m in _HEX.finditer(word)]
        if len(word) >= SHORTEST:
            keys += [(start + m.start(), start + m.end()) for m in _KEY.finditer(word)]
    fixed = list(found)
    for at, to in keys:
        for a, b in secret_runs(model, text[at:to], margin):
            if not any(s < at + b and at + a < e for _, s, e in fixed):
                found.append(("model", at + a, at + b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, trained: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """``docs`` plus spans. The broadcast model, of train(), is a table of fixed size and a margin."""
    shared = docs.sparkSession.sparkContext.broadcast(trained or train(docs))

    def make():
        table, margin = shared.value
        as_dict = lambda x: [{"kind": k, "start": s, "end": e} for k, s, e in x]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return lambda texts: [pa.array([as_dict(scan(t or "", table, margin)) for t in texts.to_pylist()], kind)]

    return with_columns(docs, {"spans": _SPAN}, make, "text")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    rows = find_secrets(docs.select("doc_id", "text")).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = span_text(F.filter("spans", lambda x: x["kind"] != "model"))
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
