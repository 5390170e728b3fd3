"""Substring dedup over words by suffix automata of reference shards.

Anchors (see anchors.py) bring the places together that may share a window of words. The distinct contexts of an anchor
are its reference shard: their suffix automaton counts at how many places each word sequence ends. The contexts are then
streamed through the automaton; where the matching statistic reaches the window's length and the state of that
length was met at two or more places, the window is repeated. Maximal runs of such windows are removed at every place.

A shard's automaton stays with the worker that holds the anchor's places instead of being broadcast to all documents:
the references of a corpus against itself grow with the corpus, so neither their size nor the number of passes would be
bounded. A shard of one context needs no automaton: at two or more places all its windows are repeated.

Defined results: a null text has no words; repeated rows are places of their own, so both lose what they share; null
doc_ids are kept apart by their texts; texts shorter than a window stay; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .anchors import Contexts, Shape, contexts, equal_contexts, runs_of, with_candidates, with_runs
from .words import WordHasher, run_hashes

WINDOW, GRAM, LOAD = 35, 12, 1 << 19


class SuffixAutomaton:
    """Of several sequences, each at a number of places."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        self._ends = 0

    def add(self, sequence: list[int], places: int) -> None:
        last = 0 if len(self.next) == 1 else self._last
        if last:
            self._ends -= 1  # a symbol of its own keeps sequences apart
            last = self._extend(last, self._ends, 0)
        for symbol in sequence:
            last = self._extend(last, symbol, places)
        self._last = last

    def _extend(self, last: int, symbol: int, places: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        self.places.append(places)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.places.append(0)
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def count(self) -> None:
        """Sum places along suffix links, so that each state has those of all sequences that end in its own."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]

    def repeated_ends(self, sequence: list[int], window: int) -> list[int]:
        """Ends (exclusive) of the sequence's windows that are at two or more places."""
        state = matched = 0
        ends = []
        for i, symbol in enumerate(sequence):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                matched += 1
            while self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.places[state] > 1:
                ends.append(i + 1)
        return ends


def word_shape(window: int = WINDOW, gram: int = GRAM) -> Shape:
    def make_units():
        hasher = WordHasher()
        return lambda data: hasher.of(data.split())

    return Shape(window, gram, make_units, lambda u: np.maximum(run_hashes(u, gram), np.uint64(1)))


def solve_words(shape: Shape):
    """The solver of contexts: runs of repeated windows."""
    window = shape.window

    def solve(of: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hits, starts, stops = [], [], []
        pos, lead, size, copies = (x.astype(np.int64).tolist() for x in (of.pos, of.lead, of.size, of.copies))
        same, _ = equal_contexts(of)
        same = same.tolist()
        cuts = [*np.flatnonzero(np.concatenate([[True], of.h[1:] != of.h[:-1]])).tolist(), len(of.h)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            shard: dict[int, list[int]] = {}
            for i in range(a, b):
                shard.setdefault(same[i], []).append(i)
            places = {u: sum(copies[i] for i in at) for u, at in shard.items()}
            runs = {}
            if len(shard) == 1:
                runs = {u: (0, size[at[0]]) for u, at in shard.items() if places[u] > 1}
            else:
                automaton, words = SuffixAutomaton(), {}
                for u, at in shard.items():
                    i = at[0]
                    begin = shape.reach - lead[i]
                    words[u] = of.units[i, begin : begin + size[i]].tolist()
                    words[u][lead[i]] += 1 << 64  # the anchor's first word is marked: a window meets itself in one context only
                    automaton.add(words[u], places[u])
                automaton.count()
                for u in shard:
                    if ends := automaton.repeated_ends(words[u], window):
                        runs[u] = (ends[0] - window, ends[-1])
            for u, (s, e) in runs.items():
                for i in shard[u]:
                    hits.append(i)
                    starts.append(pos[i] - lead[i] + s)
                    stops.append(pos[i] - lead[i] + e)
        return np.array(hits, np.int64), np.array(starts, np.int64), np.array(stops, np.int64)

    return solve


def dedup_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (word runs removed), kept (words joined by blanks; null: all)."""
    shape = word_shape(window, gram)
    rows = with_candidates(docs, shape, [F.when(F.col("places").isNull(), F.coalesce(F.col("text"), F.lit(""))).alias("plain")])
    joined = with_runs(rows, contexts(rows, shape, solve_words(shape), distinct_rows=False, load=LOAD))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,stop:int>>, kept string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for r in part.to_pylist():
                    words = (r["plain"] if r["text"] is None else r["text"]).encode().split()
                    runs_ = runs_of(r)
                    n = len(words)
                    for a, b in reversed(runs_):
                        del words[a:b]
                    kept = b" ".join(words)
                    out.append({"doc_id": r["doc_id"], "n_words": n, "n_removed": n - len(words), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": a, "stop": b} for a, b in runs_], "kept": kept.decode() if runs_ else None})
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return joined.select("doc_id", "text", "plain", "starts", "stops").mapInArrow(lean(cut), schema)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.string())])

ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT rid, i, array_to_string(ws[i : i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM rep),
kept AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.p) AS k, count(*) AS c FROM (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) x ANTI JOIN gone USING (rid, p) GROUP BY x.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
