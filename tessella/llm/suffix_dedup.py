"""Substring dedup over bytes by column-wise construction of a collection's sorted suffixes and common prefixes.

Anchors (see anchors.py) bring the places together that may share a window. Their contexts are the documents of a
collection, aligned at the anchor. The collection is built column by column from the right: each round inserts one byte
of every context, sorting by that byte the order that the last round left (the bytes met in this order are that round's
part of the Burrows-Wheeler transform), and gives each suffix its common prefix with the one before it: one more than the
least of the prefixes between the two in the old order. When a window's first column has been inserted, suffixes whose
common prefixes reach the window's length are equal windows, and all but the earliest are removed.

Shards of whole anchor groups are built one after another in memory; the exchange's files take the part of the external
files. Removal is judged on the input: a byte goes if a window over it also starts earlier (smaller doc_id, or same
document and earlier start).

Defined results: a null text is empty; a null doc_id comes before all others; repeated rows (same doc_id and text) are one
place and share their result; of several texts under one doc_id
that of the least hash comes first; texts shorter than a window stay; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .anchors import Contexts, Shape, contexts, runs_of, with_candidates, with_runs
from .words import mixed

WINDOW, GRAM, LOAD = 100, 32, 1 << 21


def _gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of bytes; the bytes of a gram are packed into 64-bit integers by doubling."""
    packed = units.astype(np.uint64)
    for width in (1, 2, 4):
        packed = packed[: len(packed) - width] | (packed[width:] << np.uint64(8 * width)) if len(packed) > width else packed[:0]
    n = len(units) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 7, 8)] + ([gram - 8] if gram % 8 else []):
        total = mixed(total + packed[at : at + n] * np.uint64(0x9E3779B97F4A7C15))
    return np.maximum(total, np.uint64(1))


def byte_shape(window: int = WINDOW, gram: int = GRAM) -> Shape:
    return Shape(window, gram, lambda: lambda data: np.frombuffer(data, np.uint8), lambda u: _gram_hashes(u, gram))


def range_minimum(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, ... values."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        half, last = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(last[: len(last) - half], last[half:]))
    return levels


def insert_column(symbols: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: the order and common prefixes of suffixes that each start with one more symbol."""
    met = symbols[order]
    moved = np.argsort(met, kind="stable")
    sorted_symbols = met[moved]
    a, b = moved[:-1], moved[1:]
    same = sorted_symbols[1:] == sorted_symbols[:-1]
    longer = np.zeros(len(order), np.uint8)
    if same.any():
        low, high = a[same] + 1, b[same]
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        least = np.empty(len(low), np.uint8)
        tables = range_minimum(common)
        for k in np.unique(level):
            at = level == k
            least[at] = np.minimum(tables[k][low[at]], tables[k][high[at] - (1 << int(k)) + 1])
        longer[1:][same] = np.minimum(least, 254) + 1
    return order[moved], longer


def later_windows(matrix: np.ndarray, rank: np.ndarray, valid_from: np.ndarray, valid_to: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start column of each context's windows that an equal window of smaller rank precedes (-1: none)."""
    columns, n = matrix.shape
    order, common = np.arange(n), np.zeros(n, np.uint8)
    low, high = np.full(n, -1), np.full(n, -1)
    for c in range(columns - 1, -1, -1):
        order, common = insert_column(matrix[c], order, common)
        if c > reach:
            continue
        starts = np.flatnonzero(np.concatenate([[True], common[1:] < window]))
        usable = (valid_from <= c) & (c + window <= valid_to)
        ranks = np.where(usable, rank, len(rank))[order]
        first = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, n)))
        late = order[(ranks > first) & (ranks < len(rank))]
        high[late] = np.where(high[late] < 0, c, high[late])
        low[late] = c
    return low, high


def solve_bytes(shape: Shape):
    """The solver of a shard: runs that are repeated and not first."""
    reach, window = shape.reach, shape.window

    def solve(of: Contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = np.arange(2 * reach + shape.gram)[:, None]
        begin = reach - of.lead.astype(np.int64)
        end = begin + of.size
        matrix = np.where((columns >= begin) & (columns < end), of.units.T.astype(np.uint16) + 1, 0).astype(np.uint16)
        by_place = np.lexsort((of.pos, of.th, of.d))
        new = np.zeros(len(by_place), bool)
        for x in (of.d[by_place], of.th[by_place], of.pos[by_place]):
            new[1:] |= x[1:] != x[:-1]
        rank = np.empty(len(by_place), np.int64)
        rank[by_place] = np.cumsum(new)
        low, high = later_windows(matrix, rank, begin, end, window, reach)
        hit = np.flatnonzero(low >= 0)
        zero = of.pos[hit] - reach
        return hit, zero + low[hit], zero + high[hit] + window

    return solve


def dedup_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte runs removed), kept (bytes; null: all of the text)."""
    shape = byte_shape(window, gram)
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = [F.octet_length(text).cast("long").alias("n_bytes"), F.when(F.col("places").isNull(), F.sha2(F.encode(text, "UTF-8"), 256)).alias("plain_sha256")]
    rows = with_candidates(docs, shape, plain)
    joined = with_runs(rows, contexts(rows, shape, solve_bytes(shape), distinct_rows=True, load=LOAD))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for r in part.to_pylist():
                    runs_, sha = runs_of(r), r["plain_sha256"]
                    kept = None
                    if sha is None:
                        data, at, pieces = (r["text"] or "").encode(), 0, []
                        for a, b in runs_:
                            pieces.append(data[at:a])
                            at = b
                        kept = b"".join([*pieces, data[at:]])
                        sha = hashlib.sha256(kept).hexdigest()
                        kept = kept if runs_ else None
                    out.append({"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "n_removed": sum(b - a for a, b in runs_), "n_spans": len(runs_), "kept_sha256": sha, "spans": [{"start": a, "stop": b} for a, b in runs_], "kept": kept})
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return joined.select("doc_id", "n_bytes", "plain_sha256", "text", "starts", "stops").mapInArrow(lean(cut), schema)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())])

ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, len(x) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM n WHERE n >= 100)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
edge AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, -1) AS new FROM late),
run AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, g),
gap AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM span UNION ALL SELECT n.doc_id, coalesce(max(span.b), 0), max(n.n) FROM n LEFT JOIN span USING (doc_id) GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gap JOIN n USING (doc_id) GROUP BY doc_id),
total AS (SELECT doc_id, sum(b - a)::BIGINT AS r, count(*) AS c FROM span GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
