"""Repeated windows found by content: anchors, their exchange, and the contexts that anchors share.

A document is a sequence of units (bytes, or hashes of words). Of the grams in each window the one of least hash is the
window's anchor, so equal windows have equal anchors at equal places, wherever they stand. Only anchors found at two or
more places can lie in a repeated window; all others are dropped after one compact exchange. What an anchor's windows
can reach, its context, is then compared among the places that share the anchor.

Both exchanges collapse copies before they shuffle: of equal anchors (or equal contexts) that a worker has at hand, it
settles all but one itself and sends one, so copies by the thousands reach a bucket once per worker's load.

Rows with null doc_id (or the least long for one) come before all others; of equal doc_ids the texts' hashes decide, then
places; repeated rows of one (doc_id, text) are several places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, lean, materialize
from .words import mixed

LOAD = 1 << 20
SHARD = 60_000
FIRST = -(2**63)


@dataclass(frozen=True)
class Shape:
    """Units per window and per gram, and how a worker turns texts into units and grams into hashes."""

    window: int
    gram: int
    make_units: Callable[[], Callable[[bytes], np.ndarray]]
    gram_hashes: Callable[[np.ndarray], np.ndarray]

    @property
    def reach(self) -> int:
        """Units of a context on either side of its gram."""
        return self.window - self.gram


def places(hashes: np.ndarray, ends: np.ndarray, shape: Shape) -> np.ndarray:
    """Places of the anchors of all windows. ``hashes``: of the grams at each place of several documents' joined units;
    ``ends``: where the documents end."""
    n, grams = len(hashes), shape.reach + 1
    if n < grams:
        return np.empty(0, np.int64)
    # The upper half decides, the place below it breaks ties to the left: a sliding minimum then yields places.
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    width = 1
    while width * 2 <= grams:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :])
    inside = np.zeros(len(low) + 1, np.int32)  # windows must not reach over an end
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= shape.window
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, np.minimum(ends[long] - shape.window + 1, len(low)), -1)
    found = low[np.cumsum(inside[:-1]) > 0] & np.uint64(0xFFFFFFFF)
    return np.unique(found[np.concatenate([[True], found[1:] != found[:-1]])]).astype(np.int64) if len(found) else np.empty(0, np.int64)


def _loads(batches: Iterator[pa.RecordBatch], units: Callable[[bytes], np.ndarray], most: int) -> Iterator[tuple[list[tuple[pa.RecordBatch, int]], list[np.ndarray]]]:
    """Rows with the units of their texts, in loads of about ``most`` units."""
    rows, parts, n = [], [], 0
    for batch in batches:
        texts = batch.column("text")
        for i in range(batch.num_rows):
            u = units((texts[i].as_py() or "").encode())
            rows.append((batch, i))
            parts.append(u)
            n += len(u)
            if n >= most:
                yield rows, parts
                rows, parts, n = [], [], 0
    if rows:
        yield rows, parts


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id, or the least long), th (hash of the text), text: d and th name a document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("d"), F.xxhash64("text").alias("th"), "text")


def _home(d: np.ndarray, th: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document, by id and text: rows without an id don't meet in one."""
    return (mixed(d.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + th.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(columns: dict[str, np.ndarray], to: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket, with the bytes of its entries' columns."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    some = {c: x[order] for c, x in columns.items()}
    arrays = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()) for x in some.values()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *arrays], ["bucket", *some])


def _unpacked(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)


_TO_DOCUMENTS = "bucket int, d binary, th binary, a binary, b binary"


def _to_documents(d: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.Table:
    return pa.Table.from_batches([_packed({"d": d, "th": th, "a": a.astype(np.int32), "b": b.astype(np.int32)}, _home(d, th, buckets), buckets)])


def by_document(sent: DataFrame) -> DataFrame:
    """(d, th, starts, stops), 32-bit integers in bytes: the maximal runs of each document. Runs with equal ends are places."""

    def fold(table: pa.Table) -> pa.Table:
        d, th, a, b = (_unpacked(table, c, k) for c, k in (("d", np.int64), ("th", np.int64), ("a", np.int32), ("b", np.int32)))
        order = np.lexsort((b, a, th, d))
        d, th, a, b = d[order], th[order], a[order].astype(np.int64), b[order].astype(np.int64)
        new_doc = np.concatenate([[True], (d[1:] != d[:-1]) | (th[1:] != th[:-1])])
        shift = np.cumsum(new_doc) << 33
        reached = np.maximum.accumulate(shift + b)
        new = new_doc | np.concatenate([[True], (shift + a)[1:] > reached[:-1]])
        if (a == b).all():
            new = new_doc | np.concatenate([[True], a[1:] != a[:-1]])
        first = np.flatnonzero(new)
        starts = a[first].astype(np.int32)
        stops = (reached[np.append(first[1:], len(a)) - 1] - shift[first]).astype(np.int32)
        docs = np.flatnonzero(new_doc[first])
        cuts = [*docs.tolist(), len(first)]
        pieces = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return pa.table({"d": d[first][docs], "th": th[first][docs], "starts": pieces(starts), "stops": pieces(stops)})

    return sent.groupBy("bucket").applyInArrow(lean(fold), "d long, th long, starts binary, stops binary")


def repeated_anchors(docs: DataFrame, shape: Shape) -> DataFrame:
    """(d, th, starts): the documents' places of anchors found at two or more places."""
    buckets = bucket_count(docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shape.make_units()
        for rows, parts in _loads(batches, units, LOAD):
            ends = np.cumsum([len(p) for p in parts])
            joined = np.concatenate(parts)
            hashes = shape.gram_hashes(joined)
            at = places(hashes, ends, shape)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, "right")
            own = [[batch.column(c)[i].as_py() for batch, i in rows] for c in ("d", "th")]
            d, th = (np.array(x, np.int64)[doc] for x in own)
            pos = (at - np.concatenate([[0], ends[:-1]])[doc]).astype(np.int32)
            h = hashes[at]
            order = np.argsort(h, kind="stable")
            h, d, th, pos = h[order], d[order], th[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            count = np.diff(np.append(first, len(h)))
            several = np.repeat(count > 1, count)
            # What is repeated in this load is a candidate by itself (h = 0 marks it as settled) ...
            if several.any():
                settled = {"d": d[several], "th": th[several], "pos": pos[several], "h": np.zeros(int(several.sum()), np.uint64)}
                yield _packed(settled, _home(settled["d"], settled["th"], buckets), buckets)
            # ... and one of each anchor goes to its bucket; position -1: the sender needs no answer.
            asked = {"d": d[first], "th": th[first], "pos": np.where(count > 1, -1, pos[first]).astype(np.int32), "h": h[first]}
            yield _packed(asked, ((asked["h"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64), buckets)

    def meet(table: pa.Table) -> pa.Table:
        h, d, th, pos = (_unpacked(table, c, k) for c, k in (("h", np.uint64), ("d", np.int64), ("th", np.int64), ("pos", np.int32)))
        order = np.argsort(h, kind="stable")
        hs = h[order]
        first = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
        count = np.diff(np.append(first, len(hs)))
        several = np.zeros(len(h), bool)
        several[order] = np.repeat((np.add.reduceat((pos[order] < 0).astype(np.int64), first) + count) > 1, count)
        keep = ((h == 0) | several) & (pos >= 0)
        return _to_documents(d[keep], th[keep], pos[keep], pos[keep], buckets)

    sent = keyed(docs).select("d", "th", "text").mapInArrow(lean(send), "bucket int, d binary, th binary, pos binary, h binary")
    return by_document(sent.groupBy("bucket").applyInArrow(lean(meet), _TO_DOCUMENTS)).select("d", "th", "starts")


def with_candidates(docs: DataFrame, shape: Shape, plain) -> DataFrame:
    """doc_id, d, th, places (sorted, 32-bit integers in bytes; null if none), text (null if there are none) and ``plain(text)``, the
    columns of a document of which nothing is removed. Whole texts move once."""
    listed = repeated_anchors(docs, shape).withColumnsRenamed({"d": "c_d", "th": "c_th", "starts": "places"})
    rows = keyed(docs)
    joined = rows.join(listed.hint("merge"), (rows.d == F.col("c_d")) & (rows.th == F.col("c_th")), "left")
    needed = F.when(F.col("places").isNotNull(), F.col("text")).alias("text")
    return materialize(joined.select("doc_id", "d", "th", "places", needed, *plain))


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """``rows`` with the starts and stops of their runs (null: none)."""
    runs = materialize(runs).withColumnsRenamed({"d": "r_d", "th": "r_th"})
    return rows.join(runs.hint("merge"), (rows.d == F.col("r_d")) & (rows.th == F.col("r_th")), "left")


def runs_of(row: dict) -> list[tuple[int, int]]:
    return list(zip(*(np.frombuffer(row[c] or b"", np.int32).tolist() for c in ("starts", "stops")), strict=True))


@dataclass
class Contexts:
    """Contexts side by side. ``units``: a row each, the gram at column ``reach``, zero beyond the document; ``lead`` and ``size``:
    units before the gram and in all; ``copies``: 2 if the load had several; d, th, pos: the place of the first."""

    h: np.ndarray
    units: np.ndarray
    lead: np.ndarray
    size: np.ndarray
    copies: np.ndarray
    d: np.ndarray
    th: np.ndarray
    pos: np.ndarray

    def take(self, at) -> Contexts:
        return Contexts(*(x[at] for x in vars(self).values()))


_KINDS = {"h": np.uint64, "lead": np.uint8, "size": np.uint8, "copies": np.uint8, "d": np.int64, "th": np.int64, "pos": np.int32}


def gathered(load: list[tuple[pa.RecordBatch, int]], parts: list[np.ndarray], shape: Shape) -> Contexts:
    """The contexts of a load's candidates, by (d, th, pos)."""
    keys = [tuple(batch.column(c)[i].as_py() for c in ("d", "th")) for batch, i in load]
    by = sorted(range(len(load)), key=keys.__getitem__)
    at = [np.frombuffer(load[i][0].column("places")[load[i][1]].as_py(), np.int32) for i in by]
    count = [len(x) for x in at]
    size = np.array([len(parts[i]) for i in by])
    reach, width = shape.reach, 2 * shape.reach + shape.gram
    begin = np.cumsum(size + reach) - size  # blanks between documents keep contexts apart
    joined = np.zeros(int(begin[-1] + size[-1]) + width, parts[0].dtype)
    for b, i in zip(begin.tolist(), by, strict=True):
        joined[b : b + len(parts[i])] = parts[i]
    doc = np.repeat(np.arange(len(by)), count)
    pos = np.concatenate(at)
    lead, after = np.minimum(pos, reach), np.minimum(size[doc] - pos, shape.window)
    wide = lead + after >= shape.window
    doc, pos, lead, after = doc[wide], pos[wide], lead[wide], after[wide]
    here = begin[doc] + pos
    units = joined[(here - reach)[:, None] + np.arange(width)]
    columns = np.arange(width)
    units[(columns < (reach - lead)[:, None]) | (columns >= (reach + after)[:, None])] = 0
    d, th = (np.array([keys[i][c] for i in by], np.int64)[doc] for c in (0, 1))
    h = mixed(shape.gram_hashes(joined)[here]) if len(here) else np.empty(0, np.uint64)
    return Contexts(h, units, lead.astype(np.uint8), (lead + after).astype(np.uint8), np.ones(len(pos), np.uint8), d, th, pos.astype(np.int32))


def equal_contexts(of: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of classes of equal contexts, and the first of each class."""
    rows = np.ascontiguousarray(np.concatenate([of.units.view(np.uint8).reshape(len(of.h), -1), of.lead[:, None], of.size[:, None]], 1))
    _, first, inverse = np.unique(rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return inverse, first


def contexts(rows: DataFrame, shape: Shape, solve: Callable[[Contexts], tuple[np.ndarray, np.ndarray, np.ndarray]], *, distinct_rows: bool, load: int) -> DataFrame:
    """(d, th, starts, stops): maximal runs of units to remove, from the contexts of the candidates in ``rows``.

    Of equal contexts in a load of ``load`` units the first (by d, th and place) goes to its bucket; the others are settled, as
    whole contexts that are repeated and not first. ``solve`` gets whole groups of one anchor and gives the hit contexts and
    the starts and stops of their runs. ``distinct_rows``: repeated rows of one document are one place.
    """
    buckets = bucket_count(rows)
    dtype = shape.make_units()(b"").dtype
    width = 2 * shape.reach + shape.gram
    names = [*_KINDS, "units"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, parts in _loads(batches, shape.make_units(), load):
            found = gathered(some, parts, shape)
            if not len(found.h):
                continue
            inverse, first = equal_contexts(found)
            later = first[inverse] != np.arange(len(inverse))
            if distinct_rows:
                later &= (found.d != found.d[first[inverse]]) | (found.th != found.th[first[inverse]]) | (found.pos != found.pos[first[inverse]])
            copies = np.bincount(inverse[later], minlength=len(first)) > 0
            open_ = found.take(first)
            open_.copies = np.where(copies, 2, 1).astype(np.uint8)
            yield _packed({c: getattr(open_, c) for c in names}, (open_.h % np.uint64(buckets)).astype(np.int64), buckets)
            if later.any():  # settled runs, without units: start and stop stand in the places of pos and h
                of = found.take(later)
                start = of.pos - of.lead
                run = {"h": (start + of.size).astype(np.uint64), **dict.fromkeys(("lead", "size", "copies", "units"), np.empty((len(start), 0), np.uint8)), "d": of.d, "th": of.th, "pos": start.astype(np.int32)}
                yield _packed({c: run[c] for c in names}, _home(of.d, of.th, buckets), buckets)

    def meet(table: pa.Table) -> pa.Table:
        settled = pa.array([not x.as_py() for x in table.column("units")], pa.bool_())
        done, rest = table.filter(settled), table.filter(pc.invert(settled))
        out = [[_unpacked(done, c, _KINDS[c]).astype(k) for c, k in (("d", np.int64), ("th", np.int64), ("pos", np.int32), ("h", np.int32))]]
        if rest.num_rows:
            c = {name: _unpacked(rest, name, kind) for name, kind in _KINDS.items()}
            units = _unpacked(rest, "units", dtype).reshape(-1, width)
            order = np.argsort(c["h"], kind="stable")
            hs = c["h"][order]
            firsts = np.flatnonzero(np.concatenate([[True], hs[1:] != hs[:-1]]))
            at = 0
            for f in [*firsts[1:].tolist(), len(hs)]:  # shards of whole groups, so that little is held at once
                if f - at >= SHARD or f == len(hs):
                    o = order[at:f]
                    of = Contexts(hs[at:f], units[o], *(c[x][o] for x in ("lead", "size", "copies", "d", "th", "pos")))
                    hit, start, stop = solve(of)
                    out.append([of.d[hit], of.th[hit], start, stop])
                    at = f
        return _to_documents(*(np.concatenate(x) for x in zip(*out, strict=True)), buckets)

    sent = rows.where("places is not null").select("d", "th", "places", "text").mapInArrow(lean(send), "bucket int, " + ", ".join(f"{c} binary" for c in names))
    return by_document(sent.groupBy("bucket").applyInArrow(lean(meet), _TO_DOCUMENTS))
