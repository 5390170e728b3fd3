"""Scoring by a class-based n-gram model with classes from exchange clustering.

Texts are read once, into blocks: the distinct words of a load and each token's place among them. All later passes work on
blocks. Every word of the training texts is clustered by exchange, in sweeps over the whole vocabulary: words are dealt by
hash; a block sends each bucket its words with counts of the classes before and after them; there every word moves to the
class that most raises the likelihood of the class bigrams, as counted over all training texts under the classes of the
sweep before; the new classes go back to the blocks. (Words of one sweep move at the same time, so a sweep that does not
raise the likelihood is the last, and the better classes stay.) Sweeps start from classes that a sequential exchange gives
the ``frequent`` most frequent words, on the driver, from their bigram counts (a table whose size that parameter bounds);
every other word starts in the class under which its neighbours are likeliest. It may leave it like any other.

A word after a word of class k has the probability (1 - u_k) * (MIX * P(class | k) * P(word | class) + (1 - MIX) * P(word)),
and a word unseen in training, one event as in the base score, u_k: the share of hapaxes among what follows class k.
Transitions between classes are counted over all training texts.

Vocabularies grow with the corpus and are never broadcast. A very frequent word is one entry a block.

Words are lower-cased (A-Z) runs of WORD characters and named by 64-bit hashes; each text ends with one end token.

Defined results: a null text has the end token alone; a null doc_id counts as the empty text for the choice of held-out
documents (crc32 0: training); repeated rows count as often as they occur; other columns are ignored; an empty table gives
an empty result; without training documents every word is unseen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, discard, lean, materialize, scratch, small_batches
from .words import WordHasher

FREQUENT, CLASSES, SWEEPS, MIX = 512, 24, 2, 0.7
LOAD = 1 << 19
END = np.uint64(1)  # the end token's name; no word hashes to a name below 16
_BLOCK = "block long, docs binary, no_id binary, held binary, ends binary, names binary, codes binary"


class _Texts:
    """Tokens of texts: names of words, each text followed by END."""

    def __init__(self):
        self.hasher = WordHasher()

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Joined tokens and the ends of the texts."""
        parts, ends, n = [], [], 0
        end = np.array([END])
        for t in texts:
            words = self.hasher.of((t or "").encode().lower().split())
            parts += [np.maximum(words, np.uint64(16)), end]
            n += len(words) + 1
            ends.append(n)
        return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(ends, np.int64)


def held_out(doc_id=None):
    name = F.coalesce((F.col("doc_id") if doc_id is None else doc_id).cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % 5 == 1


def _squeezed(codes: np.ndarray) -> bytes:
    return zstandard.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _spread(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def blocks_of(docs: DataFrame, load: int = LOAD) -> DataFrame:
    """Blocks of about ``load`` tokens: doc_ids, flags and ends of their texts, names of their distinct words from frequent to rare,
    and each token's place among the names (compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place, n = _Texts(), TaskContext.get().partitionId(), 0
        ids, held, parts, sizes, total = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            names, codes, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place_of = np.empty(len(names), np.uint32)
            place_of[order] = np.arange(len(names))
            row = (np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids]), np.array(held, bool), np.cumsum(sizes), names[order], _squeezed(place_of[codes]))
            return pa.RecordBatch.from_arrays([pa.array([(place << 32) + n], pa.int64()), *[pa.array([bytes(x)], pa.binary()) for x in row]], ["block", "docs", "no_id", "held", "ends", "names", "codes"])

        for batch in batches:
            for doc, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                tokens, _ = own.tokens([text])
                ids.append(doc)
                held.append(out)
                parts.append(tokens)
                sizes.append(len(tokens))
                total += len(tokens)
                if total >= load:
                    yield block()
                    n += 1
                    ids, held, parts, sizes, total = [], [], [], [], 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(lean(run), _BLOCK)


class _Block:
    """One row of blocks_of()."""

    def __init__(self, row: dict):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.block, self.names, self.codes = row["block"], read("names", np.uint64), _spread(row["codes"])
        self.docs, self.no_id, self.held, self.ends = read("docs", np.int64), read("no_id", bool), read("held", bool), read("ends", np.int64)
        self.train = np.repeat(~self.held, np.diff(self.ends, prepend=0))

    def sides(self, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's class, the class before it and the class after it; an end comes before a text as well."""
        own = classes[self.codes]
        edge = np.array([end], own.dtype)
        return own, np.concatenate([edge, own[:-1]]), np.concatenate([own[1:], edge])


def _dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by bucket, and the cuts between buckets."""
    to = ((names >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(buckets + 1))


def frequent_words(blocks: DataFrame, buckets: int, most: int) -> tuple[np.ndarray, int, int]:
    """Names of the most frequent words (sorted), the number of training tokens and of distinct ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, codes = np.frombuffer(row["names"], np.uint64), _spread(row["codes"])
                train = np.repeat(~np.frombuffer(row["held"], bool), np.diff(np.frombuffer(row["ends"], np.int64), prepend=0))
                counts = np.bincount(codes[train], minlength=len(names)).astype(np.uint32)
                order, cuts = _dealt(names, buckets)
                names, counts = names[order], counts[order]
                used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([names[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary()), pa.array([counts[cuts[b] : cuts[b + 1]].tobytes() for b in used], pa.binary())], ["bucket", "names", "counts"]
                )

    def add(table: pa.Table) -> pa.Table:
        names, inverse = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("names")]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])).astype(np.int64)
        top = np.argsort(-counts, kind="stable")[: most + 1]
        top = top[counts[top] > 0]
        kind = ["word"] * len(top) + ["total"]
        return pa.table({"kind": kind, "name": np.append(names[top], np.uint64(0)).view(np.int64), "n": np.append(counts[top], counts.sum()), "distinct": np.append(np.zeros(len(top), np.int64), np.count_nonzero(counts))})

    sums = blocks.select("held", "ends", "names", "codes").mapInArrow(lean(send), "bucket int, names binary, counts binary")
    sums = materialize(sums.groupBy("bucket").applyInArrow(lean(add), "kind string, name long, n long, distinct long"))
    total = sums.where("kind = 'total'").agg(F.sum("n"), F.sum("distinct")).first()
    words = sums.where(f"kind = 'word' and name <> {int(END)}").orderBy(F.desc("n"), "name").limit(most).collect()
    return np.sort(np.array([r.name for r in words], np.int64).view(np.uint64)), total[0] or 0, total[1] or 0


def _codes(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """0 to n - 1: frequent words; n: other words; n + 1: end."""
    n = len(frequent)
    out = np.full(len(tokens), n, np.int64)
    if n:
        at = np.minimum(np.searchsorted(frequent, tokens), n - 1)
        hit = frequent[at] == tokens
        out[hit] = at[hit]
    out[tokens == END] = n + 1
    return out


def frequent_bigrams(blocks: DataFrame, frequent: np.ndarray) -> np.ndarray:
    """Bigram counts of frequent words, other words (one code) and ends."""
    side = len(frequent) + 2
    shared = blocks.sparkSession.sparkContext.broadcast(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * side, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                of = _Block(row)
                own, before, _ = of.sides(_codes(of.names, shared.value), side - 1)
                total += np.bincount((before * side + own)[of.train], minlength=side * side)
        rows = np.flatnonzero(total.reshape(side, side).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([zlib.compress(total.reshape(side, side)[r].tobytes(), 1) for r in rows], pa.binary())], ["code", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in table.column("counts"))
        return pa.table({"code": table.column("code")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((side, side), np.int64)
    for row in blocks.mapInArrow(lean(count), "code int, counts binary").groupBy("code").applyInArrow(lean(add), "code int, counts binary").toLocalIterator():
        out[row.code] = np.frombuffer(row.counts, np.int64)
    return out


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """Class of each frequent word. The last two codes, other words and ends, keep classes of their own."""
    side = len(bigrams)
    words, total = side - 2, classes + 2
    own = np.array([*(np.arange(words) % classes), classes, classes + 1])
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    table = np.zeros((total, total))
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    by_frequency = np.argsort(-(bigrams[:words].sum(1)), kind="stable")

    def shift(w: int, k: int, sign: int, left: np.ndarray, right: np.ndarray) -> None:
        table[:, k] += sign * left
        table[k, :] += sign * right
        table[k, k] += sign * bigrams[w, w]

    for _ in range(sweeps):
        moves = 0
        for w in by_frequency.tolist():
            left = np.bincount(own, bigrams[:, w], total) - bigrams[w, w] * (np.arange(total) == own[w])
            right = np.bincount(own, bigrams[w], total) - bigrams[w, w] * (np.arange(total) == own[w])
            shift(w, own[w], -1, left, right)
            # Change of the likelihood if w joins class k: cells of row and column k, then the two margins.
            cells = (xlogx(table + left[:, None]) - xlogx(table)).sum(0)[:classes] + (xlogx(table + right[None, :]) - xlogx(table)).sum(1)[:classes]
            own_cell = np.diag(table)[:classes]
            cells += xlogx(own_cell + left[:classes] + right[:classes] + bigrams[w, w]) - xlogx(own_cell + left[:classes]) - xlogx(own_cell + right[:classes]) + xlogx(own_cell)
            n = left.sum() + bigrams[w, w]
            rows, columns = table.sum(1)[:classes], table.sum(0)[:classes]
            gain = cells - (xlogx(rows + n) - xlogx(rows)) - (xlogx(columns + n) - xlogx(columns))
            best = int(np.argmax(gain))
            if gain[best] <= gain[own[w]] + 1e-9:
                best = own[w]
            moves += best != own[w]
            own[w] = best
            shift(w, best, 1, left, right)
        if not moves:
            break
    return own


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """What exchange raises: the log-likelihood of the class bigrams, but for terms that no class changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def gains(table: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, doubled: np.ndarray, classes: int) -> np.ndarray:
    """Gain of the likelihood for each word in each class, over the word in none. ``table``: class bigrams; ``left``, ``right``: the
    words' counts of classes before and after them, ``doubled``: after themselves (in neither of the two)."""
    n, k = len(own), classes
    out = np.zeros((n, k))
    for grid, counts, other in ((table, left, right), (table.T, right, left)):
        w, j = np.nonzero(counts)
        add = counts[w, j][:, None].astype(float)
        cells = grid[j, :k].astype(float)
        mine = own[w]
        inside = mine < k
        cells[np.flatnonzero(inside), mine[inside]] -= add[inside, 0]  # without the word's share in its class's column ...
        at = np.flatnonzero(j == mine)
        cells[at] -= other[w[at], :k]  # ... and row
        both = at[inside[at]]
        cells[both, mine[both]] -= doubled[w[both]]
        cells = np.maximum(cells, 0)
        change = _xlogx(cells + add) - _xlogx(cells)
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else w
        if len(w):
            out[w[first]] += np.add.reduceat(change, first, axis=0)
    w, c = np.nonzero((left[:, :k] > 0) & (right[:, :k] > 0) | (doubled > 0)[:, None])
    a, b, s = left[w, c].astype(float), right[w, c].astype(float), doubled[w].astype(float)
    cell = np.maximum(table[c, c] - (c == own[w]) * (a + b + s), 0)
    np.add.at(out, (w, c), _xlogx(cell + a + b + s) - _xlogx(cell + a) - _xlogx(cell + b) + _xlogx(cell))
    for sums, counts in ((table.sum(1), right), (table.sum(0), left)):
        size = (counts.sum(1) + doubled)[:, None].astype(float)
        rest = np.maximum(sums[None, :k] - (np.arange(k) == own[:, None]) * size, 0)
        out -= _xlogx(rest + size) - _xlogx(rest)
    return out


_ASKED = "block long, bucket int, names binary, at binary, slot binary, n binary"
_ANSWERS = "block long, bucket int, counts binary, classes binary"


def _asks(of: _Block, classes: np.ndarray, width: int, buckets: int) -> pa.Table:
    """A block's words, by bucket, with counts of the classes before (slots from 0) and after them (from ``width``), and of
    themselves after themselves (the last slot): ``at`` is the place among the bucket's words."""
    slots = 2 * width + 1
    _, before, after = of.sides(classes.astype(np.uint8), width - 1)
    after[of.ends - 1] = width - 1
    same = np.concatenate([[False], of.codes[1:] == of.codes[:-1]])
    before[same] = 2 * width  # the last slot
    into = np.concatenate([same[1:], [False]])
    code = of.codes.astype(np.int64) * slots
    cells = np.bincount((code + before)[of.train], minlength=len(of.names) * slots).astype(np.uint32)
    cells += np.bincount((code + width + after)[of.train & ~into], minlength=len(of.names) * slots).astype(np.uint32)
    del code, before, after
    order, cuts = _dealt(of.names, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    hit = np.flatnonzero(cells)
    at, slot, n = place[hit // slots], (hit % slots).astype(np.uint8), cells[hit].astype(np.uint32)
    entry = np.argsort(at, kind="stable")
    at, slot, n = at[entry], slot[entry], n[entry]
    used = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
    edges = np.searchsorted(at, cuts)
    pieces = lambda x, shift=0: pa.array([(x[edges[b] : edges[b + 1]] - (cuts[b] if shift else 0)).astype(np.uint32 if shift else x.dtype).tobytes() for b in used], pa.binary())
    names = pa.array([of.names[order[cuts[b] : cuts[b + 1]]].tobytes() for b in used], pa.binary())
    return pa.table([pa.array([of.block] * len(used), pa.int64()), pa.array(used, pa.int32()), names, pieces(at, 1), pieces(slot), pieces(n)], ["block", "bucket", "names", "at", "slot", "n"])


class _Bucket:
    """A bucket's words with what all blocks ask about them."""

    def __init__(self, table: pa.Table, width: int):
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("names")]
        self.names, self.inverse = np.unique(np.concatenate(parts), return_inverse=True)
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        slots = 2 * width + 1
        seen = np.zeros(len(self.names) * slots, np.int64)
        for start, at, slot, n in zip(self.starts, *(table.column(c).to_pylist() for c in ("at", "slot", "n")), strict=True):
            cell = self.inverse[start + np.frombuffer(at, np.uint32).astype(np.int64)] * slots + np.frombuffer(slot, np.uint8)
            seen[cell] += np.frombuffer(n, np.uint32)  # a block's cells are distinct
        seen = seen.reshape(-1, slots)
        self.left, self.right, self.doubled = seen[:, :width], seen[:, width : 2 * width], seen[:, 2 * width]
        self.counts = self.left.sum(1) + self.doubled
        self.table = table

    def answers(self, classes: np.ndarray) -> pa.Table:
        of = [self.inverse[s : s + m] for s, m in zip(self.starts, self.sizes, strict=True)]
        pieces = lambda x: pa.array([x[i].tobytes() for i in of], pa.binary())
        return pa.table([self.table.column("block"), self.table.column("bucket"), pieces(self.counts), pieces(classes.astype(np.uint8))], ["block", "bucket", "counts", "classes"])


def first_classes(blocks: DataFrame, frequent: np.ndarray, own: np.ndarray, table: np.ndarray, buckets: int) -> DataFrame:
    """(block, bucket, counts, classes) of the blocks' words: frequent words have the classes ``own``, the others that under
    which the frequent words around them are likeliest."""
    k = int(own[-1]) - 1
    width = k + 2
    shared = blocks.sparkSession.sparkContext.broadcast((frequent, own, table))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_, own_, _ = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                of = _Block(row)
                yield from _asks(of, own_[_codes(of.names, frequent_)], width, buckets).to_batches()

    def answer(asked: pa.Table) -> pa.Table:
        frequent_, own_, bigrams = shared.value
        of = _Bucket(asked, width)
        follow = np.log((bigrams[:k] + 0.5) / (bigrams[:k].sum(1, keepdims=True) + 0.5 * width))
        precede = np.log((bigrams[:, :k].T + 0.5) / (bigrams[:, :k].sum(0)[:, None] + 0.5 * width))
        classes = np.argmax(of.right @ follow.T + of.left @ precede.T, 1) if k else np.zeros(len(of.names), np.int64)
        code = _codes(of.names, frequent_)
        known = code != len(frequent_)
        classes[known] = own_[code[known]]
        return of.answers(classes)

    return blocks.mapInArrow(lean(ask), _ASKED).groupBy("bucket").applyInArrow(lean(answer), _ANSWERS)


def _found(of: _Block, found: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and classes of a block's words."""
    found = found.sort_by("bucket")
    order, _ = _dealt(of.names, buckets)
    counts, classes = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    counts[order] = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.int64)
    classes[order] = np.frombuffer(b"".join(found.column("classes").to_pylist()), np.uint8)
    return counts, classes


def class_transitions(blocks: DataFrame, answers: DataFrame, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of class after class over all training tokens, of hapaxes by the class before them, and of the classes."""

    def count(row: pa.Table, found: pa.Table) -> pa.Table:
        of = _Block(row.to_pylist()[0])
        counts, classes = _found(of, found, buckets)
        own, before, _ = of.sides(classes, width - 1)
        total = np.concatenate([np.bincount((before * width + own)[of.train], minlength=width * width), np.bincount(before[of.train & (counts[of.codes] == 1)], minlength=width), np.bincount(own[of.train], minlength=width)])
        at = np.flatnonzero(total)
        return pa.table({"at": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(width * (width + 2))
    counted = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(count), "at long, n long")
    sums = materialize(counted.groupBy("at").agg(F.sum("n").alias("n")))  # of fixed size
    for r in sums.collect():
        out[r.at] = r.n
    discard(sums)
    return out[: width * width].reshape(width, width), out[width * width :][:width], out[width * width + width :]


def next_classes(blocks: DataFrame, answers: DataFrame, table: np.ndarray, buckets: int) -> DataFrame:
    """The answers after one sweep of exchange over all words, with ``table`` as the class bigrams of ``answers``."""
    width = len(table)
    shared = blocks.sparkSession.sparkContext.broadcast(table)
    schema = _ASKED + ", classes binary"

    def ask(row: pa.Table, found: pa.Table) -> pa.Table:
        of = _Block(row.to_pylist()[0])
        _, classes = _found(of, found, buckets)
        return _asks(of, classes, width, buckets).append_column("classes", found.sort_by("bucket").column("classes"))

    def answer(asked: pa.Table) -> pa.Table:
        of = _Bucket(asked, width)
        own = np.empty(len(of.names), np.int64)
        own[of.inverse] = np.frombuffer(b"".join(asked.column("classes").to_pylist()), np.uint8)
        for at in range(0, len(own), 4096):
            some = slice(at, at + 4096)
            gain = gains(shared.value, own[some], of.left[some], of.right[some], of.doubled[some], width - 2)
            best, mine = np.argmax(gain, 1), own[some]
            rows = np.arange(len(mine))
            moves = (mine < width - 2) & (gain[rows, best] > gain[rows, np.minimum(mine, width - 3)] + 1e-9)
            own[some] = np.where(moves, best, mine)
        return of.answers(own)

    asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(ask), schema)
    return asked.groupBy("bucket").applyInArrow(lean(answer), _ANSWERS)


class ClassModel:
    """Log-probabilities from class totals, transitions and unseen shares."""

    def __init__(self, moves: np.ndarray, hapax: np.ndarray, totals: np.ndarray):
        rows = moves.sum(1)
        self.totals = totals
        self.unseen = np.minimum((hapax + 0.5) / (rows + 1), 0.5)
        share = totals / max(totals.sum(), 1)  # after a class that nothing follows, classes are as frequent as anywhere
        self.moves = np.where(rows[:, None] > 0, moves / np.maximum(rows, 1)[:, None], share)

    def log10(self, before: np.ndarray, classes: np.ndarray, counts: np.ndarray, tokens: int) -> np.ndarray:
        total = np.maximum(self.totals[classes], 1)
        seen = MIX * self.moves[before, classes] * counts / total + (1 - MIX) * counts / max(tokens, 1)
        return np.log10(np.where(counts > 0, (1 - self.unseen[before]) * np.maximum(seen, 1e-300), self.unseen[before]))


def train(blocks: DataFrame, buckets: int, frequent: int = FREQUENT, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[DataFrame, ClassModel, int, int]:
    """Counts and classes of the blocks' words, the model, and the numbers of training tokens and of distinct ones."""
    names, tokens, distinct = frequent_words(blocks, buckets, frequent)
    bigrams = frequent_bigrams(blocks, names)
    own = exchange(bigrams, classes)
    width = classes + 2
    table = np.zeros((width, width), np.int64)
    np.add.at(table, (own[:, None], own[None, :]), bigrams)
    answers = materialize(first_classes(blocks, names, own, table, buckets))
    counted = class_transitions(blocks, answers, buckets, width)
    for _ in range(sweeps):
        after = materialize(next_classes(blocks, answers, counted[0], buckets))
        again = class_transitions(blocks, after, buckets, width)
        if likelihood(again[0]) <= likelihood(counted[0]):
            break
        discard(answers)
        answers, counted = after, again
    return answers, ClassModel(*counted), tokens, distinct


def score_documents(docs: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES, sweeps: int = SWEEPS, load: int = LOAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark, buckets = docs.sparkSession, bucket_count(docs)
    with scratch(spark) as keep, small_batches(spark, 512):
        blocks = keep(materialize(blocks_of(docs, load)))
        with small_batches(spark, 4):  # rows are blocks
            answers, model, tokens, distinct = train(blocks, buckets, frequent, classes, sweeps)
        keep(answers)
    shared = spark.sparkContext.broadcast(model)

    def score(row: pa.Table, found: pa.Table) -> pa.Table:
        of = _Block(row.to_pylist()[0])
        counts, kinds = _found(of, found, buckets)
        own, before, _ = of.sides(kinds, classes + 1)
        c = counts[of.codes]
        starts = np.concatenate([[0], of.ends[:-1]])
        add = lambda x: np.add.reduceat(x, starts)
        base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        rest = [of.ends - starts, add((c > 0).astype(np.int64)), np.full(len(starts), tokens), add(base), add(shared.value.log10(before, own, c, tokens))]
        return pa.table([pa.array(of.docs, mask=of.no_id), pa.array(of.held), *map(pa.array, rest)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
