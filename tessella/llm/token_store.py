"""Token ids in a content-addressed store.

Each document's ids (with the end id) are cut where a rolling hash over the last ids hits a pattern, so equal passages
give equal chunks wherever they stand. A unique chunk is stored once under the digest of its bytes; a document is a
recipe, the list of its chunks' digests, under the root of a Merkle tree over them; recipes lie in ascending doc_id order
in range files, and the manifest has a root per file, that of the tree over its recipes' roots. Reading back checks the
recipes against the manifest, each recipe against its root and length, and each chunk against its digest.

Workers drop chunks that they have sent already, so a chunk that very many documents share reaches its bucket a few times
only. A document's checksum is combined from its chunks' checksums, so reading back moves no ids between machines.

Files: chunks (key: the digest, n, data: little-endian unsigned integers of ``width`` bytes), recipes (doc_id, start, n_tokens,
digests, root, part), manifest (part, docs, tokens, width, root); all Parquet.

Defined results: a null text is empty and has the end id alone; null doc_ids come first; rows with equal doc_id are
separate recipes, ordered by root; other columns are not stored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _PACK, PatternSplitter, fingerprint, per_worker, slices, without_collector
from .common import bucket_count, delete, lean, materialize, scratch, shared_dir, write

WINDOW, MASK, LONGEST = 16, 0x1FF, 8192
MEMO = 1_000_000
_ENTRY = "kind string, key binary, doc_id long, n long, digests array<binary>, data binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over ``leaves``; a node without a sibling moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return digest(b"root" + level[0])


def _table() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 1 << 16, dtype=np.uint64)


def cut_points(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ends of the chunks of ``ids``: places where the sum over the window of random values hits the mask, and the end."""
    n = len(ids)
    run = np.cumsum(table[ids & 0xFFFF], dtype=np.uint64)
    rolling = run.copy()
    rolling[WINDOW:] -= run[:-WINDOW]
    mixed = (rolling * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    hits = np.flatnonzero((mixed & np.uint64(MASK)) == 0) + 1
    ends, last = [], 0
    for end in [*hits[hits >= WINDOW].tolist(), n]:
        while end - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if end > last:
            last = end
            ends.append(end)
    return np.array(ends)


class LibraryEncoder:
    """Ids as the tokenizers library gives them. Pieces of the pre-tokenizer's pattern are encoded on their own, by the
    library, and remembered, since the library's model never joins two of them. With ``added``, as by the library's default, a
    token that the definition adds is one id where a text holds it; else it is text like any other."""

    def __init__(self, definition: str, pattern: str, added: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_str(definition)
        whole.encode_special_tokens = not added
        tokenize = whole.model.tokenize
        self.width = 2 if whole.get_vocab_size() <= 1 << 16 else 4
        pack = _PACK["H" if self.width == 2 else "I"]
        # The library's sign for each byte: printable ones stand for themselves, the others are numbered from 256 on.
        signs = pre_tokenizers.ByteLevel.alphabet()
        hidden = [b for b in range(256) if chr(b) not in signs]
        table = dict(zip(hidden, sorted(x for x in signs if ord(x) > 255), strict=True))

        blank = table[32]
        packs = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(64)]

        def piece(p: str) -> bytes:
            signs = p.replace(" ", blank) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(table)
            ids = [t.id for t in tokenize(signs)]
            return packs[len(ids)](*ids) if len(ids) < 64 else pack(ids)

        def word(w: str) -> bytes:
            if not w.isascii():
                return piece(" " + w)
            ids = [t.id for t in tokenize(blank + w)]
            return packs[len(ids)](*ids) if len(ids) < 64 else pack(ids)

        plain = PatternSplitter(pattern, piece, word, MEMO).encode
        contents = [t.content for t in whole.get_added_tokens_decoder().values()] if added else []

        def encode(text: str) -> bytes:
            if any(c in text for c in contents):
                return pack(whole.encode(text, add_special_tokens=False).ids)
            return plain(text)

        self.encode = encode if contents else plain


def encode_entries(docs: DataFrame, definition: str, pattern: str, end_id: int, added: bool = False) -> DataFrame:
    """Chunk and recipe entries of ``docs``; a task leaves out chunks that it has just sent."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    key = fingerprint(definition, pattern, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(key, lambda: LibraryEncoder(shared.value, pattern, added))
        place, recipes = TaskContext.get().partitionId(), 0
        kind, table = f"<u{own.width}", _table()
        end = np.array([end_id], kind).tobytes()
        sent: set[bytes] = set()
        for part in slices(batches, 256):
            rows: list[tuple] = []
            with without_collector():
                encoded = [own.encode(text or "") + end for text in part.column("text").to_pylist()]
            for doc, data in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                ends = cut_points(np.frombuffer(data, kind), table) * own.width
                names = []
                at = 0
                for to in ends.tolist():
                    piece = data[at:to]
                    at = to
                    names.append(name := digest(piece))
                    if name not in sent:
                        if len(sent) > 500_000:
                            sent.clear()
                        sent.add(name)
                        rows.append(("chunk", name, None, len(piece) // own.width, None, piece))
                # The key of a recipe deals it out and is its own; it depends on the task's place only, not on the attempt.
                recipes += 1
                rows.append(("recipe", digest(f"{place}/{recipes}".encode()), doc, len(data) // own.width, names, merkle_root(names)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "key", "doc_id", "n", "digests", "data"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), _ENTRY)


_STORE = {
    "recipes": "doc_id long, start long, n_tokens long, digests array<binary>, root binary, part int",
    "manifest": "part int, docs long, tokens long, root binary, width int",
}


def file_roots(recipes: DataFrame) -> DataFrame:
    """(part, docs, tokens, root) of range files: the Merkle root over their recipes' roots, in order."""

    def fold(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("doc_id", "root")), strict=True)
        leaves = [root for _, root in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
        tokens = sum(table.column("n_tokens").to_pylist())
        return pa.table({"part": table.column("part")[:1], "docs": pa.array([len(leaves)], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "root": pa.array([merkle_root(leaves)], pa.binary())})

    return recipes.select("part", "doc_id", "n_tokens", "root").groupBy("part").applyInArrow(lean(fold), "part int, docs long, tokens long, root binary")


def write_store(docs: DataFrame, definition: str, pattern: str, end_id: int, added: bool = False, path: str | None = None) -> str:
    """Encode ``docs`` and write the store's three tables below ``path`` (a folder that all executors share; by default one
    under spark.checkpoint.dir). Gives the path, for open_store(). ``added``: see LibraryEncoder."""
    spark = docs.sparkSession
    n = bucket_count(docs)
    path = path or f"{shared_dir(spark)}/tessella/{uuid.uuid4().hex}"
    entries = encode_entries(docs, definition, pattern, end_id, added).repartition(n, "key")
    write(entries.dropDuplicates(["key"]), f"{path}/chunks", ["kind"])
    written = spark.read.schema(_ENTRY).parquet(f"{path}/chunks").where("kind = 'recipe'")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    rows = written.select("doc_id", F.col("n").alias("n_tokens"), "digests", F.col("data").alias("root"))
    with scratch(spark):
        ranged = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
        write(file_roots(ranged).withColumn("width", F.lit(LibraryEncoder(definition, pattern).width)), f"{path}/manifest")
        # one row per range file
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = spark.read.schema(_STORE["manifest"]).parquet(f"{path}/manifest").select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
        inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
        recipes = ranged.withColumn("inner", inner).join(F.broadcast(parts), "part")
        write(recipes.select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "digests", "root", "part"), f"{path}/recipes")
    delete(spark, f"{path}/chunks/kind=recipe")
    return path


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables chunks, recipes and manifest of the store at ``path``."""
    chunks = spark.read.schema(_ENTRY).parquet(f"{path}/chunks").where("kind = 'chunk'").select(F.col("key").alias("digest"), "n", "data")
    return {"chunks": chunks, **{name: spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in _STORE.items()}}


def verify_manifest(store: dict[str, DataFrame]) -> bool:
    """Whether every range file's recipes give the root, documents and tokens that the manifest holds for it."""
    again = file_roots(store["recipes"]).select("part", F.struct("docs", "tokens", "root").alias("again"))
    held = store["manifest"].select("part", F.struct("docs", "tokens", "root").alias("held"))
    return held.join(again, "part", "full_outer").where("not (held <=> again)").isEmpty()


@lru_cache(None)
def _square(k: int) -> int:
    """x to the power 2**k modulo the polynomial of crc32, bits reversed."""
    return 1 << 30 if k == 0 else _times(_square(k - 1), _square(k - 1))


def _times(a: int, b: int) -> int:
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return product


@lru_cache(20_000)
def _shift(length: int) -> int:
    power, k = 1 << 31, 3
    while length:
        if length & 1:
            power = _times(_square(k), power)
        length >>= 1
        k += 1
    return power


def _times_all(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_times() of arrays of 32-bit integers."""
    product, b = np.zeros(len(a), np.uint32), b.copy()
    for bit in range(31, -1, -1):
        product ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return product


def joined_crc32(crcs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of concatenations, from the crc32 and the lengths in bytes of their parts: concatenation i has the parts from offsets[i] up to
    offsets[i + 1]."""
    sizes, inverse = np.unique(lengths, return_inverse=True)
    powers = np.array([_shift(int(n)) for n in sizes], np.uint32)
    out = np.zeros(len(offsets) - 1, np.uint32)
    counts = np.diff(offsets)
    for turn in range(int(counts.max(initial=0))):
        at = np.flatnonzero(counts > turn)
        part = offsets[at] + turn
        out[at] = _times_all(powers[inverse[part]], out[at]) ^ crcs[part].astype(np.uint32)
    return out


def checked_chunks(chunks: DataFrame, width: int) -> DataFrame:
    """(digest, n, crc) of stored chunks, crc over ids as 32-bit integers; a chunk that fails its digest raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            names, sums, sizes = part.column("digest").to_pylist(), [], []
            for name, data in zip(names, part.column("data").to_pylist(), strict=True):
                if digest(data) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(data, f"<u{width}")
                sizes.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["digest", "n", "crc"])

    return chunks.select("digest", "data").mapInArrow(lean(run), "digest binary, n long, crc long")


def _listed(store: dict[str, DataFrame], chunks: DataFrame, *columns: str) -> DataFrame:
    """Recipes with the wanted columns of their chunks, in order, as ``parts``."""
    places = store["recipes"].select("start", F.posexplode("digests").alias("pos", "digest"))
    found = places.join(chunks, "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("parts"))
    return store["recipes"].join(found, "start")


def read_checksums(store: dict[str, DataFrame]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    if not verify_manifest(store):
        raise ValueError("the recipes don't give the manifest's roots")
    width = store["manifest"].select(F.max("width")).first()[0] or 4
    rows = _listed(store, checked_chunks(store["chunks"], width), "crc", "n").select("doc_id", "start", "n_tokens", "digests", "root", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2048):
            parts = part.column("parts")
            flat, offsets = parts.flatten(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
            crcs, sizes = flat.field("crc").to_numpy(), flat.field("n").to_numpy()
            totals = np.add.reduceat(sizes, offsets[:-1]) if len(sizes) else sizes
            whole = totals == part.column("n_tokens").to_numpy()
            for i, (names, root) in enumerate(zip(part.column("digests").to_pylist(), part.column("root").to_pylist(), strict=True)):
                if not whole[i] or merkle_root(names) != root:
                    raise ValueError(f"the recipe at {part.column('start')[i]} doesn't give its document")
            sums = joined_crc32(crcs, 4 * sizes, offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), part.column("n_tokens"), pa.array(sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(store: dict[str, DataFrame]) -> DataFrame:
    """doc_id, start and ids (bytes of the store's width) of every document, put together from its chunks."""
    rows = _listed(store, store["chunks"].select("digest", "data"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            ids = [b"".join(p["data"] for p in parts) for parts in part.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("start"), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    return rows.select("doc_id", "start", "parts").mapInArrow(lean(run), "doc_id long, start long, ids binary")
