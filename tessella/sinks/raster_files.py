"""Rasters as image and array files.

Every encoder gives rows (path, place, content): pieces of files, made where their lines are, so no raster sits in one task.
write_files() puts the pieces into a folder that the driver and all executors mount; a file gets its name when it is whole.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiff
from ..functions.safe import join_same
from ..operators.radiometry import to_u8

V = F.col
_PIECE = "path string, place long, content binary"


def write_files(pieces: DataFrame, folder: str) -> int:
    """Write the pieces of files below ``folder``; gives the number of files."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("files are written to a folder that the driver and all executors mount")
    root = folder.removeprefix("file://")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = []
            for path, place, content in zip(batch.path, batch.place, batch.content, strict=True):
                target = os.path.join(root, path) + ".part"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                file = os.open(target, os.O_WRONLY | os.O_CREAT)
                try:
                    os.pwrite(file, content, place)
                finally:
                    os.close(file)
                names.append(path)
            yield pd.DataFrame({"path": names})

    written = [r.path for r in pieces.select("path", "place", "content").mapInPandas(run, "path string").distinct().collect()]  # a name a file
    for path in written:
        os.replace(os.path.join(root, path) + ".part", os.path.join(root, path))
    return len(written)


def _bands(pixels: DataFrame, lines: int) -> DataFrame:
    """pixels with band (of ``lines`` lines) and the raster's height and width."""
    size = pixels.groupBy("product").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return join_same(pixels.select("product", "y", "x", V("v").cast("double").alias("v")), size, "product").withColumn("band", F.floor(V("y") / lines))


def _dense(rows: pd.DataFrame, first: int, lines: int, width: int) -> np.ndarray:
    out = np.zeros((lines, width))
    out[rows.y.to_numpy() - first, rows.x.to_numpy()] = rows.v.to_numpy()
    return out


def _cast(values: np.ndarray, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return values.astype(kind)
    limits = np.iinfo(kind)
    if values.size and (values.min() < limits.min or values.max() > limits.max):
        raise ValueError(f"values {values.min()}..{values.max()} do not fit {dtype}")
    return values.astype(kind)


def encode_tiff(pixels: DataFrame, dtype: str = "<u2", compression: int = tiff.LZW, tile: int = 256, geotransform: tuple | None = None) -> DataFrame:
    """Pieces of one tiled file of the large variant a product, values kept as they are; ``geotransform`` as tiff.Image gives it."""

    def tiles(rows: pd.DataFrame) -> pd.DataFrame:
        product, band, height, width = (rows[c].iloc[0] for c in ("product", "band", "height", "width"))
        values = np.zeros((tile, -(-width // tile) * tile), np.dtype(dtype))
        values[:, :width] = _cast(_dense(rows, band * tile, tile, width), dtype)
        parts = [tiff.pack(values[:, x : x + tile].tobytes(), compression) for x in range(0, values.shape[1], tile)]
        return pd.DataFrame({"product": [product], "band": [band], "height": [height], "width": [width], "sizes": [[len(p) for p in parts]], "content": [b"".join(parts)]})

    made = _bands(pixels, tile).groupBy("product", "band").applyInPandas(tiles, "product string, band long, height long, width long, sizes array<long>, content binary")
    length = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    before = F.sum(length).over(Window.partitionBy("product").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)) - length
    path = F.concat("product", F.lit(".tif"))
    placed = made.withColumn("place", F.lit(16) + before)

    def frame(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("band")
        blocks = []
        for place, sizes in zip(rows.place, rows.sizes, strict=True):
            for n in sizes:
                blocks.append((int(place), int(n)))
                place += n
        at = blocks[-1][0] + blocks[-1][1]
        at += -at % 8
        head, table = tiff.directory(int(rows.height.iloc[0]), int(rows.width.iloc[0]), dtype, compression, tile, blocks, at, geotransform)
        return pd.DataFrame({"path": [rows["product"].iloc[0] + ".tif"] * 2, "place": [0, at], "content": [head, table]})

    frames = placed.select("product", "band", "height", "width", "sizes", "place").groupBy("product").applyInPandas(frame, _PIECE)
    return placed.select(path.alias("path"), "place", "content").unionByName(frames)


def encode_npy(pixels: DataFrame, dtype: str = "<f4", lead: tuple[int, ...] = (1, 1), lines: int = 256) -> DataFrame:
    """Pieces of one array file a product, of shape (*lead, height, width)."""

    def rows_of(rows: pd.DataFrame) -> pd.DataFrame:
        band, height, width = (int(rows[c].iloc[0]) for c in ("band", "height", "width"))
        n = min(lines, height - band * lines)
        data = _cast(_dense(rows, band * lines, n, width), dtype).tobytes()
        head = io.BytesIO()
        np.lib.format.write_array_header_1_0(head, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (*lead, height, width)})
        start = len(head.getvalue())
        pieces = [(start + band * lines * width * np.dtype(dtype).itemsize, data)] + ([(0, head.getvalue())] if band == 0 else [])
        return pd.DataFrame({"path": [rows["product"].iloc[0] + ".npy"] * len(pieces), "place": [p for p, _ in pieces], "content": [c for _, c in pieces]})

    return _bands(pixels, lines).groupBy("product", "band").applyInPandas(rows_of, _PIECE)


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def joined_adler(parts: list[tuple[int, int]]) -> int:
    """The check sum of a concatenation, from (check sum, length) of its parts."""
    a, b = 1, 0
    for check, n in parts:
        low, high = check & 0xFFFF, check >> 16
        b = (b + high + n * (a - 1)) % 65521
        a = (a + low - 1) % 65521
    return b << 16 | a


def encode_png(pixels: DataFrame, *, unit: bool = False, lines: int = 256) -> DataFrame:
    """Pieces of one 8-bit grey image a product. Values are 0..255, or 0..1 with ``unit``, rounded. A band of lines is compressed
    by itself, up to a flush, so the bands join to one stream."""
    if unit:
        pixels = pixels.withColumn("v", to_u8(V("v")))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        product, band, height, width = (rows[c].iloc[0] for c in ("product", "band", "height", "width"))
        n = int(min(lines, height - band * lines))
        raw = np.zeros((n, width + 1), np.uint8)
        raw[:, 1:] = _cast(_dense(rows, band * lines, n, width), "u1")
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(raw.tobytes()) + squeeze.flush(zlib.Z_FULL_FLUSH)
        head = b""
        if band == 0:
            head = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
            body = b"\x78\x9c" + body
        content = head + _chunk(b"IDAT", body)
        return pd.DataFrame({"product": [product], "band": [band], "content": [content], "adler": [zlib.adler32(raw.tobytes())], "n": [raw.size]})

    made = _bands(pixels, lines).groupBy("product", "band").applyInPandas(packed, "product string, band long, content binary, adler long, n long")
    w = Window.partitionBy("product").orderBy("band")
    size = F.octet_length("content")
    placed = made.withColumn("place", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size)

    def end(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("band")
        check = joined_adler([(int(a), int(n)) for a, n in zip(rows.adler, rows.n, strict=True)])
        return pd.DataFrame({"path": [rows["product"].iloc[0] + ".png"], "place": [int(rows.stop.max())], "content": [_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", check)) + _chunk(b"IEND", b"")]})

    ends = placed.select("product", "band", "adler", "n", (V("place") + size).alias("stop")).groupBy("product").applyInPandas(end, _PIECE)
    return placed.select(F.concat("product", F.lit(".png")).alias("path"), "place", "content").unionByName(ends)


def encode_patch_sets(patches: DataFrame, shard: str, *, as_u8: bool = True) -> DataFrame:
    """One compressed archive a shard (its name the shard's), with image0, image1 (n, 1, P, P), mask, origin_row_col, strip_id and patch_id;
    ``as_u8``: images in 0..1 become 0..255, a quarter of the size. A shard is what one task can hold."""

    def archive(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("patch_id")
        side = round(len(rows.img0.iloc[0]) ** 0.5)
        stack = lambda c, kind: np.stack([np.asarray(x) for x in rows[c]]).reshape(-1, 1, side, side).astype(kind)
        image = lambda c: np.rint(np.clip(stack(c, float), 0, 1) * 255).astype(np.uint8) if as_u8 else stack(c, np.float32)
        arrays = {"image0": image("img0"), "image1": image("img1"), "origin_row_col": rows[["row0", "col0"]].to_numpy(np.int64), "strip_id": rows.strip_id.to_numpy(np.int64), "patch_id": rows.patch_id.to_numpy(np.int64)}
        if rows["mask"].notna().all():
            arrays["mask"] = stack("mask", np.uint8)
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return pd.DataFrame({"path": [f"{rows[shard].iloc[0]}.npz"], "place": [0], "content": [out.getvalue()]})

    wanted = list(dict.fromkeys([shard, "patch_id", "strip_id", "row0", "col0", "img0", "img1", "mask"]))
    return patches.select(*wanted).groupBy(shard).applyInPandas(archive, _PIECE)
