"""Raster and array files as tables: tagged images, arrays, patch archives, byte ranges, probes and check sums.

Contents come through Spark's binary reader, so any store that Spark reads will do. Pixels leave a worker block by block.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tiff
from ..operators.tables import checked, first_column
from .catalogue import is_pointer

V = F.col
_CELLS = pa.schema([("path", pa.string()), ("band", pa.int32()), ("y", pa.int64()), ("x", pa.int64()), ("v", pa.float64())])
PIXELS = "path string, band int, y long, x long, v double"
#: Names under which patch archives hold their images.
FIRST, SECOND = ("image0", "images0", "img0", "ohrc"), ("image1", "images1", "img1", "tmc")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content; no file, or a pointer in place of one, raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    return checked(files, ~is_pointer(V("content")), "a pointer stands in place of the file")


def tiff_pixels(files: DataFrame) -> DataFrame:
    """(path, band, y, x, v) of tagged images, in their own values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                image = tiff.parse(lambda at, n, content=content: content[at : at + n])
                for index, (at, n) in enumerate(image.places):
                    y, x, values = image.decode(index, content[at : at + n])
                    lines, samples, bands = values.shape
                    ys, xs = np.repeat(np.arange(y, y + lines), samples), np.tile(np.arange(x, x + samples), lines)
                    for band in range(bands):
                        cells = [pa.array([path] * len(ys)), pa.array(np.full(len(ys), band, np.int32)), pa.array(ys), pa.array(xs), pa.array(values[:, :, band].ravel().astype(float))]
                        yield pa.RecordBatch.from_arrays(cells, schema=_CELLS)

    return files.select("path", "content").mapInArrow(run, PIXELS)


def grey(pixels: DataFrame) -> DataFrame:
    """One band of images of three: their luminance, rounded; images of one band stay as they are."""
    weights = F.element_at(F.array(F.lit(0.299), F.lit(0.587), F.lit(0.114)), (V("band") + 1).cast("int"))
    both = pixels.groupBy("path", "y", "x").agg(F.count(F.lit(1)).alias("n"), F.rint(F.sum(V("v") * F.when(V("band") < 3, weights).otherwise(0.0))).alias("grey"), F.min_by("v", "band").alias("first"))
    return both.select(V("path").alias("product"), "y", "x", F.when(V("n") >= 3, V("grey")).otherwise(V("first")).alias("v"))


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """pixels(product, y, x, v) of the tagged images at ``path``, grey; the product is the file's path."""
    return grey(tiff_pixels(read_files(spark, path)))


def read_single_band(spark: SparkSession, path: str) -> DataFrame:
    """pixels(product, y, x, v) of images that must have one band each."""
    pixels = tiff_pixels(read_files(spark, path))
    return checked(pixels, V("band") == 0, "the image has more than one band").select(V("path").alias("product"), "y", "x", V("v").cast("float").cast("double").alias("v"))


_INFO = "path string, driver string, width int, height int, bands int, dtype string, compression int, tiled boolean, geotransform array<double>, bounds array<double>, error string"


def _info(path: str, image: tiff.Image | None, error: str | None) -> dict:
    row = dict.fromkeys(c.split()[0] for c in _INFO.split(", ")) | {"path": path, "error": error}
    if image:
        bands, lines, samples = image.shape
        g = image.geotransform
        bounds = [g[0], g[3] + lines * g[5], g[0] + samples * g[1], g[3]] if g else None
        row |= {"driver": "GTiff", "width": samples, "height": lines, "bands": bands, "dtype": image.dtype.str, "compression": image.one(tiff.COMPRESSION, 1), "tiled": image.tiled, "geotransform": list(g) if g else None, "bounds": bounds}
    return row


def probe(files: DataFrame) -> DataFrame:
    """What images' directories say (path, driver, width, height, bands, dtype, compression, tiled, geotransform, bounds: west, south, east,
    north), without their pixels; error says why a file gives nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    rows.append(_info(path, tiff.parse(lambda at, n, content=content: content[at : at + n]), None))
                except (ValueError, struct.error) as error:
                    rows.append(_info(path, None, str(error)))
            yield pd.DataFrame(rows)

    return files.select("path", "content").mapInPandas(run, _INFO)


def probe_sparse(ranges: DataFrame) -> DataFrame:
    """probe() of files of which only some byte ranges (path, place, content) are at hand, such as the header and the directory."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        path = rows.path.iloc[0]
        try:
            return pd.DataFrame([_info(path, tiff.parse(tiff.sparse_reader(dict(zip(rows.place, rows.content, strict=True)))), None)])
        except (ValueError, struct.error) as error:
            return pd.DataFrame([_info(path, None, str(error))])

    return ranges.select("path", "place", "content").groupBy("path").applyInPandas(run, _INFO)


def byte_ranges(files: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """(path, place, content) of the ranges (offset, length) of every file; a range beyond a file's end raises."""
    parts = F.array(*[F.struct(F.lit(a).cast("long").alias("place"), F.lit(n).alias("n")) for a, n in ranges])
    cut = files.withColumn("r", F.explode(parts)).withColumn("part", F.expr("substring(content, cast(r.place + 1 as int), r.n)"))
    return checked(cut, F.octet_length("part") == V("r.n"), "a range lies beyond the end of the file").select("path", V("r.place").alias("place"), V("part").alias("content"))


def numbers(content: Column, layout: str) -> Column:
    """The numbers that bytes hold, by a layout of the struct module, as doubles."""

    @F.pandas_udf("array<double>")
    def read(data: pd.Series) -> pd.Series:
        return data.map(lambda b: [float(x) for x in struct.unpack_from(layout, b)])

    return read(content)


def full_read(files: DataFrame) -> DataFrame:
    """(path, actual_md5, passed, error): every byte is read and every block of an image decoded; passed says whether that went well."""

    def attempt(content: bytes) -> str | None:
        try:
            image = tiff.parse(lambda at, n: content[at : at + n])
            for index, (at, n) in enumerate(image.places):
                if len(content) < at + n:
                    return f"block {index} lies beyond the end"
                image.decode(index, content[at : at + n])
        except Exception as error:  # noqa: BLE001 -- whatever a damaged block raises is the result
            return str(error) or type(error).__name__
        return None

    @F.pandas_udf("string")
    def failure(content: pd.Series) -> pd.Series:
        return content.map(attempt)

    return files.select("path", F.md5("content").alias("actual_md5"), failure("content").alias("error")).select("path", "actual_md5", V("error").isNull().alias("passed"), "error")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, dtype, values) of array files and archives, one row an array, its values flat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {name: found[name] for name in found.files} if hasattr(found, "files") else {"": found}
                for name, a in arrays.items():
                    yield pd.DataFrame({"path": [file], "name": [name], "shape": [list(a.shape)], "dtype": [a.dtype.str], "values": [a.ravel().astype(float).tolist()]})

    return read_files(spark, path).mapInPandas(run, "path string, name string, shape array<int>, dtype string, values array<double>")


def read_patches(spark: SparkSession, path: str, lines: int = 64) -> DataFrame:
    """(path, patch_id, strip_id, row0, col0, img0, img1, mask) of patch archives. Images stand under one of several names, in one shape
    (n, 1, P, P), P divisible by 8; origins under origin_row_col, or the first two columns of origin_row_col_lat_lon. Integers become 0..1."""

    def table(file: str, content: bytes) -> Iterator[pd.DataFrame]:
        found = np.load(io.BytesIO(content), allow_pickle=False)
        data = {k: found[k] for k in found.files}
        a, b = (data[first_column(list(data), list(names), what)] for names, what in ((FIRST, "the first images"), (SECOND, "the second images")))
        if a.shape != b.shape or a.ndim != 4 or a.shape[1] != 1 or a.shape[2] != a.shape[3] or a.shape[3] % 8:
            raise ValueError(f"{file}: images must both be (n, 1, P, P) with P divisible by 8, not {a.shape} and {b.shape}")
        origin = data[first_column(list(data), ["origin_row_col", "origin_row_col_lat_lon"], "origins")][:, :2].astype(np.int64)
        n = len(a)
        ids, strips = data.get("patch_id", np.arange(n)), data.get("strip_id", np.zeros(n, np.int64))
        if len(origin) != n or len(strips) != n:
            raise ValueError(f"{file}: {n} images, {len(origin)} origins, {len(strips)} strips")
        unit = lambda x: x.astype(float) / 255.0 if x.dtype.kind in "ui" else x.astype(float)
        for at in range(0, n, lines):
            some = slice(at, min(at + lines, n))
            flat = lambda x: [y.ravel().tolist() for y in unit(x[some])]  # noqa: B023, E731
            mask = [(y.ravel() > 0).astype(float).tolist() for y in data["mask"][some]] if "mask" in data else [None] * (some.stop - at)
            yield pd.DataFrame({"path": file, "patch_id": ids[some], "strip_id": strips[some], "row0": origin[some, 0], "col0": origin[some, 1], "img0": flat(a), "img1": flat(b), "mask": mask})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                yield from table(file, content)

    schema = "path string, patch_id long, strip_id long, row0 long, col0 long, img0 array<double>, img1 array<double>, mask array<double>"
    return read_files(spark, path).mapInPandas(run, schema)


def read_cube(spark: SparkSession, path: str, header: dict) -> DataFrame:
    """(band, y, x, v) of all complete bands of a band-sequential cube, by its header (text_records.header_info)."""
    from .raw_image import RawImageSource

    spark.dataSource.register(RawImageSource)
    if header.get("interleave", "bsq") != "bsq":
        raise ValueError(f"interleave {header['interleave']} is not supported")
    options = {"lines": header["lines"], "samples": header["samples"], "bands": header["bands"], "offset": header["offset"], "dtype": header["dtype"], "truncated": "true"}
    return spark.read.format("rawimage").options(path=path, **{k: str(v) for k, v in options.items()}).load()


def in_micrometres(wavelength: Column) -> Column:
    """Centres above 50 are in nanometres."""
    return F.when(wavelength > 50, wavelength / 1000.0).otherwise(wavelength)
