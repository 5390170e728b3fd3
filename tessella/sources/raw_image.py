"""A Python data source for headerless rasters and band-sequential cubes.

Partitions are ranges of lines of one band; filters on band and y prune the others, so a window of one band of a large cube
costs that window's lines. A worker reads and yields a few lines at a time. The path must be mounted by the driver and all
executors. Truncated cubes give the bands that are complete; a raster that is too short raises.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

BATCH = 1 << 18


class LineRange(InputPartition):
    def __init__(self, band: int, first: int, last: int):
        self.band, self.first, self.last = band, first, last


class RawImageSource(DataSource):
    """Options: path, lines, samples, bands (1), offset (0), dtype (numpy's name), rows_per_partition (4096), truncated (false)."""

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return "band int, y int, x int, v double"

    def reader(self, schema) -> RawImageReader:
        return RawImageReader(self.options)


class RawImageReader(DataSourceReader):
    def __init__(self, options):
        import os

        import numpy as np

        self.path = options["path"].removeprefix("file://")
        self.lines, self.samples = int(options["lines"]), int(options["samples"])
        self.offset, self.dtype = int(options.get("offset", 0)), options["dtype"]
        self.rows = int(options.get("rows_per_partition", 4096))
        self.band_bytes = self.lines * self.samples * np.dtype(self.dtype).itemsize
        wanted = int(options.get("bands", 1))
        complete = (os.path.getsize(self.path) - self.offset) // self.band_bytes
        if complete < 1 or (complete < wanted and options.get("truncated", "false") != "true"):
            raise ValueError(f"{self.path} holds {complete} of {wanted} bands")
        self.bands = range(min(wanted, complete))
        self.first, self.last = 0, self.lines

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("band",):
                self.bands = [b for b in self.bands if b == f.value]
            else:
                if getattr(f, "attribute", None) == ("y",):  # lines are pruned; Spark filters what is left
                    if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                        self.first = max(self.first, int(f.value) + isinstance(f, GreaterThan))
                    if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                        self.last = min(self.last, int(f.value) + (not isinstance(f, LessThan)))
                yield f

    def partitions(self) -> list[LineRange]:
        return [LineRange(b, y, min(y + self.rows, self.last)) for b in self.bands for y in range(self.first, self.last, self.rows)]

    def read(self, part: LineRange | None):
        import numpy as np
        import pyarrow as pa

        if part is None:  # no band is left
            return
        kind = np.dtype(self.dtype)
        lines = max(1, BATCH // self.samples)
        with open(self.path, "rb") as file:
            file.seek(self.offset + part.band * self.band_bytes + part.first * self.samples * kind.itemsize)
            for first in range(part.first, part.last, lines):
                values = np.frombuffer(file.read(min(lines, part.last - first) * self.samples * kind.itemsize), kind)
                at = np.arange(len(values))
                columns = [np.full(len(values), part.band, np.int32), (first + at // self.samples).astype(np.int32), (at % self.samples).astype(np.int32), values.astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "y", "x", "v"])


def read_lines(spark: SparkSession, path: str, lines: int, samples: int, dtype: str) -> DataFrame:
    """(band, y, x, v) of a headerless file in any store that Spark reads, without a mounted path: lines are records of fixed length,
    split among tasks by Spark's own reader, and numbered by their place. Nothing is pruned; a file that ends amid a line raises."""
    import numpy as np
    import pyarrow as pa

    kind = np.dtype(dtype)
    records = spark.sparkContext.binaryRecords(path, samples * kind.itemsize).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))
    rows = spark.createDataFrame(records, "line long, content binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, content in zip(batch.column("line").to_pylist(), batch.column("content").to_pylist(), strict=True):
                values = np.frombuffer(content, kind).astype(np.float64)
                columns = [np.full(samples, line // lines, np.int32), np.full(samples, line % lines, np.int32), np.arange(samples, dtype=np.int32), values]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["band", "y", "x", "v"])

    return rows.mapInArrow(run, "band int, y int, x int, v double")


def nearest_band(wavelengths: dict[int, float], available: int, target: float) -> int:
    """The band among the first ``available`` whose wavelength is nearest to ``target``, the first of equals; 0 without a table."""
    known = {b: w for b, w in wavelengths.items() if b < available}
    return min(sorted(known), key=lambda b: abs(known[b] - target)) if known else 0
