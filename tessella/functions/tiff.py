"""Tagged image files of one band: parsing from byte ranges, block compression, and the parts of a file to write."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

#: Tags, field types (by size and format letter) and compression codes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS = 33550, 33922, 34735
FIELD_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
KINDS = {1: "u", 2: "i", 3: "f"}


def lzw_pack(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, one code early in growing."""
    out, held, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    size, word = 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << size) | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    put(256)
    for value in data:
        longer = word + bytes([value])
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(table[word] if len(word) > 1 else word[0])
        table[longer] = 258 + len(table)
        known = 258 + len(table)
        if known == 4094:
            put(256)
            table, size = {}, 9
        elif known >= 1 << size:
            size += 1
        word = longer[-1:]
    if word:
        put(table[word] if len(word) > 1 else word[0])
        if 258 + len(table) + 1 >= 1 << size and size < 12:
            size += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def lzw_unpack(data: bytes) -> bytes:
    out, table, size, at = [], [], 9, 0
    held, bits, before = 0, 0, b""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    while True:
        while bits < size:
            if at >= len(data):
                return b"".join(out)
            held, bits, at = (held << 8) | data[at], bits + 8, at + 1
        bits -= size
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, size, before = list(first), 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif before:
            word = before + before[:1]
        else:
            raise ValueError("damaged block")
        out.append(word)
        if before:
            table.append(before + word[:1])
        if len(table) >= (1 << size) - 1 and size < 12:
            size += 1
        before = word


def pack(data: bytes, compression: int) -> bytes:
    return {NONE: lambda x: x, LZW: lzw_pack, DEFLATE: zlib.compress}[compression](data)


def unpack(data: bytes, compression: int) -> bytes:
    known = {NONE: lambda x: x, LZW: lzw_unpack, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress}
    if compression not in known:
        raise ValueError(f"compression {compression} is not supported")
    return known[compression](data)


@dataclass
class Image:
    """What a file's first directory says. Blocks are tiles, or strips as wide as the image."""

    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, otherwise=None):
        return self.tags.get(tag, (otherwise,))[0]

    @property
    def shape(self) -> tuple[int, int, int]:
        """Bands, lines, samples."""
        return self.one(SAMPLES, 1), self.one(HEIGHT), self.one(WIDTH)

    @property
    def dtype(self) -> np.dtype:
        kind = KINDS.get(self.one(SAMPLE_FORMAT, 1), "u")
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 8) // 8}")

    @property
    def tiled(self) -> bool:
        return TILE_OFFSETS in self.tags

    @property
    def block(self) -> tuple[int, int]:
        """Lines and samples of a block."""
        if self.tiled:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(ROWS_PER_STRIP, self.shape[1]), self.shape[1]), self.shape[2]

    @property
    def places(self) -> list[tuple[int, int]]:
        """Offset and size of every block."""
        pair = (TILE_OFFSETS, TILE_SIZES) if self.tiled else (STRIP_OFFSETS, STRIP_SIZES)
        return list(zip(*(self.tags[t] for t in pair), strict=True))

    @property
    def geotransform(self) -> tuple | None:
        """(west, step east, 0, north, 0, step south) in the file's coordinates."""
        if PIXEL_SCALE not in self.tags or TIE_POINT not in self.tags:
            return None
        sx, sy = self.tags[PIXEL_SCALE][:2]
        i, j, _, x, y = self.tags[TIE_POINT][:5]
        return x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy

    def decode(self, index: int, data: bytes) -> tuple[int, int, np.ndarray]:
        """First line, first sample, and the values (lines, samples, bands) of a block, cut to the image."""
        bands, lines, samples = self.shape
        h, w = self.block
        across = -(-samples // w)
        y, x = index // across * h, index % across * w
        values = np.frombuffer(unpack(data, self.one(COMPRESSION, NONE)), self.dtype)
        values = values[: len(values) // (w * bands) * (w * bands)].reshape(-1, w, bands)
        if self.one(PREDICTOR, 1) == 2:
            values = np.cumsum(values, axis=1, dtype=values.dtype)
        elif self.one(PREDICTOR, 1) != 1:
            raise ValueError("this predictor is not supported")
        return y, x, values[: lines - y, : samples - x]


def parse(read: Callable[[int, int], bytes]) -> Image:
    """The first directory, through ``read(offset, length)``: only the ranges that it names are read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        raise ValueError("not a tagged image file")
    number = lambda fmt, data: struct.unpack(order + fmt, data[: struct.calcsize(order + fmt)])
    big = number("H", head[2:])[0] == 43
    at = number("Q", head[8:])[0] if big else number("I", head[4:])[0]
    count_fmt, entry, fmt, room = ("Q", 20, "HHQ", 8) if big else ("H", 12, "HHI", 4)
    count = number(count_fmt, read(at, 8))[0]
    at += struct.calcsize(order + count_fmt)
    table = read(at, entry * count)
    image = Image(order)
    for i in range(count):
        row = table[i * entry : (i + 1) * entry]
        tag, kind, n = number(fmt, row)
        if kind not in FIELD_TYPES:
            continue
        values = f"{n * len(FIELD_TYPES[kind])}{FIELD_TYPES[kind][0]}"
        size = struct.calcsize(order + values)
        inline = row[-room:]
        data = inline if size <= room else read(number("Q" if big else "I", inline)[0], size)
        image.tags[tag] = number(values, data)
    if image.shape[1] is None or image.shape[2] is None:
        raise ValueError("the file gives no size")
    return image


def sparse_reader(ranges: dict[int, bytes]) -> Callable[[int, int], bytes]:
    """A read function over the parts of a file that are at hand: offset -> bytes."""

    def read(offset: int, length: int) -> bytes:
        for start, data in ranges.items():
            if start <= offset < start + len(data):
                return data[offset - start : offset - start + length]
        raise ValueError(f"bytes at {offset} are not at hand")

    return read


def directory(height: int, width: int, dtype: str, compression: int, tile: int, blocks: list[tuple[int, int]], at: int, geotransform: tuple | None = None) -> tuple[bytes, bytes]:
    """The header, and the directory to stand at ``at``, of a tiled file of the large variant."""
    kind = np.dtype(dtype)
    geo = {}
    if geotransform:
        west, sx, _, north, _, sy = geotransform
        geo = {PIXEL_SCALE: ("d", (sx, -sy, 0.0)), TIE_POINT: ("d", (0.0, 0.0, 0.0, west, north, 0.0)), GEO_KEYS: ("H", (1, 1, 0, 2, 1024, 0, 1, 2, 1025, 0, 1, 1))}
    tags = {
        WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (kind.itemsize * 8,)), COMPRESSION: ("H", (compression,)), PHOTOMETRIC: ("H", (1,)), SAMPLES: ("H", (1,)), TILE_WIDTH: ("I", (tile,)), TILE_HEIGHT: ("I", (tile,)),
        TILE_OFFSETS: ("Q", tuple(o for o, _ in blocks)), TILE_SIZES: ("Q", tuple(n for _, n in blocks)), SAMPLE_FORMAT: ("H", ({v: k for k, v in KINDS.items()}[kind.kind],)), **geo,
    }
    codes = {"H": 3, "I": 4, "d": 12, "Q": 16}
    rows, beyond = [], b""
    after = at + 8 + 20 * len(tags) + 8
    for tag, (fmt, values) in sorted(tags.items()):
        data = struct.pack(f"<{len(values)}{fmt}", *values)
        if len(data) > 8:
            place = struct.pack("<Q", after + len(beyond))
            beyond += data + b"\0" * (-len(data) % 8)
        else:
            place = data.ljust(8, b"\0")
        rows.append(struct.pack("<HHQ", tag, codes[fmt], len(values)) + place)
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at), struct.pack("<Q", len(rows)) + b"".join(rows) + struct.pack("<Q", 0) + beyond
