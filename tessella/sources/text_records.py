"""Records in text: fixed-width lines, token lines, key = value headers, band tables, geolocation grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

V = F.col

#: 0-based offset and width of the fields of an orbit and attitude record of 628 bytes.
ORBIT_FIELDS = {
    "record_no": (8, 6), "length": (14, 4), "lunar_x": (46, 20), "lunar_y": (66, 20), "lunar_z": (86, 20), "sat_x": (106, 20), "sat_y": (126, 20), "sat_z": (146, 20),
    "vel_x": (166, 12), "vel_y": (178, 12), "vel_z": (190, 12), "qb1": (202, 14), "qb2": (216, 14), "qb3": (230, 14), "qb4": (244, 14), "qe1": (258, 14), "qe2": (272, 14), "qe3": (286, 14), "qe4": (300, 14),
    "qm1": (314, 14), "qm2": (328, 14), "qm3": (342, 14), "qm4": (356, 14), "subsat_lat": (370, 14), "subsat_lon": (384, 14), "sun_azimuth": (398, 14), "sun_elevation": (412, 14), "payload_lat": (426, 14), "payload_lon": (440, 14),
    "altitude": (454, 12), "roll_velocity": (466, 12), "eclipse": (478, 1), "emission": (479, 9), "phase": (488, 9), "yaw_nadir": (497, 9), "slant_range": (506, 10), "orbit_no": (516, 5), "solar_zenith": (521, 9), "fov_velocity": (530, 9),
    "yaw": (539, 16), "roll": (555, 16), "pitch": (571, 16),
}
#: Places and widths of the date's parts.
ORBIT_TIME = {"year": (18, 4), "month": (22, 4), "day": (26, 4), "hour": (30, 4), "minute": (34, 4), "second": (38, 4), "ms": (42, 4)}
_WHOLE = ("record_no", "length", "eclipse", "orbit_no")


def cut(line: Column, offset: int, width: int) -> Column:
    return F.trim(F.substring(line, offset + 1, width))


def parse_fixed(lines: DataFrame, fields: dict[str, tuple[int, int]], whole: tuple[str, ...] = (), line: str = "value") -> DataFrame:
    """Typed columns of fixed-width lines; blank or malformed fields are null."""
    kind = lambda n: "long" if n in whole else "double"
    return lines.select(*[c for c in lines.columns if c != line], *[cut(V(line), *at).try_cast(kind(n)).alias(n) for n, at in fields.items()])


def parse_orbit(lines: DataFrame) -> DataFrame:
    """Orbit and attitude records with ts, to the millisecond."""
    part = {n: cut(V("value"), *at).try_cast("int") for n, at in ORBIT_TIME.items()}
    ts = F.make_timestamp(part["year"], part["month"], part["day"], part["hour"], part["minute"], (part["second"] + part["ms"] / 1000.0).cast("decimal(8,6)"))
    timed = lines.where(F.substring("value", 1, 8) == "ORBTATTD").select("value", ts.alias("ts"))
    return parse_fixed(timed, ORBIT_FIELDS, _WHOLE)


def read_orbit(spark: SparkSession, path: str) -> DataFrame:
    return parse_orbit(spark.read.text(path))


def tokens(lines: DataFrame, wanted: dict[str, int], line: str = "value") -> DataFrame:
    """Blank-separated tokens by position. Abutting fields shift later ones: use fixed widths where they are known."""
    t = F.split(F.trim(line), r"\s+")
    return lines.select(*[F.get(t, i).try_cast("double").alias(n) for n, i in wanted.items()])


def key_values(lines: DataFrame, line: str = "value") -> DataFrame:
    """key = value lines, split at the first sign, keys in lower case, both sides trimmed."""
    parts = F.split(V(line), "=", 2)
    return lines.where(V(line).contains("=")).select(*[c for c in lines.columns if c != line], F.lower(F.trim(parts[0])).alias("key"), F.trim(parts[1]).alias("value"))


#: Element types of raw files, by label and by header code.
LABEL_TYPES = {
    "UnsignedByte": "u1", "SignedByte": "i1", "UnsignedLSB2": "<u2", "SignedLSB2": "<i2", "UnsignedMSB2": ">u2", "SignedMSB2": ">i2", "UnsignedLSB4": "<u4", "SignedLSB4": "<i4", "UnsignedMSB4": ">u4", "SignedMSB4": ">i4",
    "IEEE754LSBSingle": "<f4", "IEEE754MSBSingle": ">f4",
}
HEADER_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4"}


def header_info(pairs: dict[str, str]) -> dict:
    """samples, lines, bands, offset, dtype and interleave of a cube's header."""
    code = int(pairs["data type"])
    if code not in HEADER_TYPES:
        raise ValueError(f"unknown data type {code}")
    order = ">" if int(pairs.get("byte order", "0")) == 1 else "<"
    kind = HEADER_TYPES[code]
    return {"samples": int(pairs["samples"]), "lines": int(pairs["lines"]), "bands": int(pairs.get("bands", "1")), "offset": int(pairs.get("header offset", "0")), "dtype": kind if kind == "u1" else order + kind, "interleave": pairs.get("interleave", "bsq").lower()}


def band_table(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, band, wavelength_um) from elements <band_number> and <center_wavelength> (nanometres) of each text, by band."""
    numbers, waves = (F.regexp_extract_all(V(text), F.lit(rf"<(?:\w+:)?{tag}[^>]*>\s*([0-9.]+)\s*<"), F.lit(1)) for tag in ("band_number", "center_wavelength"))
    both = texts.select(key, F.explode(F.arrays_zip(numbers.alias("n"), waves.alias("w"))).alias("z"))
    return both.select(key, V("z.n").cast("int").alias("band"), (V("z.w").cast("double") / 1000.0).alias("wavelength_um"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Longitude double, Latitude double, Pixel int, Scan int").csv(path, header=True)
