"""Footprints, distances and coordinate models. Corners are columns or ARRAY<STRUCT<lon, lat>> rings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.safe import join_same

V = F.col
#: Fixed value: the Moon's radius in metres.
MOON_RADIUS = 1_737_400.0
SEGMENT = 0.005


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = MOON_RADIUS) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)))


def bilinear(ul: Column, ur: Column, lr: Column, ll: Column, x: Column, y: Column) -> Column:
    return (1 - x) * (1 - y) * ul + x * (1 - y) * ur + (1 - x) * y * ll + x * y * lr


def edge_longitude(lat: Column, top_lat: Column, top_lon: Column, bottom_lat: Column, bottom_lon: Column) -> Column:
    return top_lon + (top_lat - lat) / (top_lat - bottom_lat) * (bottom_lon - top_lon)


def circular_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360 - d)


def affine(origin: Column, step: Column, index: Column) -> Column:
    """Coordinate of a pixel's centre."""
    return origin + (index + 0.5) * step


def affine_row(origin: Column, step: Column, coordinate: Column) -> Column:
    """The index whose pixel holds a coordinate: the inverse of affine()."""
    return F.floor((coordinate - origin) / step).cast("long")


def row_range(lat_top: Column, lat_bottom: Column, origin: Column, step: Column, rows: int) -> tuple[Column, Column]:
    """First and last row of a raster that lie between two latitudes, cut to the raster."""
    bound = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(rows - 1))).cast("long")
    a, b = affine_row(origin, step, lat_top), affine_row(origin, step, lat_bottom)
    return bound(F.least(a, b)), bound(F.greatest(a, b))


def browse_scale(full_width: Column, full_height: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Full-resolution pixels for one of a browse image, across and along."""
    return full_width / width, full_height / height


def common_grid(lat_top: Column, lat_bottom: Column, lon_top: Column, lon_bottom: Column, step: float = 5.687) -> tuple[Column, Column, Column]:
    """Rows, and columns at the top and bottom, of a grid of square cells over a corridor."""
    degree = math.pi * MOON_RADIUS / 180
    rows = F.rint(F.abs(lat_top - lat_bottom) * degree / step)
    side = lambda width, lat: F.rint(width * degree * F.cos(F.radians(lat)) / step)
    return rows.cast("int"), side(lon_top, lat_top).cast("int"), side(lon_bottom, lat_bottom).cast("int")


def edges(rings: DataFrame, key: str) -> DataFrame:
    """(key, i, lon1, lat1, lon2, lat2): the sides of closed rings (an ARRAY column named ring, not repeating its start)."""
    n = F.size("ring")
    side = F.transform(V("ring"), lambda p, i: F.struct(i.alias("i"), p["lon"].alias("lon1"), p["lat"].alias("lat1"), F.get(V("ring"), (i + 1) % n)["lon"].alias("lon2"), F.get(V("ring"), (i + 1) % n)["lat"].alias("lat2")))
    return rings.select(key, F.explode(side).alias("s")).select(key, "s.*")


def footprint_area(rings: DataFrame, key: str) -> DataFrame:
    """Area in km2 on the equal-area cylinder; sides are cut into parts of at most SEGMENT degrees first."""
    sides = edges(rings, key)
    parts = F.greatest(F.ceil(F.sqrt(F.pow(V("lon2") - V("lon1"), F.lit(2)) + F.pow(V("lat2") - V("lat1"), F.lit(2))) / SEGMENT), F.lit(1))
    cut = sides.withColumn("n", parts).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), V("n") - 1)))
    at = lambda a, b, j: V(a) + (V(b) - V(a)) * (j / V("n"))
    x = lambda j: MOON_RADIUS * F.radians(at("lon1", "lon2", j))
    y = lambda j: MOON_RADIUS * F.sin(F.radians(at("lat1", "lat2", j)))
    cross = x(V("j")) * y(V("j") + 1) - x(V("j") + 1) * y(V("j"))
    return cut.groupBy(key).agg((F.abs(F.sum(cross)) / 2e6).alias("area_km2"))


def scanlines(rings: DataFrame, key: str, lat0: float, step: float, rows: int) -> DataFrame:
    """(key, row, lat, lo, hi): the longitudes between which each row's centre line lies in the ring. A side makes rows for
    the lines that it crosses only."""
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    a, b = ((high if step < 0 else low) - lat0) / step - 0.5, ((low if step < 0 else high) - lat0) / step - 0.5
    lines = F.sequence(F.greatest(F.floor(F.least(a, b)), F.lit(0)), F.greatest(F.least(F.ceil(F.greatest(a, b)), F.lit(rows - 1)), F.lit(0)))
    hit = edges(rings, key).withColumn("row", F.explode(lines)).withColumn("lat", F.lit(lat0) + (V("row") + 0.5) * step).where((V("lat") >= low) & (V("lat") <= high) & (V("lat1") != V("lat2")))
    lon = V("lon1") + (V("lat") - V("lat1")) / (V("lat2") - V("lat1")) * (V("lon2") - V("lon1"))
    return hit.groupBy(key, "row", "lat").agg(F.min(lon).alias("lo"), F.max(lon).alias("hi"))


def clip_ring(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a convex ring inside another: half-planes of the window cut it one by one."""

    def area2(p: np.ndarray) -> float:
        q = np.roll(p, -1, 0)
        return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())

    if area2(window) < 0:
        window = window[::-1]
    out = subject
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, side2 = np.roll(out, -1, 0), np.roll(side, -1)
        made = []
        for p, q, s, t in zip(out, nxt, side, side2, strict=True):
            if s >= 0:
                made.append(p)
            if (s > 0 > t) or (s < 0 < t):
                made.append(p + (q - p) * (s / (s - t)))
        out = np.array(made).reshape(-1, 2)
    return out


_RING = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def intersect(pairs: DataFrame, ring_a: str = "ring_a", ring_b: str = "ring_b") -> DataFrame:
    """Adds ring: the intersection of two convex rings, empty if there is none. A ring that is not convex raises."""

    def points(ring) -> np.ndarray:
        out = np.array([(p["lon"], p["lat"]) for p in ring], float)
        side, turn = np.roll(out, -1, 0) - out, np.roll(out, -2, 0) - np.roll(out, -1, 0)
        turns = side[:, 0] * turn[:, 1] - side[:, 1] * turn[:, 0]
        if len(out) < 3 or not ((turns >= -1e-12).all() or (turns <= 1e-12).all()):
            raise ValueError(f"ring is not convex: {out.tolist()}")
        return out

    @F.pandas_udf(_RING)
    def clip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"lon": x, "lat": y} for x, y in clip_ring(points(p), points(q))] for p, q in zip(a, b, strict=True)])

    return pairs.withColumn("ring", clip(ring_a, ring_b))


def unordered_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b) of all pairs of rows with key_a < key_b; as many as asked for, so for lists of products."""
    a, b = (rows.select(V(key).alias(f"{key}_{s}")) for s in "ab")
    return a.join(b, V(f"{key}_a") < V(f"{key}_b"))


def overlaps(rings: DataFrame, key: str, disjoint: bool = True) -> DataFrame:
    """For each unordered pair of footprints: area shared, the share of either, and the bounds; 0 and null if they are disjoint.

    What may meet is found by latitude bands of one degree, so footprints far apart are never intersected. ``disjoint``: also list the
    pairs that do not meet, which is every pair there is; without them the result grows with the neighbours only.
    """
    band = lambda f: F.floor(f(F.transform("ring", lambda p: p["lat"])))
    dealt = rings.withColumn("band", F.explode(F.sequence(band(F.array_min), band(F.array_max))))
    a, b = (dealt.select(V(key).alias(f"{key}_{s}"), V("ring").alias(f"ring_{s}"), "band") for s in "ab")
    pairs = a.join(b, "band").where(V(f"{key}_a") < V(f"{key}_b")).dropDuplicates([f"{key}_a", f"{key}_b"]).drop("band")
    cut = intersect(pairs).withColumn("pair", F.struct(f"{key}_a", f"{key}_b"))
    shared = footprint_area(cut.where(F.size("ring") > 2).select("pair", "ring"), "pair").withColumnRenamed("area_km2", "shared_km2")
    own = footprint_area(rings.select(key, "ring"), key)
    met = cut.select("pair", f"{key}_a", f"{key}_b", "ring").join(shared, "pair", "left").drop("pair")
    if disjoint:
        met = unordered_pairs(rings, key).join(met, [f"{key}_a", f"{key}_b"], "left")
    else:
        met = met.where("shared_km2 > 0")
    out = met.join(own.select(V(key).alias(f"{key}_a"), V("area_km2").alias("area_a")), f"{key}_a").join(own.select(V(key).alias(f"{key}_b"), V("area_km2").alias("area_b")), f"{key}_b")
    area = F.coalesce("shared_km2", F.lit(0.0))
    bound = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return out.select(
        f"{key}_a", f"{key}_b", area.alias("shared_km2"), (area / V("area_a") * 100).alias("percent_a"), (area / V("area_b") * 100).alias("percent_b"),
        *[bound(f, c).alias(n) for n, f, c in (("lon_min", F.array_min, "lon"), ("lon_max", F.array_max, "lon"), ("lat_min", F.array_min, "lat"), ("lat_max", F.array_max, "lat"))],
    )


def wkt(ring: Column) -> Column:
    point = lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(F.concat(ring, F.slice(ring, 1, 1)), point), ","), F.lit("))"))


def from_wkt(text: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(-?[0-9.]+(?:E-?[0-9]+)? -?[0-9.]+(?:E-?[0-9]+)?)"), F.lit(1)), lambda p: F.split(p, " "))
    return F.transform(F.slice(numbers, F.lit(1), F.size(numbers) - 1), lambda p: F.struct(p[0].cast("double").alias("lon"), p[1].cast("double").alias("lat")))


def inverse_search(targets: DataFrame, rounds: int = 8, steps: int = 30) -> DataFrame:
    """Adds bx, by in 0..1: where the bilinear corner model (columns ul_lat ... ll_lon) comes nearest to (lat, lon). Each round
    tries a grid around the best place so far and narrows it fivefold; the first of equals wins, as it does in a scan by rows."""
    out = targets.withColumn("bx", F.lit(0.5)).withColumn("by", F.lit(0.5))
    radius = 0.5
    index = F.sequence(F.lit(0), F.lit(steps))
    for _ in range(rounds):
        place = lambda b, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), b - radius + 2 * radius * i / steps))  # noqa: E731, B023
        grid = F.flatten(F.transform(index, lambda iy: F.transform(index, lambda ix: F.struct(place(V("bx"), ix).alias("x"), place(V("by"), iy).alias("y")))))
        model = lambda c, p: bilinear(V(f"ul_{c}"), V(f"ur_{c}"), V(f"lr_{c}"), V(f"ll_{c}"), p["x"], p["y"])
        error = lambda p: F.pow(model("lat", p) - V("lat"), F.lit(2)) + F.pow(model("lon", p) - V("lon"), F.lit(2))
        best = F.array_min(F.transform(grid, lambda p, i: F.struct(error(p).alias("e"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
        out = out.withColumn("best", best).withColumn("bx", V("best.x")).withColumn("by", V("best.y")).drop("best")
        radius /= 5
    return out


def crop_window(pixels: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Bounds of the pixels (px, py) of each key with a margin of a tenth, ten pixels at least, inside the raster."""
    b = pixels.groupBy(key).agg(F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"))
    for axis, size in (("x", width), ("y", height)):
        margin = F.greatest(F.lit(10), F.floor((V(f"{axis}1") - V(f"{axis}0")) * 0.10))
        low, high = F.greatest(F.lit(0), V(f"{axis}0") - margin), F.least(F.lit(size - 1), V(f"{axis}1") + margin)
        b = b.withColumn(f"{axis}off", low.cast("long")).withColumn(f"{axis}size", (high - low + 1).cast("long"))
    return b.select(key, "xoff", "yoff", "xsize", "ysize")


def boundary_walk(grid: DataFrame) -> DataFrame:
    """(ord, x, y, lon, lat) of a grid's outline: top rightward, right downward, bottom leftward, left upward, each cell once but
    the start, which also ends it."""
    ends = grid.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    g = grid.join(F.broadcast(ends))  # one row
    sides = [(V("y") == V("y0"), V("x") - V("x0")), ((V("x") == V("x1")) & (V("y") > V("y0")), V("y")), ((V("y") == V("y1")) & (V("x") < V("x1")), -V("x")), ((V("x") == V("x0")) & (V("y") < V("y1")), -V("y"))]
    side = F.filter(F.array(*[F.when(on, F.struct(F.lit(i).alias("side"), at.cast("double").alias("at"))) for i, (on, at) in enumerate(sides)]), lambda s: s.isNotNull())
    walked = g.withColumn("s", F.explode(side))
    return walked.select(F.row_number().over(Window.orderBy("s.side", "s.at")).alias("ord"), "x", "y", "lon", "lat")


def to_equirectangular(lon: Column, lat: Column, lon0: float = 0.0, lat0: float = 0.0, radius: float = MOON_RADIUS) -> tuple[Column, Column]:
    """Metres east and north on the cylinder that is true along the parallel lat0."""
    return radius * F.radians(lon - lon0) * math.cos(math.radians(lat0)), radius * F.radians(lat)


def from_equirectangular(x: Column, y: Column, lon0: float = 0.0, lat0: float = 0.0, radius: float = MOON_RADIUS) -> tuple[Column, Column]:
    return F.degrees(x / (radius * math.cos(math.radians(lat0)))) + lon0, F.degrees(y / radius)


def reproject(pixels: DataFrame, source: tuple, target: tuple, height: int, width: int, inverse=None) -> DataFrame:
    """pixels(product, y, x, v) on another grid, bilinear. ``source`` and ``target`` are geotransforms (west, step east, 0, north, 0, step
    south); ``inverse`` takes target coordinates to source coordinates (by default they are the same), as from_equirectangular() does. Cells
    whose four neighbours are not all there have no pixel. A target cell meets its neighbours by an equi-join on their places."""
    rows = pixels.select("product").distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long")))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    at = affine(F.lit(target[0]), F.lit(target[1]), V("x")), affine(F.lit(target[3]), F.lit(target[5]), V("y"))
    lon, lat = inverse(*at) if inverse else at
    placed = rows.withColumn("sx", (lon - source[0]) / source[1] - 0.5).withColumn("sy", (lat - source[3]) / source[5] - 0.5)
    placed = placed.withColumn("fx", V("sx") - F.floor("sx")).withColumn("fy", V("sy") - F.floor("sy"))
    near = lambda d, f: F.when(F.lit(d) == 1, V(f)).otherwise(1 - V(f))
    corner = lambda dy, dx: F.struct((F.floor("sy") + dy).alias("ny"), (F.floor("sx") + dx).alias("nx"), (near(dy, "fy") * near(dx, "fx")).alias("w"))
    wide = placed.withColumn("c", F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)]))).select("product", "y", "x", "c.*").where("w > 0")
    values = pixels.select("product", V("y").cast("long").alias("ny"), V("x").cast("long").alias("nx"), "v")
    met = join_same(wide, values, "product", "ny", "nx", how="left")
    mean = met.groupBy("product", "y", "x").agg(F.sum(V("w") * V("v")).alias("v"), F.count_if(V("v").isNull()).alias("missing"))
    return mean.where("missing = 0").select("product", "y", "x", "v")
