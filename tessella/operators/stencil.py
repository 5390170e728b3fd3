"""Neighbourhood operators on dense pixels(product, y, x, v).

Separable stencils run as two passes of offset windows, along rows and along columns, so no pixel is copied. Others join a
pixel to its neighbours' coordinates. Rows and columns, not whole rasters, are the windows' partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clip, divide, euclid, is_valid, join_same, truncate
from .radiometry import normalize_masked, percentiles

V = F.col


def row():
    return Window.partitionBy("product", "y").orderBy("x")


def column():
    return Window.partitionBy("product", "x").orderBy("y")


def _difference(v: Column, w) -> Column:
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.coalesce(F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2.0), F.lit(0.0))


def gradient(df: DataFrame, value: str = "v") -> DataFrame:
    """Adds gx and gy: central differences, one-sided at the edges."""
    return df.withColumn("gx", _difference(V(value), row())).withColumn("gy", _difference(V(value), column()))


def _reflected_sum(v: Column, w, radius: int) -> Column:
    total = v
    for d in range(1, radius + 1):
        for step, back in ((F.lag, F.lead), (F.lead, F.lag)):
            # d units beyond, mirrored at the edge pixel when outside: the mirror of an outside pixel is 2*edge - place
            value = F.coalesce(step(v, d).over(w), *[F.when(step(v, k).over(w).isNotNull() & step(v, k + 1).over(w).isNull(), _at(v, w, back, d - 2 * k)) for k in range(d - 1, 0, -1)], _at(v, w, back, d))
            total = total + value
    return total


def _at(v: Column, w, back, d: int) -> Column:
    forward = F.lag if back is F.lead else F.lead
    return v if d == 0 else (back(v, d).over(w) if d > 0 else forward(v, -d).over(w))


def box_mean(df: DataFrame, radius: int = 2, *, floor: bool = True) -> DataFrame:
    """Mean over (2r+1)^2 pixels, mirrored at edges without repeating the edge, truncated."""
    once = df.withColumn("h_", _reflected_sum(V("v"), row(), radius))
    mean = _reflected_sum(V("h_"), column(), radius) / float((2 * radius + 1) ** 2)
    return once.withColumn("v", truncate(mean) if floor else mean).drop("h_")


def dilate_cross(df: DataFrame) -> DataFrame:
    """Maximum over a pixel and its four neighbours."""
    around = [F.lag("v").over(row()), F.lead("v").over(row()), F.lag("v").over(column()), F.lead("v").over(column())]
    return df.withColumn("n_", F.array(*around)).withColumn("v", F.greatest(V("v"), *[F.coalesce(V("n_")[i], V("v")) for i in range(4)])).drop("n_")


def _window(df: DataFrame, radius: int) -> DataFrame:
    """Adds around: rows of values from ``radius`` above to ``radius`` below, each from left to right, edges replicated. Two passes of
    offset windows, so a raster moves twice whatever the radius."""

    def line(v: Column, w) -> Column:
        before = [F.lag(v, d).over(w) for d in range(radius, 0, -1)]
        after = [F.lead(v, d).over(w) for d in range(1, radius + 1)]
        left = [F.coalesce(*before[i:], v) for i in range(radius)]
        right = [F.coalesce(*reversed(after[: i + 1]), v) for i in range(radius)]
        return F.array(*left, v, *right)

    return df.withColumn("h_", line(V("v"), row())).withColumn("around", line(V("h_"), column())).drop("h_")


def median_blur(df: DataFrame, size: int = 5) -> DataFrame:
    """Median over size x size pixels, edges replicated."""
    middle = (size * size) // 2
    return _window(df, size // 2).withColumn("v", F.array_sort(F.flatten("around"))[middle].cast("double")).drop("around")


def bilateral(df: DataFrame, diameter: int = 5, sigma_color: float = 50.0, sigma_space: float = 50.0) -> DataFrame:
    """Mean over a disc, weighted by closeness in place and value."""
    r = diameter // 2
    near = _window(df, r)
    total, weights = F.lit(0.0), F.lit(0.0)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                n = V("around")[dy + r][dx + r]
                w = F.exp(F.lit(-(dy * dy + dx * dx) / (2.0 * sigma_space**2)) - F.pow(n - V("v"), F.lit(2)) / (2.0 * sigma_color**2))
                total, weights = total + w * n, weights + w
    return near.withColumn("v", total / weights).drop("around")


def gradient_magnitude(df: DataFrame) -> DataFrame:
    """Gradient length of the stretched raster, over its 99th percentile of positive values, times 255, truncated; 0 outside."""
    g = gradient(normalize_masked(df)).withColumn("g", F.when(V("valid"), euclid(V("gx"), V("gy"))).otherwise(0.0))
    scale = percentiles(g.withColumn("v", V("g")), 50, 99, ["product"], V("g") > 0, discrete=False).select("product", V("hi_").alias("p_"))
    scaled = clip(divide(V("g"), V("p_")), 0, 1) * 255.0
    return join_same(g, scale, "product").select("product", "y", "x", truncate(scaled).alias("v"))


def orientation(df: DataFrame) -> DataFrame:
    """c and s: cosine and sine of twice the gradient's angle, times its length; 0 where invalid."""
    g = gradient(normalize_masked(df))
    m, t = euclid(V("gx"), V("gy")), 2.0 * F.atan2(V("gy"), V("gx"))
    on = V("valid").cast("double")
    return g.select("product", "y", "x", (F.cos(t) * m * on).alias("c"), (F.sin(t) * m * on).alias("s"))


def support(df: DataFrame) -> DataFrame:
    """Adds inside: between the first and the last valid pixel of the row, gaps included."""
    w = Window.partitionBy("product", "y")
    hit = F.when(V("v") > 0, V("x"))
    return df.withColumn("inside", F.coalesce(V("x").between(F.min(hit).over(w), F.max(hit).over(w)), F.lit(False)))


def left_justify(df: DataFrame, width: int) -> DataFrame:
    """Rows moved so that the first valid pixel is at 0, cut or filled to ``width`` with zeros."""
    left = F.min(F.when(V("v") > 0, V("x"))).over(Window.partitionBy("product", "y"))
    moved = df.withColumn("x", V("x") - left).where(V("x").between(0, width - 1))
    grid = df.select("product", "y").distinct().withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
    return join_same(grid, moved.select("product", "y", V("x").cast("long").alias("x"), "v"), "product", "y", "x", how="left").select("product", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def equalize_adaptive(df: DataFrame, clip_limit: float = 2.0, tiles: int = 8) -> DataFrame:
    """Contrast-limited adaptive equalisation of 0..255 values: clipped histograms per tile, their cumulative tables, and
    bilinear blending of the four nearest tables. Rasters are taken to fill the tiles evenly."""
    size = df.groupBy("product").agg(F.ceil((F.max("y") + 1) / tiles).alias("th_"), F.ceil((F.max("x") + 1) / tiles).alias("tw_"))
    px = join_same(df, size, "product").withColumn("b_", V("v").cast("int")).withColumn("ty", F.floor(V("y") / V("th_"))).withColumn("tx", F.floor(V("x") / V("tw_")))
    hist = px.groupBy("product", "ty", "tx", "b_").agg(F.count(F.lit(1)).alias("n"))
    area = hist.groupBy("product", "ty", "tx").agg(F.sum("n").alias("area"))
    bins = area.withColumn("b_", F.explode(F.sequence(F.lit(0), F.lit(255)))).transform(lambda t: join_same(t, hist, "product", "ty", "tx", "b_", how="left")).withColumn("n", F.coalesce("n", F.lit(0)))
    limit = F.greatest(F.floor(clip_limit * V("area") / 256), F.lit(1))
    tile = Window.partitionBy("product", "ty", "tx")
    bins = bins.withColumn("kept", F.least(V("n"), limit)).withColumn("spare", F.sum(V("n") - V("kept")).over(tile)).withColumn("kept", V("kept") + V("spare") / 256.0)
    lut = bins.withColumn("lut", clip(F.rint(F.round(F.sum("kept").over(tile.orderBy("b_")) * 255.0 / V("area"), 9)), 0, 255)).select("product", "ty", "tx", "b_", "lut")
    last = F.lit(float(tiles - 1))
    fy, fx = (V("y") + 0.5) / V("th_") - 0.5, (V("x") + 0.5) / V("tw_") - 0.5
    y0, x0 = F.floor(fy), F.floor(fx)
    corner = lambda dy, dx: F.struct(clip_long(y0 + dy, last).alias("ty"), clip_long(x0 + dx, last).alias("tx"), ((fy - y0 if dy else 1 - (fy - y0)) * (fx - x0 if dx else 1 - (fx - x0))).alias("w"))
    wide = px.drop("ty", "tx").withColumn("c", F.explode(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)]))).select("product", "y", "x", "b_", "c.*")
    present = join_same(wide, lut, "product", "ty", "tx", "b_")
    return present.groupBy("product", "y", "x").agg((F.sum(V("lut") * V("w")) / F.sum("w")).alias("v")).withColumn("v", F.rint(F.round("v", 9)))


def clip_long(v: Column, last: Column) -> Column:
    return F.least(F.greatest(v.cast("double"), F.lit(0.0)), last).cast("long")


def valid_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("valid", is_valid(V("v")))


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = step(df)
    return df
