"""Bins, areas and grids: resampling along rows, padding, trimming and tiling of pixels(product, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import join_same, truncate

V = F.col


def bin_edge(i: Column, n: Column, bins: Column) -> Column:
    """Edge i of ``bins`` even bins over n samples, truncated in floating point; the last edge is n."""
    return F.when(i == bins, n).otherwise(F.floor(i * (n.cast("double") / bins)))


def bin_means(df: DataFrame, bins: Column | int, *, half_even: bool) -> DataFrame:
    """Row-wise means over even bins; empty bins give 0. ``bins`` may vary by row (an expression of y).

    A sum of short decimals falls beside the integer or the half that it stands for, on a side that depends on the order of its terms, so a
    mean is rounded to 6 digits before it is cut, and to 9 before a tie is judged.
    """
    bins = F.lit(bins) if isinstance(bins, int) else bins
    rows = df.groupBy("product", "y").agg((F.max("x") + 1).alias("n")).withColumn("bins", bins.cast("int"))
    edges = rows.withColumn("i", F.explode(F.sequence(F.lit(0), V("bins") - 1)))
    edges = edges.select("product", "y", V("i").cast("long").alias("bin"), bin_edge(V("i"), V("n"), V("bins")).alias("a"), bin_edge(V("i") + 1, V("n"), V("bins")).alias("b"))
    px = df.select(V("product").alias("p_"), V("y").alias("y_"), "x", "v")
    met = edges.join(px, V("product").eqNullSafe(V("p_")) & (V("y") == V("y_")) & (V("x") >= V("a")) & (V("x") < V("b")), "left")
    mean = F.coalesce(F.avg("v"), F.lit(0.0))
    return met.groupBy("product", "y", V("bin").alias("x")).agg((F.rint(F.round(mean, 9)).cast("long") if half_even else truncate(F.round(mean, 6))).alias("v"))


def area_resize(df: DataFrame, height: int, width: int) -> DataFrame:
    """Means weighted by the area that a pixel shares with a target cell."""
    size = df.groupBy("product").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    px = join_same(df, size, "product")
    for axis, old, new in (("y", "h", height), ("x", "w", width)):
        scale = V(old).cast("double") / new
        first, last = F.floor(V(axis) / scale), F.least(F.floor((V(axis) + 1 - 1e-9) / scale), F.lit(new - 1))
        px = px.withColumn(f"t{axis}", F.explode(F.sequence(first, last)))
        px = px.withColumn(f"o{axis}", F.least(V(axis) + 1, (V(f"t{axis}") + 1) * scale) - F.greatest(V(axis), V(f"t{axis}") * scale))
    weight = V("oy") * V("ox")
    return px.groupBy("product", V("ty").alias("y"), V("tx").alias("x")).agg((F.sum(V("v") * weight) / F.sum(weight)).alias("v"))


def block_mean(df: DataFrame, k: int) -> DataFrame:
    return df.groupBy("product", F.floor(V("y") / k).alias("y"), F.floor(V("x") / k).alias("x")).agg(F.avg("v").alias("v"))


def pad_to_multiple(df: DataFrame, multiple: int = 8) -> DataFrame:
    """Zeros below and to the right up to a multiple; adds valid (v > 0)."""
    up = lambda c: (F.ceil((F.max(c) + 1) / multiple) * multiple).cast("long")
    grid = df.groupBy("product").agg(up("y").alias("h"), up("x").alias("w"))
    grid = grid.select("product", "h", "w", F.explode(F.sequence(F.lit(0).cast("long"), V("h") - 1)).alias("y")).select("product", "y", F.explode(F.sequence(F.lit(0).cast("long"), V("w") - 1)).alias("x"))
    return join_same(grid, df.select("product", "y", "x", "v"), "product", "y", "x", how="left").select("product", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce(V("v") > 0, F.lit(False)).alias("valid"))


def trim_ramp(df: DataFrame, top: int, bottom: int) -> DataFrame:
    """Rows cut to a width that runs from ``top`` to ``bottom``; a single row has ``top``."""
    last = df.groupBy("product").agg(F.max("y").alias("last"))
    width = F.rint(top + F.coalesce(F.try_divide(V("y"), V("last")), F.lit(0.0)) * (bottom - top))
    return join_same(df, last, "product").where(V("x") < width).drop("last")


def window_crop(df: DataFrame, y0: int, height: int, x0: int, width: int) -> DataFrame:
    return df.where(V("y").between(y0, y0 + height - 1) & V("x").between(x0, x0 + width - 1))


def patchify(df: DataFrame, size: int) -> DataFrame:
    """product, py, px, values: pixels of each size x size patch in row order."""
    cell = F.struct(V("y"), V("x"), V("v"))
    grouped = df.groupBy("product", F.floor(V("y") / size).alias("py"), F.floor(V("x") / size).alias("px")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
    return grouped.select("product", "py", "px", F.transform("c", lambda c: c["v"]).alias("values"))


def unpatchify(patches: DataFrame, size: int) -> DataFrame:
    return patches.select("product", "py", "px", F.posexplode("values").alias("i", "v")).select("product", (V("py") * size + F.floor(V("i") / size)).alias("y"), (V("px") * size + V("i") % size).alias("x"), "v")


def cubic_taps(at: Column, taps: Column) -> Column:
    """Cubic interpolation (a = -0.75) at place ``at`` from an array of the four samples around it."""
    t = at - F.floor(at)
    a = -0.75
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return far(t + 1) * taps[0] + near(t) * taps[1] + near(1 - t) * taps[2] + far(2 - t) * taps[3]


def _resample_axis(df: DataFrame, axis: str, scale: float) -> DataFrame:
    """One pass: each output place finds its four samples, edges replicated, through offset windows along the axis. A sample makes
    the outputs that lie between it and the next, so no row is repeated but by the scale itself."""
    other = "x" if axis == "y" else "y"
    w = Window.partitionBy("product", other).orderBy(axis)
    v = V("v").cast("double")
    lines = df.select("product", other, axis, v.alias("v")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("product", other)))
    before, after = F.coalesce(F.lag("v").over(w), V("v")), F.coalesce(F.lead("v").over(w), V("v"))
    second = F.coalesce(F.lead("v", 2).over(w), after)
    taps = lines.withColumn("taps", F.array(before, V("v"), after, second))
    out = F.greatest(F.lit(1), F.rint(V("n") * scale)).cast("long")
    # Output o lies at (o + 0.5) n / out - 0.5; sample i serves those from i up to i + 1, the first one those before it as well.
    step = V("n") / V("out_n")
    first = F.when(V(axis) == 0, 0).otherwise(F.ceil((V(axis) + 0.5) / step - 0.5 - 1e-9)).cast("long")
    last = F.when(V(axis) == V("n") - 1, V("out_n") - 1).otherwise(F.ceil((V(axis) + 1.5) / step - 0.5 - 1e-9) - 1).cast("long")
    made = taps.withColumn("out_n", out).withColumn("first", first).withColumn("last", F.least(last, V("out_n") - 1)).where(V("first") <= V("last"))
    made = made.withColumn("o", F.explode(F.sequence("first", "last"))).withColumn("at", (V("o") + 0.5) * step - 0.5)
    # Before the first sample the four are shifted by one: two copies of the first, itself among them, and the next.
    early = V("at") < V(axis)
    four = F.when(early, F.array(V("taps")[1], V("taps")[1], V("taps")[1], V("taps")[2])).otherwise(V("taps"))
    return made.select("product", other, V("o").alias(axis), cubic_taps(V("at"), four).alias("v"))


def resample(df: DataFrame, source: float, target: float) -> DataFrame:
    """Cubic resampling of dense rasters from one ground resolution to another, in two passes: along rows, then along columns."""
    if source <= 0 or target <= 0:
        raise ValueError("resolutions must be positive")
    return _resample_axis(_resample_axis(df, "x", source / target), "y", source / target).select("product", "y", "x", "v")
