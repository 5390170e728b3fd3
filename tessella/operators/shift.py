"""Search for the shift that best aligns two rasters.

Two forms give the same scores. The band form deals the rasters out in bands of rows, B's with a halo, correlates each band in arrays
and adds up a few sums a shift, so its shuffle is two copies of the rasters and a row per band and shift; it is the one for rasters.
The join form is one declarative plan, in which pixels of A meet those of B at the shifted place; it makes a row per pixel and
shift, and is kept for small pieces and as the band form's check.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import correlation

V = F.col


def shifts(spark: SparkSession, radius: int) -> DataFrame:
    side = F.sequence(F.lit(-radius), F.lit(radius))
    return spark.range(1).select(F.explode(side).alias("dx")).withColumn("dy", F.explode(side))


def _meet(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """A's pixels with those of B at (y - dy, x - dx), one row per shift; the shifts are a table of (2r+1)^2 rows."""
    moved = a.withColumn("dx", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    moved = moved.withColumn("by_", V("y") - V("dy")).withColumn("bx_", V("x") - V("dx"))
    other = b.withColumnsRenamed({c: f"b_{c}" for c in b.columns})
    return moved.join(other, (V("by_") == V("b_y")) & (V("bx_") == V("b_x")))


def best(scores: DataFrame, count: int = 10, digits: int = 8) -> DataFrame:
    rounded = scores.where(V("score").isNotNull()).withColumn("score", F.round("score", digits))
    return rounded.orderBy(F.desc("score"), F.desc("dx"), F.desc("dy")).limit(count)


def correlate(a: DataFrame, b: DataFrame, radius: int = 40, least: int = 1000) -> DataFrame:
    """(dx, dy, n, score) over jointly valid pixels; shifts with fewer than ``least`` of them are left out."""
    a, b = a.where(V("v") > 0).select("y", "x", "v"), b.where(V("v") > 0).select("y", "x", "v")
    met = _meet(a, b, radius).groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("n"), correlation(V("v"), V("b_v")).alias("score"))
    return met.where((V("n") >= least) & V("score").isNotNull())


def _dealt(a: DataFrame, b: DataFrame, columns: tuple[str, ...], radius: int, band: int) -> DataFrame:
    """A's pixels by bands of rows, and B's with a halo of ``radius`` rows; b says which raster a row is of."""
    side = lambda df, which: df.select(V("y").cast("long").alias("y"), V("x").cast("long").alias("x"), *[V(c).cast("double").alias(c) for c in columns], F.lit(which).alias("b"))
    own = side(a, False).withColumn("band", F.floor(V("y") / band))
    first, last = F.floor((V("y") - radius) / band), F.floor((V("y") + radius) / band)
    return own.unionByName(side(b, True).withColumn("band", F.explode(F.sequence(first, last))))


def _by_shift(rows: pd.DataFrame, columns: tuple[str, ...], radius: int):
    """For each shift: dx, dy, A's values and B's at the shifted places (NaN where B has no pixel), a row a column."""
    one, two = rows[~rows.b], rows[rows.b]
    if not len(one) or not len(two):
        return
    y0, x0 = rows.y.min() - radius, rows.x.min() - radius
    right = np.full((len(columns), rows.y.max() - y0 + radius + 1, rows.x.max() - x0 + radius + 1), np.nan)
    right[:, two.y - y0, two.x - x0] = two[list(columns)].to_numpy().T
    ys, xs = (one.y - y0).to_numpy(), (one.x - x0).to_numpy()
    p = one[list(columns)].to_numpy().T
    for dx in range(-radius, radius + 1):
        for dy in range(-radius, radius + 1):
            yield dx, dy, p, right[:, ys - dy, xs - dx]


def correlate_bands(a: DataFrame, b: DataFrame, radius: int = 40, least: int = 1000, band: int = 256) -> DataFrame:
    """As correlate(), by bands of rows. Sums are of values less their raster's mean, so that wide ranges keep their digits."""
    a, b = a.where(V("v") > 0).select("y", "x", "v"), b.where(V("v") > 0).select("y", "x", "v")
    centred = lambda df: df.join(F.broadcast(df.agg(F.avg("v").alias("mean"))), how="cross").withColumn("v", V("v") - V("mean")).drop("mean")  # one row

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dx, dy, p, q in _by_shift(rows, ("v",), radius):
            on = ~np.isnan(q[0])
            if on.any():
                s, t = p[0][on], q[0][on]
                out.append((dx, dy, int(on.sum()), s.sum(), t.sum(), (s * s).sum(), (t * t).sum(), (s * t).sum()))
        return pd.DataFrame(out, columns=["dx", "dy", "n", "sa", "sb", "saa", "sbb", "sab"])

    schema = "dx int, dy int, n long, sa double, sb double, saa double, sbb double, sab double"
    total = _dealt(centred(a), centred(b), ("v",), radius, band).groupBy("band").applyInPandas(sums, schema).groupBy("dx", "dy").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    spread = lambda s, ss: V(ss) - V(s) * V(s) / V("n")
    score = F.try_divide(V("sab") - V("sa") * V("sb") / V("n"), F.sqrt(F.greatest(spread("sa", "saa"), F.lit(0.0)) * F.greatest(spread("sb", "sbb"), F.lit(0.0))))
    return total.withColumn("score", score).where((V("n") >= least) & V("score").isNotNull()).select("dx", "dy", "n", "score")


def orientation_bands(a: DataFrame, b: DataFrame, radius: int = 40, least: int = 1000, band: int = 256) -> DataFrame:
    """As orientation_scores(), by bands of rows."""
    length = F.sqrt(V("c") * V("c") + V("s") * V("s"))
    unit = lambda df: df.where(length > 1e-9).select("y", "x", (V("c") / length).alias("c"), (V("s") / length).alias("s"))

    def sums(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dx, dy, p, q in _by_shift(rows, ("c", "s"), radius):
            on = ~np.isnan(q[0])
            if on.any():
                out.append((dx, dy, int(on.sum()), float((p[:, on] * q[:, on]).sum())))
        return pd.DataFrame(out, columns=["dx", "dy", "n", "total"])

    total = _dealt(unit(a), unit(b), ("c", "s"), radius, band).groupBy("band").applyInPandas(sums, "dx int, dy int, n long, total double")
    return total.groupBy("dx", "dy").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where(V("n") >= least).select("dx", "dy", "n", (V("total") / V("n")).alias("score"))


def orientation_scores(a: DataFrame, b: DataFrame, radius: int = 40, least: int = 1000) -> DataFrame:
    """(dx, dy, n, score): mean cosine between doubled-angle vectors (c, s), where both are longer than zero."""
    met = _meet(a, b, radius)
    length = lambda c, s: F.sqrt(V(c) * V(c) + V(s) * V(s))
    met = met.where((length("c", "s") > 1e-9) & (length("b_c", "b_s") > 1e-9))
    cosine = (V("c") * V("b_c") + V("s") * V("b_s")) / (length("c", "s") * length("b_c", "b_s"))
    return met.groupBy("dx", "dy").agg(F.count(F.lit(1)).alias("n"), F.avg(cosine).alias("score")).where(V("n") >= least)
