"""Per-pixel radiometry on pixels(product, y, x, v). Zero or non-finite values are invalid.

Bounds are aggregates per product, joined back. Percentiles are exact: of 8- and 16-bit rasters from one counter per distinct value,
of values without such a bound from the few around a sketch's estimate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import clip, divide, is_valid, join_same, truncate

V = F.col


def percentiles(df: DataFrame, low: float, high: float, keys: list[str], where: Column | None = None, *, discrete: bool = True) -> DataFrame:
    """(keys, lo_, hi_): exact percentiles, interpolated. ``discrete``: values are few, as those of 8- and 16-bit rasters are."""
    value = V("v") if where is None else F.when(where, V("v"))
    if not discrete:
        return _percentiles_of_many(df.select(*keys, value.alias("v")), (low / 100, high / 100), keys)
    return df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low / 100), F.lit(high / 100))).alias("q_")).select(*keys, V("q_")[0].alias("lo_"), V("q_")[1].alias("hi_"))


def _percentiles_of_many(rows: DataFrame, shares: tuple[float, float], keys: list[str], around: float = 1e-3) -> DataFrame:
    """Exact percentiles of any number of distinct values: a sketch gives bounds ``around`` each share; what is below them is counted, and
    only the values between them are put in order. The next value on either side covers ranks that few values put outside."""
    within = [max(0.0, min(1.0, q + d)) for q in shares for d in (-around, around)]
    found = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.percentile_approx("v", within, 10000).alias("b"))
    one = lambda k: F.struct(F.lit(k).alias("k"), V("b")[2 * k].alias("from"), V("b")[2 * k + 1].alias("to"), (shares[k] * (V("n") - 1)).alias("rank"))
    marked = join_same(rows.where(V("v").isNotNull()), found, *keys).withColumn("s", F.explode(F.array(one(0), one(1)))).select(*keys, "v", "s.*")
    group = [*keys, "k", "rank"]
    outside = marked.groupBy(*group).agg(F.count_if(V("v") < V("from")).alias("below"), F.max(F.when(V("v") < V("from"), V("v"))).alias("before"), F.min(F.when(V("v") > V("to"), V("v"))).alias("after"))
    inside = marked.where(V("v").between(V("from"), V("to"))).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    met = join_same(inside, outside, *group)
    stop = V("below") + F.sum("c").over(Window.partitionBy(*group).orderBy("v"))
    met = met.withColumn("stop", stop)
    at = lambda r: F.max(F.when((V("stop") > r) & (V("stop") - V("c") <= r), V("v")))
    low, high = F.floor("rank"), F.ceil("rank")
    picked = met.groupBy(*group, "below", "before", "after").agg(at(low).alias("a"), at(high).alias("z"))
    a = F.coalesce("a", F.when(low < V("below"), V("before")).otherwise(V("after")))
    z = F.coalesce("z", F.when(high < V("below"), V("before")).otherwise(V("after")))
    value = picked.select(*keys, "k", (a + (V("rank") - low) * (z - a)).alias("value"))
    both = value.groupBy(*keys).agg(F.max(F.when(V("k") == 0, V("value"))).alias("lo_"), F.max(F.when(V("k") == 1, V("value"))).alias("hi_"))
    return join_same(found.select(*keys), both, *keys, how="left")


def normalize_u8(df: DataFrame, low: float = 1.0, high: float = 99.0) -> DataFrame:
    """Stretch between percentiles over all pixels to 0..255, truncated."""
    bounds = percentiles(df, low, high, ["product"]).withColumn("hi_", F.when(V("hi_") <= V("lo_"), V("lo_") + 1e-6).otherwise(V("hi_")))
    scaled = (clip_to(V("v"), V("lo_"), V("hi_")) - V("lo_")) / (V("hi_") - V("lo_")) * 255.0
    return join_same(df, bounds, "product").withColumn("v", truncate(scaled)).drop("lo_", "hi_")


def clip_to(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def normalize_masked(df: DataFrame, low: float = 2.0, high: float = 98.0) -> DataFrame:
    """Stretch between percentiles of valid pixels to 0..1; invalid ones become 0. Adds valid. A product without a valid
    pixel raises."""
    ok = F.coalesce(is_valid(V("v")), F.lit(False))
    bounds = percentiles(df, low, high, ["product"], ok)
    some = F.assert_true(V("lo_").isNotNull(), F.concat(F.lit("no valid pixel in product "), F.coalesce(V("product").cast("string"), F.lit("null"))))
    bounds = bounds.withColumn("lo_", F.when(some.isNull(), V("lo_")))
    bounds = bounds.withColumn("hi_", F.when(V("hi_") <= V("lo_"), V("lo_") + 1.0).otherwise(V("hi_")))
    scaled = clip((V("v") - V("lo_")) / (V("hi_") - V("lo_")), 0, 1)
    return join_same(df, bounds, "product").withColumn("valid", ok).withColumn("v", F.when(V("valid"), scaled).otherwise(0.0)).drop("lo_", "hi_")


def invert(v: Column) -> Column:
    return F.lit(255) - v


def shadow_lift(v: Column, threshold: float = 40, gain: float = 1.8) -> Column:
    return truncate(F.when(v < threshold, clip(v * gain, 0, 255)).otherwise(v))


def log_compress(df: DataFrame, c: float = 1.0) -> DataFrame:
    """c * log(1 + v/255), rescaled by its greatest value per product to 255, truncated."""
    compressed = df.withColumn("v", c * F.log1p(V("v") / 255.0))
    top = compressed.groupBy("product").agg(F.max("v").alias("top_"))
    return join_same(compressed, top, "product").withColumn("v", truncate(F.round(F.when(V("top_") > 0, V("v") / V("top_") * 255.0).otherwise(V("v")), 9))).drop("top_")


def to_unit(v: Column) -> Column:
    """0..255 to 0..1; values beyond the range raise."""
    return F.when(F.assert_true((v >= -0.255) & (v <= 255.255), "pixel out of range").isNull(), v / 255.0)


def to_u8(v: Column) -> Column:
    return clip(F.rint(v * 255.0), 0, 255).cast("int")


def gamma_contrast(v: Column, gamma: Column, contrast: Column, valid: Column) -> Column:
    return clip(0.5 + contrast * (F.pow(clip(v, 0, 1), gamma) - 0.5), 0, 1) * valid.cast("double")


def seeded_uniform(low: float, high: float, seed: int, *keys: Column) -> Column:
    """A repeatable uniform value by key."""
    return F.lit(low) + (high - low) * (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30))


def minmax_stretch(df: DataFrame) -> DataFrame:
    bounds = df.groupBy("product").agg(F.min("v").alias("lo_"), F.max("v").alias("hi_"))
    return join_same(df, bounds, "product").withColumn("v", divide(V("v") - V("lo_"), V("hi_") - V("lo_")) * 255.0).drop("lo_", "hi_")


def histogram_match(df: DataFrame, source: str, reference: str) -> DataFrame:
    """Map the source's values so that their distribution is the reference's (interpolated cumulative shares), truncated.

    Works on value counts, one row per distinct value and product: both products' cumulative shares are merged in one order, in
    which each of the source's shares finds the reference's on either side.
    """
    return match_histograms(df.where(V("product") == source), df.where(V("product") == reference))


def match_histograms(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Every product of ``df``, matched to all pixels of ``reference``."""
    shares_of = lambda rows, w: rows.withColumn("share", F.sum("n").over(w.orderBy("v")) / F.sum("n").over(w))
    counts = lambda rows, *keys: rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    src = shares_of(counts(df, "product"), Window.partitionBy("product")).select("product", "v", "share", F.lit(None).cast("struct<share:double,v:double>").alias("at"))
    ref = shares_of(counts(reference).withColumn("all", F.lit(0)), Window.partitionBy("all"))
    point = F.struct(V("share").cast("double").alias("share"), V("v").cast("double").alias("v")).alias("at")
    ref = counts(df, "product").select("product").distinct().join(ref.select("share", point), how="cross")  # products x values of one raster
    both = src.unionByName(ref.select("product", F.lit(None).cast(df.schema["v"].dataType).alias("v"), "share", "at"))
    order = Window.partitionBy("product").orderBy("share")
    below = F.last("at", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first("at", ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    met = both.withColumn("low", below).withColumn("high", above).where(V("at").isNull())
    slope = F.try_divide(V("share") - V("low.share"), V("high.share") - V("low.share"))
    value = F.when(V("low").isNull(), V("high.v")).when(V("high").isNull() | slope.isNull(), V("low.v")).otherwise(V("low.v") + slope * (V("high.v") - V("low.v")))
    table = met.select("product", "v", truncate(clip(value, 0, 255)).alias("matched"))
    return join_same(df, table, "product", "v").select("product", "y", "x", V("matched").alias("v"))
