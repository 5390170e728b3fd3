"""Time series, nearest records, strided neighbours and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col
RANGES = 256


def series_stats(df: DataFrame, fields: list[str], keys: list[str], time: str) -> DataFrame:
    """Per key: count, first and last time, and least, median and greatest value of each field, one row a field. Without keys every
    field has a row, of 0 records if there are none."""
    long = df.select(*keys, time, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), V(f).cast("double").alias("value")) for f in fields])).alias("f")).select(*keys, time, "f.*")
    out = long.groupBy(*keys, "field").agg(
        F.count(F.lit(1)).alias("records"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min("value").alias("v_min"), F.percentile("value", 0.5).alias("v_median"), F.max("value").alias("v_max")
    )
    if keys:
        return out
    listed = df.sparkSession.createDataFrame([(f,) for f in fields], "field string")
    return listed.join(out, "field", "left").withColumn("records", F.coalesce("records", F.lit(0)))


def nearest(targets: DataFrame, records: DataFrame, target: str, value: str, order: str) -> DataFrame:
    """Each target with the record whose ``value`` is nearest, the first by ``order`` of equals, however far it lies.

    The nearest is one of two, the record before and the one after the target by value. A null target has no record.
    """
    gap = lambda side: F.abs(V(f"{side}.{value}") - V(target))
    closer = (gap("low") < gap("high")) | ((gap("low") == gap("high")) & (V(f"low.{order}") <= V(f"high.{order}")))
    hit = F.when(V("high").isNull() | closer, V("low")).otherwise(V("high")).alias("hit")
    found = targets.withColumn("at_", V(target).cast("double")).join(_around(targets, records, target, value, order), "at_", "left")
    return found.select(*targets.columns, hit).select(*targets.columns, "hit.*")


def _around(targets: DataFrame, records: DataFrame, target: str, value: str, order: str) -> DataFrame:
    """(at_, low, high): per distinct target the record of the greatest value up to it, and of the least
    from it on, or null; the first by ``order`` of equal values.

    Distinct values of both sides are dealt into ``RANGES`` ranges of about equal counts; a range knows the last record before
    it and the first one after it from one row a range. Both windows run from their start to the current row, since Spark goes
    through the rest of a range again at every row of a frame that ends with it.
    """
    hits = records.where(V(value).isNotNull()).groupBy(V(value).cast("double").alias("at_")).agg(F.min_by(F.struct(*records.columns), V(order)).alias("rec"))
    wanted = targets.where(V(target).isNotNull()).select(V(target).cast("double").alias("at_")).distinct()
    points = hits.unionByName(wanted.select("at_", F.lit(None).cast(hits.schema["rec"].dataType).alias("rec")))
    bounds = points.agg(F.percentile_approx("at_", [i / RANGES for i in range(1, RANGES)], 10000).alias("bounds"))  # one row
    points = points.join(F.broadcast(bounds)).withColumn("range", F.lit(0))
    step = RANGES // 2
    while step:  # how many of the RANGES - 1 bounds are less, by halves: RANGES is a power of two
        points = points.withColumn("range", V("range") + F.when(F.get("bounds", V("range") + (step - 1)) < V("at_"), step).otherwise(0))
        step //= 2
    points = points.drop("bounds")
    ends = points.where(V("rec").isNotNull()).groupBy("range").agg(F.max_by("rec", "at_").alias("last"), F.min_by("rec", "at_").alias("first"))
    ends = points.sparkSession.range(RANGES).select(V("id").cast("int").alias("range")).join(ends, "range", "left")
    ranges = Window.orderBy("range")
    carried = ends.select("range", F.last("last", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", ignorenulls=True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    seen = points
    for side, order_ in (("low", V("at_").asc()), ("high", V("at_").desc())):
        seen = seen.withColumn(side, F.last("rec", ignorenulls=True).over(Window.partitionBy("range").orderBy(order_).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return seen.where(V("rec").isNull()).join(F.broadcast(carried), "range").select("at_", F.coalesce("low", "before").alias("low"), F.coalesce("high", "after").alias("high"))


def spacing(df: DataFrame, along: str, across: str, stride: int, distance: Column) -> DataFrame:
    """Distances between neighbours along every stride-th line: ``distance`` may use lead_lon, lead_lat and lead_at."""
    w = Window.partitionBy(across).orderBy(along)
    line = F.dense_rank().over(Window.orderBy(across)) - 1
    lines = df.select(across).distinct().withColumn("line", line).where(V("line") % stride == 0).select(across)
    near = df.join(lines, across).withColumn("lead_lon", F.lead("lon").over(w)).withColumn("lead_lat", F.lead("lat").over(w)).withColumn("lead_at", F.lead(along).over(w))
    return near.where(V("lead_at").isNotNull()).withColumn("spacing", distance / (V("lead_at") - V(along)))


def pick_first_middle_last(df: DataFrame, order: list[str]) -> DataFrame:
    """Three rows of a small table by rank: 1, n/2 + 1 and n."""
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("n_", F.count(F.lit(1)).over(Window.partitionBy()))
    return ranked.where((V("rank") == 1) | (V("rank") == F.floor(V("n_") / 2) + 1) | (V("rank") == V("n_"))).drop("n_")
