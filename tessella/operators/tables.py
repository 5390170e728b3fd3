"""Small relational operators on metric rows, products, bands and patches: picks, counts, sums, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.safe import is_valid
from .geometry import MOON_RADIUS

V = F.col


def finite(v: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def count_finite(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Per key: used and skipped, rows whose value is finite and rows whose value is not."""
    return rows.groupBy(*keys).agg(F.count_if(finite(V(value))).alias("used"), F.count_if(~finite(V(value))).alias("skipped"))


def mean_finite(rows: DataFrame, values: list[str], *keys: str) -> DataFrame:
    """Per key: the mean of each value over its rows that are not NaN; null if there are none."""
    return rows.groupBy(*keys).agg(*[F.avg(F.nanvl(V(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in values])


def running_best(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Adds best: the least value up to the row, in order, per key."""
    return rows.withColumn("best", F.min(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def history_series(rows: DataFrame, epoch: str, splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """(epoch, split, metric, value) from columns named split_metric."""
    names = [c for c in rows.columns if c != epoch and c.split("_")[0] in splits]
    long = rows.unpivot(epoch, names, "name", "value")
    return long.select(epoch, F.split("name", "_", 2)[0].alias("split"), F.split("name", "_", 2)[1].alias("metric"), "value")


def start_offsets(rows: DataFrame, size: str, order: str, *keys: str) -> DataFrame:
    """Adds start_at: the sum of the sizes before the row, in order, per key."""
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_at", upto - V(size))


def extremes(rows: DataFrame, name: str, value: str, *keys: str) -> DataFrame:
    """Per key: at_min and at_max, the names of the least and the greatest value, the first by name of equals."""
    return rows.groupBy(*keys).agg(F.min_by(name, F.struct(value, name)).alias("at_min"), F.max_by(name, F.struct(V(value), -V(name))).alias("at_max"))


def seeded_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """At most so many rows, the first by a seeded hash of the key; the same ones whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), V(key).cast("string")).cast("binary")), key).limit(most)


def repeated(rows: DataFrame, key: str, times: int, size: int, seed: int) -> DataFrame:
    """Every row ``times`` times, with repeat and a seed of its own: that of place key + repeat * size."""
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("seed", seed + V(key) + V("repeat") * size)


def stacked(**tables: DataFrame) -> DataFrame:
    """Rows of several tables below one another, each with the place of its table in image; unstack with where(image = ...)."""
    return reduce(DataFrame.unionByName, [t.select(F.lit(i).alias("image"), *t.columns) for i, t in enumerate(tables.values())])


def first_column(columns: list[str], wanted: list[str], what: str) -> str:
    """The first of the wanted names among the columns; none raises."""
    for name in wanted:
        if name in columns:
            return name
    raise KeyError(f"no column for {what}: one of {', '.join(wanted)} is needed")


def first_value(*options: Column, otherwise: Column | None = None) -> Column:
    """The first option that is not null; without ``otherwise``, none raises."""
    picked = F.coalesce(*options, *([otherwise] if otherwise is not None else []))
    if otherwise is not None:
        return picked
    return F.when(F.assert_true(picked.isNotNull(), "none of the options is present").isNull(), picked)


def kind_by_part(name: Column, parts: dict[str, str], otherwise: str) -> Column:
    """The kind of the first part that the name holds."""
    hits = [F.when(name.contains(part), kind) for part, kind in parts.items()]
    return F.coalesce(*hits, F.lit(otherwise))


def looked_up(rows: DataFrame, table: DataFrame, key: str, table_key: str, defaults: dict | None = None) -> DataFrame:
    """``rows`` with the columns of the table's row of the same key. With defaults, rows without one stay and get these."""
    right = table.withColumnRenamed(table_key, "key__table")
    joined = rows.join(right, rows[key] == F.col("key__table"), "left" if defaults is not None else "inner").drop("key__table")
    for name, value in (defaults or {}).items():
        joined = joined.withColumn(name, F.coalesce(name, F.lit(value)))
    return joined


def gathered(rows: DataFrame, values: DataFrame, index: str, values_key: str) -> DataFrame:
    """``rows`` with the values at their index; indices without values are left out."""
    return rows.join(values.withColumnRenamed(values_key, index), index)


def axes_product(axes: Column) -> Column:
    """The product of a map's values: the number of elements that axes span."""
    return F.aggregate(F.map_values(axes), F.lit(1).cast("long"), lambda a, x: a * x)


def raster_stats(pixels: DataFrame) -> DataFrame:
    """Per product: v_min, v_max, v_mean, v_median, p2, p98, and the percentages of 0 and 255."""
    at = lambda q: F.percentile("v", q)
    share = lambda n: F.avg((V("v") == n).cast("int")) * 100
    return pixels.groupBy("product").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), at(0.5).alias("v_median"), at(0.02).alias("p2"), at(0.98).alias("p98"), share(0).alias("zero_pct"), share(255).alias("top_pct"))


def contrast(pixels: DataFrame, key: str = "product") -> DataFrame:
    """(key, spread): the population deviation of each."""
    return pixels.groupBy(key).agg(F.stddev_pop("v").alias("spread"))


def best_contrast(pixels: DataFrame, key: str = "product") -> DataFrame:
    """The one key of the greatest spread, the first of equals."""
    return contrast(pixels, key).orderBy(F.desc("spread"), key).limit(1)


def stack_bands(*bands: DataFrame) -> DataFrame:
    """A cube (product, band, y, x, v) of rasters, band by band."""
    return reduce(DataFrame.unionByName, [b.select("product", F.lit(i).alias("band"), "y", "x", "v") for i, b in enumerate(bands)])


def pair_check(a: DataFrame, b: DataFrame, *, strict: bool = False) -> DataFrame:
    """Counts of valid and jointly valid pixels, their share, and whether it is worryingly small (below 1 %). ``strict``: unequal
    shapes, and pairs without a common valid pixel, raise."""
    both = a.select("y", "x", is_valid(V("v")).alias("va")).join(b.select("y", "x", is_valid(V("v")).alias("vb")), ["y", "x"], "full_outer")
    counts = both.agg(F.count_if("va").alias("valid_a"), F.count_if("vb").alias("valid_b"), F.count_if(V("va") & V("vb")).alias("common"), F.count(F.lit(1)).alias("pixels"), F.count_if(V("va").isNull() | V("vb").isNull()).alias("unpaired"))
    if strict:
        checks = F.assert_true(V("unpaired") == 0, "shapes differ").isNull() & F.assert_true(V("common") > 0, "no common valid pixel").isNull()
        counts = counts.withColumn("common", F.when(checks, V("common")))
    return counts.withColumn("common_fraction", V("common") / V("pixels")).withColumn("small", V("common_fraction") < 0.01)


def support_area(pixels: DataFrame, lat0: float, step: float, rings: DataFrame | None = None, lon0: float = 0.0) -> DataFrame:
    """(y, n, km2): valid pixels of each row and the area of its cells of ``step`` degrees, rows going south from lat0. With
    ``rings`` (key, row, lo, hi: scanlines of a polygon) also n_inside and km2_inside, of the pixels between them."""
    cell = (MOON_RADIUS**2) * F.radians(F.lit(step)) * F.abs(F.sin(F.radians(lat0 - V("y") * step)) - F.sin(F.radians(lat0 - (V("y") + 1) * step))) / 1e6
    hit = pixels.where(V("v") > 0)
    if rings is None:
        return hit.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select("y", "n", (V("n") * cell).alias("km2"))
    lines = rings.groupBy(V("row").alias("y")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    inside = F.coalesce((lon0 + (V("x") + 0.5) * step).between(V("lo"), V("hi")), F.lit(False))
    counted = hit.join(lines, "y", "left").groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_inside"))
    return counted.select("y", "n", (V("n") * cell).alias("km2"), "n_inside", (V("n_inside") * cell).alias("km2_inside"))


def edge_gaps(pixels: DataFrame, lon0: float, step: float, edge_lon: Column, lat: Column) -> DataFrame:
    """(y, gap): metres from an edge's longitude to the first valid pixel of each row."""
    first = pixels.where(V("v") > 0).groupBy("y").agg(F.min("x").alias("x"))
    return first.select("y", ((lon0 + V("x") * step - edge_lon) * F.pi() * MOON_RADIUS / 180 * F.cos(F.radians(lat))).alias("gap"))


def gap_stats(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.min("gap").alias("gap_min"), F.percentile("gap", 0.5).alias("gap_median"), F.max("gap").alias("gap_max"))


def ranked(scores: DataFrame, order: list[Column], most: int = 10) -> DataFrame:
    """The first rows by an order, with their rank from 1. The window runs over at most ``most`` rows."""
    return scores.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def checked(rows: DataFrame, condition: Column, message: str) -> DataFrame:
    """``rows``; one that does not meet the condition (or for which it is null) raises."""
    return rows.where(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def whole_records(files: DataFrame, size: int) -> DataFrame:
    """(path, length) with records, the number of records of ``size`` bytes; a file that holds a part of one raises."""
    return checked(files, V("length") % size == 0, f"file is not a whole number of records of {size} bytes").withColumn("records", F.floor(V("length") / size))


def sound_rings(rings: DataFrame) -> DataFrame:
    """``rings``; one with fewer than three different corners, or without area, raises."""
    n = F.size(F.array_distinct("ring"))
    follow = F.transform("ring", lambda p, i: p["lon"] * F.get(V("ring"), (i + 1) % F.size("ring"))["lat"] - F.get(V("ring"), (i + 1) % F.size("ring"))["lon"] * p["lat"])
    area = F.abs(F.aggregate(follow, F.lit(0.0), lambda a, x: a + x))
    return checked(rings, (n >= 3) & (area > 0), "polygon is not valid")


def one_to_one(bands: DataFrame, wavelengths: DataFrame, key: str) -> DataFrame:
    """(key, bands) of cubes; one whose band count differs from its wavelength table's raises."""
    n = bands.groupBy(key).agg(F.countDistinct("band").alias("bands"))
    m = wavelengths.groupBy(key).agg(F.count(F.lit(1)).alias("listed"))
    return checked(n.join(m, key, "left"), V("bands") == F.coalesce("listed", F.lit(0)), "bands and wavelengths do not correspond one to one").select(key, "bands")


def split_counts(assigned: DataFrame) -> DataFrame:
    """(split, patches): how many each split has, the dropped ones under -1; splits without patches have 0."""
    splits = assigned.sparkSession.createDataFrame([(s,) for s in (-1, 0, 1, 2)], "split int")
    counts = assigned.groupBy(V("split").cast("int").alias("split")).agg(F.count(F.lit(1)).alias("patches"))
    return splits.join(counts, "split", "left").select("split", F.coalesce("patches", F.lit(0)).alias("patches"))
