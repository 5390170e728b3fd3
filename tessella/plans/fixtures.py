"""Rasters, patches and text lines built from the driver's tables, in DataFrame and in SQL form.

The raster: one product per event type, y = user_id, x = hour of day, v = summed value, dense, 0 where nothing happened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str, *products: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("product"), F.col("user_id").alias("y"), F.hour("ts").cast("long").alias("x"), F.col("value").cast("decimal(18,4)").alias("value"))
    height = events.agg(F.max("y").alias("h"))
    if products:
        events = events.where(F.col("product").isin(*products))
    cells = events.groupBy("product", "y", "x").agg(F.sum("value").cast("double").alias("v"))
    # Two one-column tables of fixed and known length span the grid: products, and one row with the height.
    grid = cells.select("product").distinct().join(F.broadcast(height)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h")))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23)))).select("product", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    return grid.join(cells, ["product", "y", "x"], "left").select("product", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


RASTER = """e AS (SELECT event_type AS product, user_id AS y, hour(ts) AS x, sum(CAST(value AS DECIMAL(18,4))) AS s FROM events GROUP BY ALL),
r AS (SELECT p.product, ys.y::BIGINT AS y, xs.x::BIGINT AS x, CAST(coalesce(e.s, 0) AS DOUBLE) AS v FROM (SELECT DISTINCT event_type AS product FROM events) p
  CROSS JOIN (SELECT unnest(range(0, (SELECT max(user_id) FROM events) + 1)) AS y) ys CROSS JOIN (SELECT unnest(range(0, 24)) AS x) xs LEFT JOIN e ON e.product = p.product AND e.y = ys.y AND e.x = xs.x)"""

#: Stretched to 0..255 between the percentiles 1 and 99: relation u.
STRETCHED = """b AS (SELECT product, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi0 FROM r GROUP BY product),
u AS (SELECT r.product, y, x, trunc((least(greatest(v, lo), CASE WHEN hi0 <= lo THEN lo + 1e-6 ELSE hi0 END) - lo) / (CASE WHEN hi0 <= lo THEN lo + 1e-6 ELSE hi0 END - lo) * 255)::BIGINT AS v FROM r JOIN b USING (product))"""

#: Stretched to 0..1 between the percentiles 2 and 98 of valid pixels: relation m.
MASKED = """mb AS (SELECT product, quantile_cont(v, 0.02) FILTER (WHERE v > 0) AS lo, quantile_cont(v, 0.98) FILTER (WHERE v > 0) AS hi FROM r GROUP BY product),
m AS (SELECT r.product, y, x, v > 0 AS valid, CASE WHEN v > 0 THEN least(greatest((v - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo), 0), 1) ELSE 0 END AS v FROM r JOIN mb USING (product))"""

#: Gradients of m: relation g with gx and gy.
GRADIENT = """g AS (SELECT *, CASE WHEN x = min(x) OVER rw THEN lead(v) OVER rx - v WHEN x = max(x) OVER rw THEN v - lag(v) OVER rx ELSE (lead(v) OVER rx - lag(v) OVER rx) / 2 END AS gx,
  CASE WHEN y = min(y) OVER cw THEN lead(v) OVER cy - v WHEN y = max(y) OVER cw THEN v - lag(v) OVER cy ELSE (lead(v) OVER cy - lag(v) OVER cy) / 2 END AS gy
  FROM m WINDOW rx AS (PARTITION BY product, y ORDER BY x), cy AS (PARTITION BY product, x ORDER BY y), rw AS (PARTITION BY product, y), cw AS (PARTITION BY product, x))"""

#: Gradient lengths 0..255 of m: relation k.
MAGNITUDE = """gm AS (SELECT product, y, x, CASE WHEN valid THEN sqrt(gx * gx + gy * gy) ELSE 0 END AS g FROM g),
gp AS (SELECT product, quantile_cont(g, 0.99) FILTER (WHERE g > 0) AS p FROM gm GROUP BY product),
k AS (SELECT gm.product, y, x, trunc(least(greatest(coalesce(g / p, 0), 0), 1) * 255)::BIGINT AS v FROM gm JOIN gp USING (product))"""


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and embedding: 64 values are an 8 x 8 patch."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("f"))
