"""Queries on footprints, orbits, labels and series, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.safe import round_scaled
from ..operators import geometry as G
from ..operators import series as T
from ..operators import tables
from ..registry import query
from ..sources import catalogue, text_records
from .fixtures import table

V = F.col
#: Footprints (UL, UR, LR, LL as latitude, longitude) whose areas and overlaps are known.
FOOTPRINTS = {
    "O21": [(1.056037, 23.375034), (1.068878, 23.495434), (0.237605, 23.492393), (0.224735, 23.371989)],
    "O24": [(0.372032, 23.472939), (0.369695, 23.593739), (-0.444178, 23.575386), (-0.441842, 23.454679)],
    "IIRS": [(8.195483, 23.771330), (8.179012, 24.604061), (-26.165032, 23.750095), (-26.147187, 22.857987)],
    "TMC_system": [(8.497995, 23.785752), (8.481320, 24.619795), (-25.833864, 23.767155), (-25.815939, 22.876861)],
    "TMC_refined": [(8.572855, 23.795633), (8.561030, 24.643875), (-25.763968, 23.821988), (-25.750817, 22.916615)],
    "TMC_corrected": [(6.604546, 22.979538), (6.604546, 24.594192), (-23.878014, 24.594192), (-23.878014, 22.979538)],
}
_ROWS = ", ".join(f"('{k}', {i}, {lat}::DOUBLE, {lon}::DOUBLE)" for k, c in FOOTPRINTS.items() for i, (lat, lon) in enumerate(c))
CORNERS = f"c AS (SELECT * FROM (VALUES {_ROWS}) t(key, i, lat, lon)), sd AS (SELECT a.key, a.i, a.lon AS lon1, a.lat AS lat1, b.lon AS lon2, b.lat AS lat2 FROM c a JOIN c b ON a.key = b.key AND b.i = (a.i + 1) % 4)"


def footprints(spark: SparkSession) -> DataFrame:
    rows = [(k, [(lon, lat) for lat, lon in c]) for k, c in FOOTPRINTS.items()]
    return spark.createDataFrame(rows, "key string, ring array<struct<lon:double,lat:double>>")


query(
    "footprint_area",
    f"WITH {CORNERS}, n AS (SELECT *, greatest(ceil(sqrt(pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)) / 0.005), 1) AS n FROM sd), p AS (SELECT *, unnest(range(0, n::BIGINT)) AS j FROM n), q AS (SELECT key, radians(lon1 + (lon2 - lon1) * (j / n)) * 1737400 AS x1, sin(radians(lat1 + (lat2 - lat1) * (j / n))) * 1737400 AS y1, radians(lon1 + (lon2 - lon1) * ((j + 1) / n)) * 1737400 AS x2, sin(radians(lat1 + (lat2 - lat1) * ((j + 1) / n))) * 1737400 AS y2 FROM p) SELECT key, round(abs(sum(x1 * y2 - x2 * y1)) / 2e6, 4) AS area_km2 FROM q GROUP BY key",
)(lambda s, d: G.footprint_area(footprints(s), "key").select("key", F.round("area_km2", 4).alias("area_km2")))
#: Intersections of the convex rings of CORNERS as relation o (a, b, i, lon, lat): corners inside the other ring and crossings of sides,
#: ordered around their centre; and their areas as relation oa.
_OVERLAP = """ccw AS (SELECT key, sum(lon1 * lat2 - lon2 * lat1) AS t FROM sd GROUP BY key),
ins AS (SELECT p.key AS a, e.key AS b, p.i, p.lon, p.lat, min(sign(t) * ((lon2 - lon1) * (p.lat - lat1) - (lat2 - lat1) * (p.lon - lon1))) AS side FROM c p JOIN sd e ON e.key <> p.key JOIN ccw ON ccw.key = e.key GROUP BY ALL),
x0 AS (SELECT e.key AS a, f.key AS b, e.lon1 AS px, e.lat1 AS py, e.lon2 - e.lon1 AS dx, e.lat2 - e.lat1 AS dy, f.lon1 AS qx, f.lat1 AS qy, f.lon2 - f.lon1 AS ex, f.lat2 - f.lat1 AS ey FROM sd e JOIN sd f ON e.key < f.key),
x1 AS (SELECT a, b, px, py, dx, dy, ((qx - px) * ey - (qy - py) * ex) / nullif(dx * ey - dy * ex, 0) AS t, ((qx - px) * dy - (qy - py) * dx) / nullif(dx * ey - dy * ex, 0) AS u FROM x0),
pt AS (SELECT least(a, b) AS a, greatest(a, b) AS b, lon, lat FROM ins WHERE side >= 0 UNION SELECT a, b, px + t * dx, py + t * dy FROM x1 WHERE t > 0 AND t < 1 AND u > 0 AND u < 1),
ct AS (SELECT *, avg(lon) OVER (PARTITION BY a, b) AS mx, avg(lat) OVER (PARTITION BY a, b) AS my, count(*) OVER (PARTITION BY a, b) AS n FROM pt),
o AS (SELECT a, b, n, lon, lat, row_number() OVER (PARTITION BY a, b ORDER BY atan2(lat - my, lon - mx)) AS i FROM ct WHERE n > 2),
os AS (SELECT p.a, p.b, p.lon AS lon1, p.lat AS lat1, q.lon AS lon2, q.lat AS lat2 FROM o p JOIN o q ON p.a = q.a AND p.b = q.b AND q.i = p.i % p.n + 1),
al AS (SELECT a, b, lon1, lat1, lon2, lat2 FROM os UNION ALL SELECT key, key, lon1, lat1, lon2, lat2 FROM sd),
an AS (SELECT *, greatest(ceil(sqrt(pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)) / 0.005), 1) AS n FROM al), ap AS (SELECT *, unnest(range(0, n::BIGINT)) AS j FROM an),
aq AS (SELECT a, b, radians(lon1 + (lon2 - lon1) * (j / n)) * 1737400 AS x1, sin(radians(lat1 + (lat2 - lat1) * (j / n))) * 1737400 AS y1, radians(lon1 + (lon2 - lon1) * ((j + 1) / n)) * 1737400 AS x2, sin(radians(lat1 + (lat2 - lat1) * ((j + 1) / n))) * 1737400 AS y2 FROM ap),
oa AS (SELECT a, b, abs(sum(x1 * y2 - x2 * y1)) / 2e6 AS km2 FROM aq GROUP BY a, b),
ov AS (SELECT p.key AS key_a, q.key AS key_b, round(coalesce(s.km2, 0), 3) AS shared_km2, round(coalesce(s.km2, 0) / x.km2 * 100, 4) AS percent_a, round(coalesce(s.km2, 0) / y.km2 * 100, 4) AS percent_b, round(e.lon_min, 6) AS lon_min, round(e.lon_max, 6) AS lon_max, round(e.lat_min, 6) AS lat_min, round(e.lat_max, 6) AS lat_max
  FROM (SELECT DISTINCT key FROM c) p JOIN (SELECT DISTINCT key FROM c) q ON p.key < q.key LEFT JOIN oa s ON s.a = p.key AND s.b = q.key JOIN oa x ON x.a = p.key AND x.b = p.key JOIN oa y ON y.a = q.key AND y.b = q.key
  LEFT JOIN (SELECT a, b, min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max FROM o GROUP BY a, b) e ON e.a = p.key AND e.b = q.key)"""


def _overlaps(s: SparkSession) -> DataFrame:
    rounded = [F.round("shared_km2", 3).alias("shared_km2"), *[F.round(c, 4).alias(c) for c in ("percent_a", "percent_b")], *[F.round(c, 6).alias(c) for c in ("lon_min", "lon_max", "lat_min", "lat_max")]]
    return G.overlaps(tables.sound_rings(footprints(s)), "key").select("key_a", "key_b", *rounded)


query("footprint_overlap", f"WITH {CORNERS}, {_OVERLAP} SELECT * FROM ov")(lambda s, d: _overlaps(s))
query("overlap_sensitivity", f"WITH {CORNERS}, {_OVERLAP} SELECT * FROM ov WHERE key_a = 'O24' AND key_b LIKE 'TMC%'")(lambda s, d: _overlaps(s).where("key_a = 'O24' and key_b like 'TMC%'"))
query("pair_combos", f"WITH {CORNERS} SELECT DISTINCT a.key AS key_a, b.key AS key_b FROM c a JOIN c b ON a.key < b.key")(
    lambda s, d: G.unordered_pairs(footprints(s), "key")
)
query(
    "scanline_range",
    f"WITH {CORNERS}, rw AS (SELECT unnest(range(0, 120)) AS \"row\"), h AS (SELECT key, \"row\", 1.2::DOUBLE + (\"row\" + 0.5::DOUBLE) * -0.02::DOUBLE AS lat, lon1, lat1, lon2, lat2 FROM sd CROSS JOIN rw) SELECT key, \"row\", round(lat, 6) AS lat, round(min(lon1 + (lat - lat1) / (lat2 - lat1) * (lon2 - lon1)), 6) AS lo, round(max(lon1 + (lat - lat1) / (lat2 - lat1) * (lon2 - lon1)), 6) AS hi FROM h WHERE lat BETWEEN least(lat1, lat2) AND greatest(lat1, lat2) AND lat1 <> lat2 GROUP BY key, \"row\", lat",
)(lambda s, d: G.scanlines(footprints(s), "key", 1.2, -0.02, 120).select("key", V("row").cast("long").alias("row"), *[F.round(c, 6).alias(c) for c in ("lat", "lo", "hi")]))
query("sun_delta", "SELECT o_orderkey, round(least(abs(o_totalprice % 360 - o_custkey % 360), 360 - abs(o_totalprice % 360 - o_custkey % 360)), 6) AS delta FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.round(G.circular_difference(V("o_totalprice") % 360, (V("o_custkey") % 360).cast("double")), 6).alias("delta"))
)
query(
    "haversine",
    "SELECT event_id, round(2 * 1737400 * asin(sqrt(pow(sin(radians(event_id % 7 + 1 - event_id % 11) / 2), 2) + cos(radians(event_id % 11)) * cos(radians(event_id % 7 + 1)) * pow(sin(radians(user_id % 90 - event_id % 180) / 2), 2))), 4) AS metres FROM events",
)(lambda s, d: table(s, d, "events").select("event_id", F.round(G.haversine(V("event_id") % 180, V("event_id") % 11, V("user_id") % 90, V("event_id") % 7 + 1), 4).alias("metres")))
_O24 = FOOTPRINTS["O24"]
query(
    "bilinear_geo",
    f"WITH p AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS x, (user_id % 51) / 50.0::DOUBLE AS y FROM events) SELECT event_id, round((1-x)*(1-y)*{_O24[0][0]}::DOUBLE + x*(1-y)*{_O24[1][0]}::DOUBLE + (1-x)*y*({_O24[3][0]}::DOUBLE) + x*y*({_O24[2][0]}::DOUBLE), 9) AS lat FROM p",
)(lambda s, d: table(s, d, "events").select("event_id", F.round(G.bilinear(*[F.lit(c[0]) for c in _O24], (V("event_id") % 101) / 100.0, (V("user_id") % 51) / 50.0), 9).alias("lat")))
query(
    "cross_track",
    f"WITH p AS (SELECT * FROM (VALUES (0.369695::DOUBLE, 23.593739::DOUBLE), (-0.444178::DOUBLE, 23.575386::DOUBLE)) t(lat, lon)), e AS (SELECT *, 22.979538::DOUBLE + (6.604546::DOUBLE - lat) / (6.604546::DOUBLE + 23.878014::DOUBLE) * 0.1::DOUBLE AS left_lon, 24.594192::DOUBLE AS right_lon FROM p) SELECT lat, round((lon - left_lon) / (right_lon - left_lon), 8) AS fraction FROM e",
)(
    lambda s, d: s.createDataFrame([(0.369695, 23.593739), (-0.444178, 23.575386)], "lat double, lon double")
    .withColumn("l", G.edge_longitude(V("lat"), F.lit(6.604546), F.lit(22.979538), F.lit(-23.878014), F.lit(23.079538)))
    .select("lat", F.round((V("lon") - V("l")) / (24.594192 - V("l")), 8).alias("fraction"))
)
query(
    "common_grid",
    "SELECT round_even(abs(0.369695::DOUBLE + 0.444178::DOUBLE) * pi() * 1737400 / 180 / 5.687, 0)::INT AS n_rows, round_even(0.023286::DOUBLE * pi() * 1737400 / 180 * cos(radians(0.369695::DOUBLE)) / 5.687, 0)::INT AS top, round_even(0.02649::DOUBLE * pi() * 1737400 / 180 * cos(radians(-0.444178::DOUBLE)) / 5.687, 0)::INT AS bottom",
)(lambda s, d: s.range(1).select(*[c.alias(n) for c, n in zip(G.common_grid(F.lit(0.369695), F.lit(-0.444178), F.lit(0.023286), F.lit(0.02649)), ("n_rows", "top", "bottom"), strict=True)]))
query("affine_geo", "SELECT event_id, round(22.979537643969138::DOUBLE + (user_id + 0.5) * 0.0001666::DOUBLE, 9) AS lon, round(6.604545584720541::DOUBLE + (event_id + 0.5) * -0.0001666::DOUBLE, 9) AS lat FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.round(G.affine(F.lit(22.979537643969138), F.lit(0.0001666), V("user_id")), 9).alias("lon"), F.round(G.affine(F.lit(6.604545584720541), F.lit(-0.0001666), V("event_id")), 9).alias("lat"))
)
query("wkt_roundtrip", f"WITH {CORNERS} SELECT key, lon, lat FROM c")(lambda s, d: footprints(s).withColumn("ring", G.from_wkt(G.wkt(V("ring")))).select("key", F.explode("ring").alias("p")).select("key", "p.lon", "p.lat"))


def _targets(spark: SparkSession) -> DataFrame:
    corner = [F.lit(v).alias(f"{n}_{c}") for n, p in zip(("ul", "ur", "lr", "ll"), FOOTPRINTS["TMC_refined"], strict=True) for c, v in zip(("lat", "lon"), p, strict=True)]
    rows = [(k, i, lat, lon) for k in ("O21", "O24") for i, (lat, lon) in enumerate(FOOTPRINTS[k])]
    return spark.createDataFrame(rows, "key string, i int, lat double, lon double").select("*", *corner)


_TMC = FOOTPRINTS["TMC_refined"]
_MODEL = lambda c, x, y: f"((1 - {x}) * (1 - {y}) * ({_TMC[0][c]}::DOUBLE) + {x} * (1 - {y}) * ({_TMC[1][c]}::DOUBLE) + (1 - {x}) * {y} * ({_TMC[3][c]}::DOUBLE) + {x} * {y} * ({_TMC[2][c]}::DOUBLE))"
query(
    "inverse_geo",
    f"""WITH RECURSIVE {CORNERS}, gx AS (SELECT unnest(range(0, 31)) AS ix), gy AS (SELECT unnest(range(0, 31)) AS iy),
rec AS (SELECT key, i, lat, lon, 0.5::DOUBLE AS bx, 0.5::DOUBLE AS byy, 0.5::DOUBLE AS rad, 0 AS step FROM c WHERE key LIKE 'O2%'
  UNION ALL SELECT key, i, lat, lon, arg_min(x, (e, iy * 31 + ix)), arg_min(y, (e, iy * 31 + ix)), rad / 5, step + 1 FROM (
    SELECT key, i, lat, lon, rad, step, ix, iy, x, y, pow({_MODEL(0, 'x', 'y')} - lat, 2) + pow({_MODEL(1, 'x', 'y')} - lon, 2) AS e FROM (
      SELECT key, i, lat, lon, rad, step, ix, iy, greatest(0, least(1, bx - rad + 2 * rad * ix / 30)) AS x, greatest(0, least(1, byy - rad + 2 * rad * iy / 30)) AS y FROM rec CROSS JOIN gx CROSS JOIN gy WHERE step < 8)) GROUP BY key, i, lat, lon, rad, step)
SELECT key, i, round_even(bx * 9691, 0)::BIGINT AS px, round_even(byy * 182971, 0)::BIGINT AS py FROM rec WHERE step = 8""",
)(lambda s, d: G.inverse_search(_targets(s)).select("key", "i", F.rint(V("bx") * 9691).cast("long").alias("px"), F.rint(V("by") * 182971).cast("long").alias("py")))
query("affine_inverse", "SELECT event_id, floor((22.979537643969138::DOUBLE + (user_id + 0.5) * 0.0001666::DOUBLE - 22.979537643969138::DOUBLE) / 0.0001666::DOUBLE)::BIGINT AS x, greatest(0, least(floor((1.0 - (event_id % 90) - 6.604545584720541::DOUBLE) / -0.0001666::DOUBLE), 182971))::BIGINT AS first_row, greatest(0, least(floor((0.5 - (event_id % 90) - 6.604545584720541::DOUBLE) / -0.0001666::DOUBLE), 182971))::BIGINT AS last_row FROM events")(
    lambda s, d: table(s, d, "events").select(
        "event_id", G.affine_row(F.lit(22.979537643969138), F.lit(0.0001666), G.affine(F.lit(22.979537643969138), F.lit(0.0001666), V("user_id"))).alias("x"),
        *[c.alias(n) for c, n in zip(G.row_range(1.0 - V("event_id") % 90, 0.5 - V("event_id") % 90, F.lit(6.604545584720541), F.lit(-0.0001666), 182972), ("first_row", "last_row"), strict=True)],
    )
)
query(
    "crop_window",
    "WITH b AS (SELECT event_type AS key, min(user_id * 7) AS x0, max(user_id * 7) AS x1, min(event_id) AS y0, max(event_id) AS y1 FROM events GROUP BY 1), m AS (SELECT *, greatest(10, floor((x1 - x0) * 0.1)) AS mx, greatest(10, floor((y1 - y0) * 0.1)) AS my FROM b) SELECT key, greatest(0, x0 - mx)::BIGINT AS xoff, greatest(0, y0 - my)::BIGINT AS yoff, (least(999, x1 + mx) - greatest(0, x0 - mx) + 1)::BIGINT AS xsize, (least(99999, y1 + my) - greatest(0, y0 - my) + 1)::BIGINT AS ysize FROM m",
)(lambda s, d: G.crop_window(table(s, d, "events").select(V("event_type").alias("key"), (V("user_id") * 7).alias("px"), V("event_id").alias("py")), "key", 1000, 100000))


def _grid(s: SparkSession, d: str, n: int = 12) -> DataFrame:
    cells = s.range(n * n).select((V("id") % n).alias("x"), F.floor(V("id") / n).alias("y"))
    return cells.select("x", "y", (23.4 + V("x") * 0.001 + V("y") * 0.0001).alias("lon"), (0.4 - V("y") * 0.002).alias("lat"))


query("ring_assemble", "WITH g AS (SELECT unnest(range(0, 144)) AS i), c AS (SELECT i % 12 AS x, i // 12 AS y FROM g), w AS (SELECT 0 AS side, x AS k, x, y FROM c WHERE y = 0 UNION ALL SELECT 1, y, x, y FROM c WHERE x = 11 AND y > 0 UNION ALL SELECT 2, -x, x, y FROM c WHERE y = 11 AND x < 11 UNION ALL SELECT 3, -y, x, y FROM c WHERE x = 0 AND y < 11) SELECT row_number() OVER (ORDER BY side, k)::INT AS ord, x, y, round(23.4 + x * 0.001 + y * 0.0001, 6)::DOUBLE AS lon, round(0.4 - y * 0.002, 6)::DOUBLE AS lat FROM w")(
    lambda s, d: G.boundary_walk(_grid(s, d)).select("ord", "x", "y", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
)
_HAV = "2 * 1737400 * asin(sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))"
query("grid_spacing", f"WITH g AS (SELECT unnest(range(0, 144)) AS i), c AS (SELECT i % 12 AS x, i // 12 AS y, 23.4::DOUBLE + (i % 12) * 0.001::DOUBLE + (i // 12) * 0.0001::DOUBLE AS lon, 0.4::DOUBLE - (i // 12) * 0.002::DOUBLE AS lat FROM g), n AS (SELECT *, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2, lead(x) OVER w AS x2 FROM c WHERE y % 3 = 0 WINDOW w AS (PARTITION BY y ORDER BY x)), q AS (SELECT {_HAV} / (x2 - x) AS m FROM n WHERE x2 IS NOT NULL) SELECT round(min(m), 3) AS m_min, round(median(m), 3) AS m_median, round(max(m), 3) AS m_max FROM q")(
    lambda s, d: T.spacing(_grid(s, d), "x", "y", 3, G.haversine(V("lon"), V("lat"), V("lead_lon"), V("lead_lat"))).agg(F.round(F.min("spacing"), 3).alias("m_min"), F.round(F.percentile("spacing", 0.5), 3).alias("m_median"), F.round(F.max("spacing"), 3).alias("m_max"))
)


def _support(s: SparkSession, d: str) -> DataFrame:
    from .fixtures import raster

    return raster(s, d, "click")


query("support_area", "SELECT user_id AS y, round(count(DISTINCT hour(ts)) * pow(1737400, 2) * radians(0.01) * abs(sin(radians(1 - user_id * 0.01)) - sin(radians(1 - (user_id + 1) * 0.01))) / 1e6, 6) AS km2 FROM events WHERE event_type = 'click' AND value > 0 GROUP BY user_id")(
    lambda s, d: tables.support_area(_support(s, d), 1.0, 0.01).select("y", F.round("km2", 6).alias("km2"))
)
query("support_inside", "WITH n AS (SELECT user_id AS y, hour(ts) AS x FROM events WHERE event_type = 'click' AND value > 0 GROUP BY ALL), k AS (SELECT y, count(*) AS n, count(*) FILTER (WHERE 23 + (x + 0.5) * 0.01 BETWEEN 23.05 AND 23.05 + (y % 10 + 1) * 0.015) AS m, pow(1737400, 2) * radians(0.01) * abs(sin(radians(1 - y * 0.01)) - sin(radians(1 - (y + 1) * 0.01))) / 1e6 AS cell FROM n GROUP BY y) SELECT y, n, round(n * cell, 6) AS km2, m AS n_inside, round(m * cell, 6) AS km2_inside FROM k")(
    lambda s, d: tables.support_area(_support(s, d), 1.0, 0.01, _support(s, d).select(V("y").alias("row"), F.lit(23.05).alias("lo"), (23.05 + (V("y") % 10 + 1) * 0.015).alias("hi")).distinct(), 23.0).select("y", "n", F.round("km2", 6).alias("km2"), "n_inside", F.round("km2_inside", 6).alias("km2_inside"))
)
query("gap_stats", "WITH r AS (SELECT user_id AS y, min(hour(ts)) AS first_x FROM events WHERE event_type = 'click' GROUP BY 1), g AS (SELECT y, round((23 + first_x * 0.1::DOUBLE - 23.25) * pi() * 1737400 / 180 * cos(radians(1 - y * 0.01)), 3) AS gap FROM r), k AS (SELECT *, row_number() OVER (ORDER BY y) AS rn, count(*) OVER () AS n, min(gap) OVER () AS gap_min, median(gap) OVER () AS gap_median, max(gap) OVER () AS gap_max FROM g) SELECT y, gap, gap_min, round(gap_median, 3) AS gap_median, gap_max FROM k WHERE rn = 1 OR rn = n // 2 + 1 OR rn = n")(
    lambda s, d: _gaps(s, d)
)


def _gaps(s: SparkSession, d: str) -> DataFrame:
    # Of the events themselves: a click without a value counts, and no grid is needed. Latitudes are decimals: 1 - y * 0.01 in doubles is not.
    clicks = table(s, d, "events").where("event_type = 'click'").select(V("user_id").alias("y"), F.hour("ts").alias("x"), F.lit(1.0).alias("v"))
    gap = tables.edge_gaps(clicks, 23.0, 0.1, F.lit(23.25), (100 - V("y")) / 100).withColumn("gap", round_scaled(V("gap"), 3))
    stats = tables.gap_stats(gap).withColumn("gap_median", round_scaled(V("gap_median"), 3))
    return T.pick_first_middle_last(gap, ["y"]).drop("rank").join(F.broadcast(stats))  # one row


query("interval_filter", "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")(
    lambda s, d: table(s, d, "events").where(V("ts").between(F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-06 12:00:00").cast("timestamp"))).select("event_id", "ts")
)
query("lat_window", "SELECT event_id, user_id, value FROM events WHERE value BETWEEN 10 AND 20 AND event_type = 'view'")(lambda s, d: table(s, d, "events").where("value between 10 and 20 and event_type = 'view'").select("event_id", "user_id", "value"))
query("series_stats", "SELECT event_type, 'value' AS field, count(*) AS records, min(ts) AS first_time, max(ts) AS last_time, min(value) AS v_min, round(median(value), 6) AS v_median, max(value) AS v_max FROM events GROUP BY 1 UNION ALL SELECT event_type, 'user_id', count(*), min(ts), max(ts), min(user_id)::DOUBLE, median(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events GROUP BY 1")(
    lambda s, d: T.series_stats(table(s, d, "events"), ["value", "user_id"], ["event_type"], "ts").withColumn("v_median", F.round("v_median", 6))
)
query("nearest_lat", "WITH t AS (SELECT o_orderkey, o_totalprice / 1000 AS want FROM orders), r AS (SELECT value, min(event_id) AS event_id FROM events GROUP BY value), lo AS (SELECT o_orderkey, want, value, event_id FROM t ASOF LEFT JOIN r ON want >= value), hi AS (SELECT o_orderkey, value, event_id FROM t ASOF LEFT JOIN r ON want <= value), b AS (SELECT o_orderkey, lo.event_id AS e1, lo.value AS v1, hi.event_id AS e2, hi.value AS v2, hi.value IS NULL OR abs(lo.value - want) < abs(hi.value - want) OR (abs(lo.value - want) = abs(hi.value - want) AND lo.event_id <= hi.event_id) AS low FROM lo JOIN hi USING (o_orderkey)) SELECT o_orderkey, CASE WHEN low THEN e1 ELSE e2 END AS event_id, CASE WHEN low THEN v1 ELSE v2 END AS value FROM b")(
    lambda s, d: T.nearest(table(s, d, "orders").select("o_orderkey", (V("o_totalprice") / 1000).alias("want")), table(s, d, "events").select("event_id", "value"), "want", "value", "event_id").select("o_orderkey", "event_id", "value")
)
query("nearest_band", "SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(p_retailprice - s_acctbal), p_partkey) AS r FROM supplier CROSS JOIN part) WHERE r = 1")(
    lambda s, d: T.nearest(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), table(s, d, "part").select("p_partkey", "p_retailprice"), "s_acctbal", "p_retailprice", "p_partkey").select("s_suppkey", "p_partkey")
)
# Lines, headers and labels are spelled out of table columns, so that both engines parse the same text.
_LINE = "rpad('ORBTATTD', 18, ' ') || lpad(year(ts)::VARCHAR, 4, ' ') || lpad(month(ts)::VARCHAR, 4, ' ') || lpad(day(ts)::VARCHAR, 4, ' ') || lpad(hour(ts)::VARCHAR, 4, ' ') || lpad(minute(ts)::VARCHAR, 4, ' ') || lpad(second(ts)::VARCHAR, 4, ' ') || lpad('0', 4, ' ') || lpad(user_id::VARCHAR, 20, ' ')"


def _lines(s: SparkSession, d: str) -> DataFrame:
    p = lambda c, n: F.lpad(c.cast("string"), n, " ")
    e = table(s, d, "events")
    parts = [F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.second("ts"), F.lit("0")]
    return e.select("event_id", F.concat(F.rpad(F.lit("ORBTATTD"), 18, " "), *[p(c, 4) for c in parts], p(V("user_id"), 20)).alias("value"))


query("fixed_width_parse", f"WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT event_id, trim(substr(line, 47, 20))::DOUBLE AS lunar_x, make_timestamp(trim(substr(line, 19, 4))::BIGINT, trim(substr(line, 23, 4))::BIGINT, trim(substr(line, 27, 4))::BIGINT, trim(substr(line, 31, 4))::BIGINT, trim(substr(line, 35, 4))::BIGINT, trim(substr(line, 39, 4))::DOUBLE) AS ts FROM l")(
    lambda s, d: text_records.parse_fixed(
        _lines(s, d).select("event_id", F.make_timestamp(*[text_records.cut(V("value"), *text_records.ORBIT_TIME[n]).cast("int") for n in ("year", "month", "day", "hour", "minute")], text_records.cut(V("value"), 38, 4).cast("decimal(8,6)")).alias("ts"), "value"), {"lunar_x": (46, 20)}
    )
)
query("token_parse", f"WITH l AS (SELECT event_id, {_LINE} AS line FROM events) SELECT regexp_split_to_array(trim(line), '\\s+')[2]::DOUBLE AS first_token, regexp_split_to_array(trim(line), '\\s+')[9]::DOUBLE AS last_token FROM l")(
    lambda s, d: text_records.tokens(_lines(s, d), {"first_token": 1, "last_token": 8})
)
query("kv_header_parse", "SELECT p_partkey, 'brand name' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part")(
    lambda s, d: text_records.key_values(table(s, d, "part").select("p_partkey", F.explode(F.array(F.concat(F.lit(" Brand Name = "), "p_brand", F.lit(" ")), F.concat(F.lit("SIZE="), "p_size"), F.lit("no pair"))).alias("value")))
)
query("regex_table_extract", "SELECT p_partkey, (p_size % 5 + 1)::INT AS band, round(p_retailprice / 1000, 6) AS wavelength_um FROM part")(
    lambda s, d: text_records.band_table(table(s, d, "part").select("p_partkey", F.concat(F.lit("<Band_Bin><isda:band_number>"), (V("p_size") % 5 + 1).cast("string"), F.lit('</isda:band_number><center_wavelength unit="nm"> '), V("p_retailprice").cast("string"), F.lit(" </center_wavelength></Band_Bin>")).alias("t")), "p_partkey", "t").withColumn("wavelength_um", F.round("wavelength_um", 6))
)
query("json_extract", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
_PATHS = "p AS (SELECT 'root/' || CASE page_id % 4 WHEN 0 THEN 'ohr' WHEN 1 THEN 'tmc' WHEN 2 THEN 'iir' ELSE 'xyz' END || (page_id // 8)::VARCHAR AS dir, CASE page_id % 3 WHEN 0 THEN '.img' WHEN 1 THEN '.XML' ELSE '.hdr' END AS ext, page_id FROM pages)"


def _paths(s: SparkSession, d: str) -> DataFrame:
    name = lambda *o: F.element_at(F.array(*map(F.lit, o)), (V("page_id") % len(o) + 1).cast("int"))
    return table(s, d, "pages").select(F.concat(F.lit("root/"), name("ohr", "tmc", "iir", "xyz"), F.floor(V("page_id") / 8).cast("string"), F.lit("/f"), V("page_id").cast("string"), name(".img", ".XML", ".hdr")).alias("path"))


query("catalog_discover", f"WITH {_PATHS}, g AS (SELECT dir, bool_or(lower(ext) = '.img') AS i, bool_or(lower(ext) = '.xml') AS x FROM p GROUP BY dir) SELECT dir, CASE WHEN dir LIKE '%ohr%' THEN 'OHRC' WHEN dir LIKE '%tmc%' THEN 'TMC' WHEN dir LIKE '%iir%' THEN 'IIRS' ELSE 'UNKNOWN_RAW' END AS sensor, 'raw' AS kind FROM g WHERE i AND x")(
    lambda s, d: catalogue.discover(_paths(s, d)).select("dir", "sensor", "kind")
)
query("checksum_verify", "SELECT page_id::VARCHAR AS file, md5(html) AS actual_md5, CASE WHEN page_id % 5 = 0 THEN 'bad' ELSE md5(html) END AS label_md5, page_id % 5 <> 0 AS match FROM pages")(
    lambda s, d: catalogue.verify(table(s, d, "pages").select(V("page_id").cast("string").alias("file"), F.md5(V("html").cast("binary")).alias("actual_md5")), table(s, d, "pages").select(V("page_id").cast("string").alias("file"), F.when(V("page_id") % 5 == 0, "bad").otherwise(F.md5(V("html").cast("binary"))).alias("label_md5")))
)
query("ingest_anti", "SELECT url AS path, length(html)::BIGINT AS size FROM pages WHERE page_id % 3 <> 0")(
    lambda s, d: catalogue.new_files(table(s, d, "pages").select(V("url").alias("path"), F.length("html").cast("long").alias("size")), table(s, d, "pages").where("page_id % 3 = 0").select(V("url").alias("path"), F.length("html").cast("long").alias("size")))
)
query("prefix_filter", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_brand, 'B') AND (p_type LIKE '%A%' OR p_name LIKE '%3')")(
    lambda s, d: table(s, d, "part").where(V("p_brand").startswith("B") & (V("p_type").contains("A") | V("p_name").endswith("3"))).select("p_partkey", "p_type")
)
query("record_stats", "SELECT 'value' AS field, count(*) AS records, min(ts) AS first_time, max(ts) AS last_time, min(value) AS v_min, round(median(value), 6) AS v_median, max(value) AS v_max FROM events UNION ALL SELECT 'user_id', count(*), min(ts), max(ts), min(user_id)::DOUBLE, median(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events")(
    lambda s, d: T.series_stats(table(s, d, "events"), ["value", "user_id"], [], "ts").withColumn("v_median", F.round("v_median", 6))
)
