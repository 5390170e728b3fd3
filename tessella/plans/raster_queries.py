"""Queries over the event raster, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safe import is_valid
from ..operators import geometry as G
from ..operators import radiometry as R
from ..operators import resample as S
from ..operators import shift, stencil, tables
from ..registry import query
from . import recipes
from .fixtures import GRADIENT, MAGNITUDE, MASKED, RASTER, STRETCHED, raster

V = F.col
D = 6
#: Added before rounding where results are short decimals, whose last digit would else hang on the order of a sum.
OFF = 0.0000000123


def matched_sql(u: str, every: bool = False) -> str:
    """Relation hm: product click (or every product) of u, matched to product view's histogram."""
    who = "" if every else " WHERE product IN ('click', 'view')"
    return f"""hc AS (SELECT product, v, count(*) AS n FROM {u}{who} GROUP BY 1, 2), hs AS (SELECT product, v, sum(n) OVER (PARTITION BY product ORDER BY v) / sum(n) OVER (PARTITION BY product) AS share FROM hc), hr AS (SELECT share, v FROM hs WHERE product = 'view'),
ht AS (SELECT s.product, s.v, s.share, (SELECT max(share) FROM hr WHERE hr.share <= s.share) AS lo, (SELECT min(share) FROM hr WHERE hr.share >= s.share) AS hi FROM hs s),
hx AS (SELECT ht.product, ht.v, trunc(least(greatest(CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL OR hi = lo THEN a.v ELSE a.v + (ht.share - lo) / (hi - lo) * (b.v - a.v) END, 0), 255))::BIGINT AS m FROM ht LEFT JOIN hr a ON a.share = lo LEFT JOIN hr b ON b.share = hi),
hm AS (SELECT u.product, u.y, u.x, m AS v FROM {u} u JOIN hx ON hx.product = u.product AND hx.v = u.v)"""


def clahe_sql(u: str, tiles: int) -> str:
    """Relation cl: u after adaptive equalisation."""
    return f"""cz AS (SELECT product, ceil((max(y) + 1) / {tiles}.0::DOUBLE) AS th, ceil((max(x) + 1) / {tiles}.0::DOUBLE) AS tw FROM {u} GROUP BY product), cp AS (SELECT a.product, y, x, v::INT AS b, floor(y / th) AS ty, floor(x / tw) AS tx, (y + 0.5::DOUBLE) / th - 0.5 AS fy, (x + 0.5::DOUBLE) / tw - 0.5 AS fx FROM {u} a JOIN cz USING (product)),
ch AS (SELECT product, ty, tx, b, count(*) AS n FROM cp GROUP BY ALL), ca AS (SELECT product, ty, tx, sum(n) AS area FROM ch GROUP BY ALL), cb AS (SELECT ca.*, t.b, coalesce(n, 0) AS n, least(coalesce(n, 0), greatest(floor(2.0::DOUBLE * area / 256), 1)) AS kept FROM ca CROSS JOIN (SELECT unnest(range(0, 256)) AS b) t LEFT JOIN ch ON ch.product = ca.product AND ch.ty = ca.ty AND ch.tx = ca.tx AND ch.b = t.b),
ck AS (SELECT *, kept + sum(n - kept) OVER (PARTITION BY product, ty, tx) / 256.0::DOUBLE AS k FROM cb), cu AS (SELECT product, ty, tx, b, least(greatest(round_even(round(sum(k) OVER (PARTITION BY product, ty, tx ORDER BY b) * 255 / area, 9), 0), 0), 255) AS lut FROM ck),
cw AS (SELECT cp.product, y, x, b, least(greatest(floor(fy) + dy, 0), {tiles - 1}) AS ty, least(greatest(floor(fx) + dx, 0), {tiles - 1}) AS tx, (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM cp CROSS JOIN (SELECT unnest([0, 1]) AS dy) a CROSS JOIN (SELECT unnest([0, 1]) AS dx) c),
cl AS (SELECT cw.product, y, x, round_even(round(sum(lut * w) / sum(w), 9), 0) AS v FROM cw JOIN cu USING (product, ty, tx, b) GROUP BY cw.product, y, x)"""


def resample_sql(r: str, scale: float) -> str:
    """Relation rs: r resampled along rows, then along columns."""
    d = f"CASE WHEN abs(pos - (floor(pos) + k)) <= 1 THEN ((-0.75 + 2) * abs(pos - (floor(pos) + k)) - (-0.75 + 3)) * pow(abs(pos - (floor(pos) + k)), 2) + 1 ELSE ((-0.75 * abs(pos - (floor(pos) + k)) + 3.75) * abs(pos - (floor(pos) + k)) - 6) * abs(pos - (floor(pos) + k)) + 3 END"
    out = []
    for source, name, axis, other in ((r, "rx", "x", "y"), ("rx", "rs", "y", "x")):
        out.append(f"{name}n AS (SELECT product, max({axis}) + 1 AS n, greatest(1, round_even((max({axis}) + 1) * {scale}::DOUBLE, 0)) AS m FROM {source} GROUP BY product), {name}o AS (SELECT *, unnest(range(0, m::BIGINT)) AS o FROM {name}n), {name}t AS (SELECT product, o, n, (o + 0.5::DOUBLE) * (n / m) - 0.5 AS pos, k FROM {name}o CROSS JOIN (SELECT unnest(range(-1, 3)) AS k)), {name}w AS (SELECT product, o, least(greatest(floor(pos) + k, 0), n - 1) AS i, {d} AS w FROM {name}t), {name} AS (SELECT s.product, s.{other}, t.o AS {axis}, sum(s.v * t.w) AS v FROM {name}w t JOIN {source} s ON s.product = t.product AND s.{axis} = t.i GROUP BY s.product, s.{other}, t.o)")
    return ", ".join(out)


def _r(c, name: str | None = None, digits: int = D):
    c = V(c) if isinstance(c, str) else c
    return F.round(c, digits).alias(name or "v")


query("norm_u8", f"WITH {RASTER}, {STRETCHED} SELECT * FROM u")(lambda s, d: R.normalize_u8(raster(s, d)))
query("norm_masked", f"WITH {RASTER}, {MASKED} SELECT product, y, x, valid, round(v, 6) AS v FROM m")(lambda s, d: R.normalize_masked(raster(s, d)).select("product", "y", "x", "valid", _r("v")))
query("valid_mask", f"WITH {RASTER} SELECT *, v > 0 AS valid FROM r")(lambda s, d: stencil.valid_mask(raster(s, d)))
query("invert", f"WITH {RASTER}, {STRETCHED} SELECT product, y, x, 255 - v AS v FROM u")(lambda s, d: R.normalize_u8(raster(s, d)).withColumn("v", R.invert(V("v"))))
query("shadow_lift", f"WITH {RASTER}, {STRETCHED} SELECT product, y, x, trunc(CASE WHEN v < 40 THEN least(greatest(v * 1.8::DOUBLE, 0), 255) ELSE v END)::BIGINT AS v FROM u")(
    lambda s, d: R.normalize_u8(raster(s, d)).withColumn("v", R.shadow_lift(V("v")))
)
query(
    "log_compress",
    f"WITH {RASTER}, {STRETCHED}, l AS (SELECT product, y, x, ln(1 + v / 255::DOUBLE) AS v FROM u) SELECT product, y, x, trunc(round(CASE WHEN max(v) OVER w > 0 THEN v / max(v) OVER w * 255 ELSE v END, 9))::BIGINT AS v FROM l WINDOW w AS (PARTITION BY product)",
)(lambda s, d: R.log_compress(R.normalize_u8(raster(s, d))))
query("to_float01", f"WITH {RASTER}, {STRETCHED} SELECT product, y, x, round(v / 255::DOUBLE, 6) AS v FROM u")(lambda s, d: R.normalize_u8(raster(s, d)).withColumn("v", F.round(R.to_unit(V("v")), D)))
query("to_u8", f"WITH {RASTER}, {MASKED} SELECT product, y, x, round_even(round(v, 6) * 255, 0)::INT AS v FROM m")(lambda s, d: R.normalize_masked(raster(s, d)).select("product", "y", "x", R.to_u8(F.round("v", D)).alias("v")))
query(
    "gamma_contrast",
    f"WITH {RASTER}, {MASKED} SELECT product, y, x, round(CASE WHEN valid THEN least(greatest(0.5 + (0.85 + 0.3 * (y % 7) / 6::DOUBLE) * (pow(v, 0.8 + 0.45 * (x % 5) / 4::DOUBLE) - 0.5), 0), 1) ELSE 0 END, 6) AS v FROM m",
)(lambda s, d: R.normalize_masked(raster(s, d)).select("product", "y", "x", _r(R.gamma_contrast(V("v"), 0.8 + 0.45 * (V("x") % 5) / 4, 0.85 + 0.3 * (V("y") % 7) / 6, V("valid")))))
query("minmax_scale", f"WITH {RASTER} SELECT product, y, x, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 255, 6) AS v FROM r WINDOW w AS (PARTITION BY product)")(
    lambda s, d: R.minmax_stretch(raster(s, d)).select("product", "y", "x", _r("v"))
)
query("gradient_xy", f"WITH {RASTER}, {MASKED}, {GRADIENT} SELECT product, y, x, round(gx, 6) AS gx, round(gy, 6) AS gy FROM g")(
    lambda s, d: stencil.gradient(R.normalize_masked(raster(s, d))).select("product", "y", "x", _r("gx", "gx"), _r("gy", "gy"))
)
query("grad_mag", f"WITH {RASTER}, {MASKED}, {GRADIENT}, {MAGNITUDE} SELECT * FROM k")(lambda s, d: stencil.gradient_magnitude(raster(s, d)))
ORIENT = "o AS (SELECT product, y, x, CASE WHEN valid THEN cos(2 * atan2(gy, gx)) * sqrt(gx * gx + gy * gy) ELSE 0 END AS c, CASE WHEN valid THEN sin(2 * atan2(gy, gx)) * sqrt(gx * gx + gy * gy) ELSE 0 END AS s FROM g)"
query("orient_features", f"WITH {RASTER}, {MASKED}, {GRADIENT}, {ORIENT} SELECT product, y, x, round(c, 6) + 0 AS c, round(s, 6) + 0 AS s FROM o")(
    lambda s, d: stencil.orientation(raster(s, d)).select("product", "y", "x", (F.round("c", D) + 0).alias("c"), (F.round("s", D) + 0).alias("s"))
)
_NEIGHBOURS = "z AS (SELECT product, max(y) AS my, max(x) AS mx FROM u GROUP BY product), nb AS (SELECT u.product, u.y, u.x, u.v, o.dy, p.dx, n.v AS n FROM u JOIN z USING (product) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dy) o CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx) p JOIN u n ON n.product = u.product AND n.y = {y} AND n.x = {x})"
_EDGE = _NEIGHBOURS.format(y="least(greatest(u.y + o.dy, 0), z.my)", x="least(greatest(u.x + p.dx, 0), z.mx)")
_MIRROR = _NEIGHBOURS.format(y="CASE WHEN u.y + o.dy > z.my THEN 2 * z.my - (u.y + o.dy) ELSE abs(u.y + o.dy) END", x="CASE WHEN u.x + p.dx > z.mx THEN 2 * z.mx - (u.x + p.dx) ELSE abs(u.x + p.dx) END")
query("box_smooth", f"WITH {RASTER}, {STRETCHED}, {_MIRROR} SELECT product, y, x, floor(sum(n) / 25.0)::BIGINT AS v FROM nb GROUP BY ALL HAVING true")(
    lambda s, d: stencil.box_mean(R.normalize_u8(raster(s, d)))
)
query(
    "dilate",
    f"WITH {RASTER}, {STRETCHED}, {_EDGE} SELECT product, y, x, max(n) FILTER (WHERE abs(dy) + abs(dx) <= 1) AS v FROM nb GROUP BY product, y, x",
)(lambda s, d: stencil.dilate_cross(R.normalize_u8(raster(s, d))))
query("median_blur", f"WITH {RASTER}, {STRETCHED}, {_EDGE} SELECT product, y, x, quantile_cont(n::DOUBLE, 0.5) AS v FROM nb GROUP BY product, y, x")(lambda s, d: stencil.median_blur(R.normalize_u8(raster(s, d))))
query(
    "bilateral",
    f"WITH {RASTER}, {STRETCHED}, {_EDGE}, w AS (SELECT *, exp(-(dy * dy + dx * dx) / 5000.0::DOUBLE - (n - v) * (n - v) / 5000.0::DOUBLE) AS w FROM nb WHERE dy * dy + dx * dx <= 4) SELECT product, y, x, round(sum(w * n) / sum(w), 6) AS v FROM w GROUP BY product, y, x",
)(lambda s, d: stencil.bilateral(R.normalize_u8(raster(s, d))).select("product", "y", "x", _r("v")))
query(
    "row_support",
    f"WITH {RASTER} SELECT product, y, x, v, coalesce(x BETWEEN min(x) FILTER (WHERE v > 0) OVER w AND max(x) FILTER (WHERE v > 0) OVER w, false) AS inside FROM r WINDOW w AS (PARTITION BY product, y)",
)(lambda s, d: stencil.support(raster(s, d)))
query(
    "left_justify",
    f"WITH {RASTER}, l AS (SELECT product, y, min(x) FILTER (WHERE v > 0) AS left_x FROM r GROUP BY product, y), c AS (SELECT l.product, l.y, t.x::BIGINT AS x, left_x FROM l CROSS JOIN (SELECT unnest(range(0, 18)) AS x) t) SELECT c.product, c.y, c.x, coalesce(r.v, 0) AS v FROM c LEFT JOIN r ON r.product = c.product AND r.y = c.y AND r.x = c.x + left_x",
)(lambda s, d: stencil.left_justify(raster(s, d), 18))
query("trim_ramp", f"WITH {RASTER}, n AS (SELECT max(y) AS last FROM r) SELECT product, y, x, v FROM r, n WHERE x < round_even(15 + y / last::DOUBLE * 8, 0)")(lambda s, d: S.trim_ramp(raster(s, d), 15, 23))
query("window_crop", f"WITH {RASTER} SELECT * FROM r WHERE y BETWEEN 3 AND 12 AND x BETWEEN 5 AND 14")(lambda s, d: S.window_crop(raster(s, d), 3, 10, 5, 10))
query("pad_multiple", f"WITH {RASTER}, z AS (SELECT product, ((max(y) + 8) // 8 * 8) AS h, ((max(x) + 8) // 8 * 8) AS w FROM r GROUP BY product), gr AS (SELECT product, y, unnest(range(0, w)) AS x FROM (SELECT product, w, unnest(range(0, h)) AS y FROM z)) SELECT gr.product, gr.y, gr.x, coalesce(v, 0) AS v, coalesce(v > 0, false) AS valid FROM gr LEFT JOIN r USING (product, y, x)")(
    lambda s, d: S.pad_to_multiple(raster(s, d))
)
_BINS = "n AS (SELECT product, y, max(x) + 1 AS n, {bins} AS bins FROM r GROUP BY product, y), ed AS (SELECT *, unnest(range(0, bins::BIGINT)) AS i FROM n), eb AS (SELECT product, y, i, floor(i * (n::DOUBLE / bins)) AS a, CASE WHEN i + 1 = bins THEN n ELSE floor((i + 1) * (n::DOUBLE / bins)) END AS b FROM ed), mn AS (SELECT eb.product, eb.y, eb.i AS x, coalesce(avg(r.v), 0) AS v FROM eb LEFT JOIN r ON r.product = eb.product AND r.y = eb.y AND r.x >= a AND r.x < b GROUP BY ALL)"
query("bin_mean_trunc", f"WITH {RASTER}, {_BINS.format(bins='7')} SELECT product, y, x, trunc(round(v, 6))::BIGINT AS v FROM mn")(lambda s, d: S.bin_means(raster(s, d), 7, half_even=False))
query("bin_mean_round", f"WITH {RASTER}, {_BINS.format(bins='5 + y % 4')} SELECT product, y, x, round_even(v, 0)::BIGINT AS v FROM mn")(lambda s, d: S.bin_means(raster(s, d), 5 + V("y") % 4, half_even=True))
_AREA = "z AS (SELECT product, (max(y) + 1) / 10.0::DOUBLE AS sy, (max(x) + 1) / 7.0::DOUBLE AS sx FROM r GROUP BY product), ov AS (SELECT r.product, ty, tx, v, least(y + 1, (ty + 1) * sy) - greatest(y, ty * sy) AS oy, least(x + 1, (tx + 1) * sx) - greatest(x, tx * sx) AS ox FROM r JOIN z USING (product) CROSS JOIN (SELECT unnest(range(0, 10)) AS ty) a CROSS JOIN (SELECT unnest(range(0, 7)) AS tx) b)"
query("area_resize", f"WITH {RASTER}, {_AREA} SELECT product, ty AS y, tx AS x, round(sum(v * oy * ox) / sum(oy * ox), 6) AS v FROM ov WHERE oy > 1e-9 AND ox > 1e-9 GROUP BY product, ty, tx")(
    lambda s, d: S.area_resize(raster(s, d), 10, 7).select("product", "y", "x", _r("v"))
)
query("preview_mean", f"WITH {RASTER} SELECT product, y // 4 AS y, x // 4 AS x, round(avg(v), 6) AS v FROM r GROUP BY 1, 2, 3")(lambda s, d: S.block_mean(raster(s, d), 4).select("product", "y", "x", _r("v")))
query("pool_valid", f"WITH {RASTER} SELECT product, y // 8 AS y, x // 8 AS x, avg((v > 0)::INT) > 0.5 AS valid FROM r GROUP BY 1, 2, 3")(
    lambda s, d: S.block_mean(raster(s, d).withColumn("v", (V("v") > 0).cast("double")), 8).select("product", "y", "x", (V("v") > 0.5).alias("valid"))
)
query("patchify", f"WITH {RASTER} SELECT product, y // 6 AS py, x // 6 AS px, array_to_string(list(round(v * 100)::BIGINT ORDER BY y, x), ',') AS pixels FROM r GROUP BY 1, 2, 3")(
    lambda s, d: S.patchify(raster(s, d), 6).select("product", "py", "px", F.array_join(F.transform("values", lambda v: F.round(v * 100).cast("long").cast("string")), ",").alias("pixels"))
)
query(
    "raster_stats",
    f"WITH {RASTER}, {STRETCHED} SELECT product, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean, median(v)::DOUBLE AS v_median, round(quantile_cont(v, 0.02), 6) AS p2, round(quantile_cont(v, 0.98), 6) AS p98, round(avg((v = 0)::INT) * 100, 6) AS zero_pct, round(avg((v = 255)::INT) * 100, 6) AS top_pct FROM u GROUP BY product",
)(
    lambda s, d: tables.raster_stats(R.normalize_u8(raster(s, d))).select("product", "v_min", "v_max", _r("v_mean", "v_mean"), "v_median", *[_r(c, c) for c in ("p2", "p98", "zero_pct", "top_pct")])
)
query("best_contrast", f"WITH {RASTER} SELECT product, round(stddev_pop(v), 6) AS spread FROM r GROUP BY product ORDER BY spread DESC, product LIMIT 1")(
    lambda s, d: tables.best_contrast(raster(s, d)).withColumn("spread", F.round("spread", D))
)
query("joint_valid", f"WITH {RASTER} SELECT a.y, a.x, a.v AS va, b.v AS vb FROM r a JOIN r b USING (y, x) WHERE a.product = 'click' AND b.product = 'view' AND a.v > 0 AND b.v > 0")(
    lambda s, d: raster(s, d, "click").where(is_valid(V("v"))).select("y", "x", V("v").alias("va")).join(raster(s, d, "view").where(is_valid(V("v"))).select("y", "x", V("v").alias("vb")), ["y", "x"])
)


query(
    "pair_validate",
    f"WITH {RASTER}, c AS (SELECT count(*) FILTER (WHERE a.v > 0) AS valid_a, count(*) FILTER (WHERE b.v > 0) AS valid_b, count(*) FILTER (WHERE a.v > 0 AND b.v > 0) AS common, count(*) AS pixels, 0::BIGINT AS unpaired FROM r a JOIN r b USING (y, x) WHERE a.product = 'click' AND b.product = 'view') SELECT *, round(common / pixels, 6) AS common_fraction, common / pixels < 0.01 AS small FROM c",
)(lambda s, d: tables.pair_check(raster(s, d, "click"), raster(s, d, "view"), strict=True).withColumn("common_fraction", F.round("common_fraction", D)))
LEAST = 30
_SHIFT = "sh AS (SELECT a.dx, b.dy FROM (SELECT unnest(range(-4, 5)) AS dx) a CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy) b)"
query(
    "ncc_shift",
    f"WITH {RASTER}, {MASKED}, {GRADIENT}, {MAGNITUDE}, {_SHIFT}, j AS (SELECT dx, dy, count(*) AS n, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS score FROM k a CROSS JOIN sh JOIN k b ON b.y = a.y - dy AND b.x = a.x - dx WHERE a.product = 'click' AND b.product = 'view' AND a.v > 0 AND b.v > 0 GROUP BY dx, dy) SELECT dx::INT AS dx, dy::INT AS dy, n, round(score, 8) AS score FROM j WHERE n >= {LEAST} AND score IS NOT NULL ORDER BY round(score, 8) DESC, dx DESC, dy DESC LIMIT 10",
)(lambda s, d: shift.best(shift.correlate_bands(stencil.gradient_magnitude(raster(s, d, "click")), stencil.gradient_magnitude(raster(s, d, "view")), 4, LEAST, 64)))
query(
    "ncc_shift_bands",
    f"WITH {RASTER}, {_SHIFT}, j AS (SELECT dx, dy, count(*) AS n, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS score FROM r a CROSS JOIN sh JOIN r b ON b.y = a.y - dy AND b.x = a.x - dx WHERE a.product = 'click' AND b.product = 'view' AND a.v > 0 AND b.v > 0 GROUP BY dx, dy) SELECT dx::INT AS dx, dy::INT AS dy, n, round(score, 6) AS score FROM j WHERE n >= {LEAST} ORDER BY round(score, 6) DESC, dx DESC, dy DESC LIMIT 10",
)(lambda s, d: shift.best(shift.correlate_bands(raster(s, d, "click"), raster(s, d, "view"), 4, LEAST, 32), digits=6))
query(
    "orient_shift",
    f"WITH {RASTER}, {MASKED}, {GRADIENT}, {ORIENT}, {_SHIFT}, q AS (SELECT * FROM o WHERE sqrt(c * c + s * s) > 1e-9), j AS (SELECT dx, dy, count(*) AS n, avg((a.c * b.c + a.s * b.s) / (sqrt(a.c * a.c + a.s * a.s) * sqrt(b.c * b.c + b.s * b.s))) AS score FROM q a CROSS JOIN sh JOIN q b ON b.y = a.y - dy AND b.x = a.x - dx WHERE a.product = 'click' AND b.product = 'view' GROUP BY dx, dy) SELECT dx::INT AS dx, dy::INT AS dy, n, round(score, 8) AS score FROM j WHERE n >= {LEAST} ORDER BY round(score, 8) DESC, dx DESC, dy DESC LIMIT 10",
)(lambda s, d: shift.best(shift.orientation_bands(stencil.orientation(raster(s, d, "click")), stencil.orientation(raster(s, d, "view")), 4, LEAST, 64)))
query(
    "histogram_match",
    f"WITH {RASTER}, {STRETCHED}, {matched_sql('u')} SELECT * FROM hm WHERE product = 'click'",
)(lambda s, d: R.histogram_match(R.normalize_u8(raster(s, d)), "click", "view"))
query("clahe", f"WITH {RASTER}, {STRETCHED}, {clahe_sql('u', 4)} SELECT product, y, x, v::DOUBLE AS v FROM cl")(lambda s, d: stencil.equalize_adaptive(R.normalize_u8(raster(s, d)), tiles=4))
query("resample_cubic", f"WITH {RASTER}, {resample_sql('r', 2.0 / 3.0)} SELECT product, y, x, round(v + {OFF}::DOUBLE, 6) + 0 AS v FROM rs")(lambda s, d: S.resample(raster(s, d), 2.0, 3.0).select("product", "y", "x", (F.round(V("v") + OFF, D) + 0).alias("v")))


def recipe_sql(*steps: str) -> str:
    """The recipe's steps after the stretch to 0..255, in SQL, and their names."""
    chain, at = [RASTER, STRETCHED], "u"
    names = ["normalize_u8"]
    for step in steps:
        if step == "clahe":
            chain.append(clahe_sql(at, 8))
            at = "cl"
        elif step == "invert":
            chain.append(f"iv AS (SELECT product, y, x, 255 - v AS v FROM {at})")
            at = "iv"
        elif step == "dilate":
            chain.append(f"di AS (SELECT a.product, a.y, a.x, max(n.v) AS v FROM {at} a JOIN {at} n ON n.product = a.product AND abs(n.y - a.y) + abs(n.x - a.x) <= 1 GROUP BY a.product, a.y, a.x)")
            at = "di"
        elif step == "median":
            chain += [_EDGE, "md AS (SELECT product, y, x, quantile_cont(n::DOUBLE, 0.5) AS v FROM nb GROUP BY product, y, x)"]
            at = "md"
        elif step == "histogram_match":
            chain.append(matched_sql(at, every=True))
            at = "hm"
        elif step == "shadow_lift":
            chain.append(f"sl AS (SELECT product, y, x, trunc(CASE WHEN v < 40 THEN least(greatest(v * 1.8::DOUBLE, 0), 255) ELSE v END)::BIGINT AS v FROM {at})")
            at = "sl"
        elif step == "log_compress":
            chain.append(f"lg0 AS (SELECT product, y, x, ln(1 + v / 255::DOUBLE) AS v FROM {at}), lg AS (SELECT product, y, x, trunc(round(CASE WHEN max(v) OVER w > 0 THEN v / max(v) OVER w * 255 ELSE v END, 9))::BIGINT AS v FROM lg0 WINDOW w AS (PARTITION BY product))")
            at = "lg"
        names.append(step)
    return f"WITH {', '.join(chain)} SELECT product, y, x, v::DOUBLE AS v, '{','.join(names)}' AS steps FROM {at}"


def _recipe(df: DataFrame, name: str, **options) -> DataFrame:
    return recipes.run_recipe(df, name, **options).select("product", "y", "x", V("v").cast("double").alias("v"), F.array_join("steps_applied", ",").alias("steps"))


for _name, _steps in {"OHRC_NAC": ("clahe", "invert", "dilate"), "IIRS_WAC": ("shadow_lift", "log_compress"), "DFSAR_SELENE": ("median", "log_compress"), "TMC_NAC": ("clahe",), "IIRS_1P5UM": ("shadow_lift", "log_compress")}.items():
    query(f"recipe_{_name.lower()}", recipe_sql(*_steps))(lambda s, d, n=_name: _recipe(raster(s, d), n))
query("recipe_iirs_wac_matched", recipe_sql("histogram_match", "shadow_lift", "log_compress"))(lambda s, d: _recipe(raster(s, d), "IIRS_WAC", reference=raster(s, d, "view")))


def _cube(s, d) -> DataFrame:
    """Every product thrice, the bands scaled differently."""
    return raster(s, d).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("v", V("v") * (1 + V("band")))


query("nadir_pick", f"WITH {RASTER} SELECT product, y, x, v * 2 AS v FROM r")(lambda s, d: recipes.pick_nadir(_cube(s, d), ["Fore", "NADIR", "Aft"]).select("product", "y", "x", "v"))
query("contrast_pick", f"WITH {RASTER} SELECT product, y, x, v * 3 AS v FROM r")(lambda s, d: recipes.pick_contrast(_cube(s, d)).select("product", "y", "x", "v"))
query("wavelength_pick", f"WITH {RASTER} SELECT product, y, x, v * CASE WHEN length(product) % 2 = 0 THEN 2 ELSE 1 END AS v FROM r")(
    lambda s, d: recipes.pick_wavelength(
        _cube(s, d), _cube(s, d).select("product", "band").distinct().withColumn("wavelength_um", F.when(F.length("product") % 2 == 0, 1.0 + V("band") * 0.45).otherwise(1.52 + V("band") * 0.3))
    ).select("product", "y", "x", "v")
)
query("stack_bands", f"WITH {RASTER} SELECT product, 0::INT AS band, y, x, v FROM r WHERE product = 'click' UNION ALL SELECT product, 1, y, x, v FROM r WHERE product = 'view'")(lambda s, d: tables.stack_bands(raster(s, d, "click"), raster(s, d, "view")))
query("model_input", f"WITH {RASTER}, {STRETCHED}, {_AREA.replace('FROM r ', 'FROM u ').replace('FROM r JOIN', 'FROM u JOIN').replace('r.product', 'u.product')}, av AS (SELECT product, ty, tx, sum(v * oy * ox) / sum(oy * ox) / 255 AS v FROM ov WHERE oy > 1e-9 AND ox > 1e-9 GROUP BY product, ty, tx) SELECT product, ch::INT AS channel, ty AS y, tx AS x, round(v, 6) AS v FROM av CROSS JOIN (SELECT unnest(range(0, 3)) AS ch)")(
    lambda s, d: recipes.to_model_input(R.normalize_u8(raster(s, d)), 10, 7, 3).select("product", "channel", "y", "x", _r("v"))
)
query(
    "recipe_corridor",
    f"WITH {RASTER}, {_BINS.format(bins='11')}, bn AS (SELECT product, y, x, round_even(v, 0) AS v FROM mn WHERE product IN ('click', 'view')), bb AS (SELECT product, quantile_cont(v, 0.02) FILTER (WHERE v > 0) AS lo, quantile_cont(v, 0.98) FILTER (WHERE v > 0) AS hi FROM bn GROUP BY product), nm AS (SELECT bn.product, y, x, CASE WHEN v > 0 THEN least(greatest((v - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo), 0), 1) ELSE 0 END AS v FROM bn JOIN bb USING (product)), z AS (SELECT product, ((max(y) + 8) // 8 * 8) AS h, ((max(x) + 8) // 8 * 8) AS w FROM nm GROUP BY product), gr AS (SELECT product, y, unnest(range(0, w)) AS x FROM (SELECT product, w, unnest(range(0, h)) AS y FROM z)), pd AS (SELECT gr.product, gr.y, gr.x, coalesce(v, 0) AS v FROM gr LEFT JOIN nm USING (product, y, x)) SELECT a.y, a.x, round(a.v, 6) AS va, a.v > 0 AS valid_a, round(b.v, 6) AS vb, b.v > 0 AS valid_b FROM pd a JOIN pd b USING (y, x) WHERE a.product = 'click' AND b.product = 'view'",
)(lambda s, d: recipes.corridor(raster(s, d, "click"), raster(s, d, "view"), 11).select("y", "x", _r("va", "va"), "valid_a", _r("vb", "vb"), "valid_b"))
query("corridor_shifts")(lambda s, d: recipes.register_corridor(raster(s, d, "click"), raster(s, d, "view"), (0, 1 << 30, 0, 24), 24, 4, LEAST)["shifts"])
query(
    "reproject",
    f"WITH {RASTER}, t AS (SELECT p.product, ys.y, xs.x, (100 + (xs.x + 0.5::DOUBLE) * 0.8::DOUBLE - 100) / 1 - 0.5 AS sx, ((50 + (ys.y + 0.5::DOUBLE) * -0.7::DOUBLE) - 50) / -1 - 0.5 AS sy FROM (SELECT DISTINCT product FROM r) p CROSS JOIN (SELECT unnest(range(0, 20)) AS y) ys CROSS JOIN (SELECT unnest(range(0, 30)) AS x) xs), c AS (SELECT t.*, floor(sy) + dy AS ny, floor(sx) + dx AS nx, (CASE WHEN dy = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE WHEN dx = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w FROM t CROSS JOIN (SELECT unnest([0, 1]) AS dy) a CROSS JOIN (SELECT unnest([0, 1]) AS dx) b) SELECT c.product, c.y, c.x, round(sum(w * r.v) + {OFF}::DOUBLE, 6) AS v FROM c LEFT JOIN r ON r.product = c.product AND r.y = c.ny AND r.x = c.nx WHERE w > 0 GROUP BY c.product, c.y, c.x HAVING count(*) FILTER (WHERE r.v IS NULL) = 0",
)(lambda s, d: G.reproject(raster(s, d), (100.0, 1.0, 0.0, 50.0, 0.0, -1.0), (100.0, 0.8, 0.0, 50.0, 0.0, -0.7), 20, 30).select("product", "y", "x", _r(V("v") + OFF)))
query("band_crop", f"WITH {RASTER} SELECT product, y, x, v * 2 AS v FROM r WHERE y BETWEEN 2 AND 9 AND x BETWEEN 4 AND 15")(lambda s, d: S.window_crop(_cube(s, d).where("band = 1"), 2, 8, 4, 12).select("product", "y", "x", "v"))
query(
    "shift_ranks",
    f"WITH {RASTER}, {_SHIFT}, j AS (SELECT dx, dy, count(*) AS n, covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0) AS score FROM r a CROSS JOIN sh JOIN r b ON b.y = a.y - dy AND b.x = a.x - dx WHERE a.product = 'click' AND b.product = 'view' AND a.v > 0 AND b.v > 0 GROUP BY dx, dy) SELECT dx::INT AS dx, dy::INT AS dy, n, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, dx DESC, dy DESC)::INT AS rank FROM j WHERE n >= {LEAST} AND score IS NOT NULL QUALIFY rank <= 10",
)(lambda s, d: tables.ranked(shift.correlate_bands(raster(s, d, "click"), raster(s, d, "view"), 4, LEAST, 32).withColumn("score", F.round("score", 6)), [F.desc("score"), F.desc("dx"), F.desc("dy")]))
