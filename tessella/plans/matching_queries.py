"""Queries on patches, features, splits, scores and scalar functions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import split
from ..operators import tables as T
from ..registry import query
from ..streaming import windows
from .fixtures import patches, table

V = F.col


def _features(s: SparkSession, d: str, side: int) -> DataFrame:
    """Features of one side of every pair: 50 ids in a row are a pair, even ones its first image and odd ones its second."""
    return patches(s, d).where(V("vec_id") % 2 == side).select(F.floor(V("vec_id") / 50).alias("pair"), F.floor(V("vec_id") % 50 / 2).alias("i"), "f")


_SIM = "fe AS (SELECT vec_id // 50 AS pair, (vec_id % 50) // 2 AS i, vec_id % 2 AS side, embedding::DOUBLE[] AS f FROM embeddings), sim AS (SELECT a.pair, a.i, b.i AS j, list_sum(list_transform(range(1, 65), lambda t: a.f[t] * b.f[t])) * 10 AS sim FROM fe a JOIN fe b ON a.pair = b.pair AND a.side = 0 AND b.side = 1)"
_LOGP = "lp AS (SELECT pair, i, j, 2 * sim - (ln(sum(exp(sim - mi)) OVER (PARTITION BY pair, i)) + mi) - (ln(sum(exp(sim - mj)) OVER (PARTITION BY pair, j)) + mj) AS logp FROM (SELECT *, max(sim) OVER (PARTITION BY pair, i) AS mi, max(sim) OVER (PARTITION BY pair, j) AS mj FROM sim))"
_MUTUAL = "bm AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY logp DESC, j) AS ri, row_number() OVER (PARTITION BY pair, j ORDER BY logp DESC, i) AS rj FROM lp), mu AS (SELECT pair, i, j, exp(logp) AS conf FROM bm WHERE ri = 1 AND rj = 1 AND exp(logp) > 0.01)"


def _similar(s: SparkSession, d: str) -> DataFrame:
    return M.similarity(_features(s, d, 0), _features(s, d, 1), 10.0)


def _truth(sim: DataFrame) -> DataFrame:
    """Cell i of one image is cell i of the other."""
    return sim.select("pair", "i").distinct().select("pair", "i", V("i").alias("j"), F.lit(True).alias("ok"))


def _kan(s: SparkSession, rows: DataFrame) -> DataFrame:
    tens = rows.select("vec_id", F.transform("f", lambda x: x * 10).alias("f"))
    return M.kan_layer(tens, "vec_id", *_weights(s)).select("vec_id", F.posexplode("f").alias("o", "y")).withColumn("y", F.round("y", 5))


query("similarity_cross", f"WITH {_SIM} SELECT pair, i, j, round(sim, 6) AS sim FROM sim")(lambda s, d: _similar(s, d).withColumn("sim", F.round("sim", 6)))
query("dual_softmax", f"WITH {_SIM}, {_LOGP} SELECT pair, i, j, round(logp, 6) AS logp FROM lp")(lambda s, d: M.dual_softmax(_similar(s, d)).select("pair", "i", "j", F.round("logp", 6).alias("logp")))
query("mutual_nn", f"WITH {_SIM}, {_LOGP}, {_MUTUAL} SELECT pair, i, j, round(conf, 6) AS conf FROM mu")(lambda s, d: M.mutual_nearest(M.dual_softmax(_similar(s, d)), 0.01).withColumn("conf", F.round("conf", 6)))
query("border_filter", f"WITH {_SIM}, {_LOGP}, {_MUTUAL} SELECT pair, i, j, round(conf, 6) AS conf FROM mu WHERE i % 5 BETWEEN 1 AND 3 AND i // 5 BETWEEN 1 AND 3")(
    lambda s, d: M.mutual_nearest(M.dual_softmax(_similar(s, d)), 0.01, 1, 5, 5).withColumn("conf", F.round("conf", 6))
)
query("cell_centers", "SELECT i AS cell, ((i % 18 + 0.5) * 8 - 0.5)::DOUBLE AS cx, ((i // 18 + 0.5) * 8 - 0.5)::DOUBLE AS cy FROM (SELECT unnest(range(0, 540)) AS i)")(
    lambda s, d: s.range(540).select(V("id").alias("cell"), *[c.alias(n) for c, n in zip(M.cell_centre(V("id"), 18), ("cx", "cy"), strict=True)])
)
_H = [1.02, 0.01, -3.0, -0.02, 0.98, 5.0, 1e-5, -2e-5, 1.0]


def _projected(s: SparkSession) -> DataFrame:
    x, y = M.cell_centre(V("id"), 18)
    px, py = M.project(x, y, F.array(*map(F.lit, _H)), guarded=True)
    return s.range(540).select(V("id").alias("cell"), px.alias("px"), py.alias("py"))


_PROJ = "pc AS (SELECT i AS cell, (i % 18 + 0.5) * 8 - 0.5 AS cx, (i // 18 + 0.5) * 8 - 0.5 AS cy FROM (SELECT unnest(range(0, 540)) AS i)), pp AS (SELECT cell, (1.02 * cx + 0.01 * cy - 3.0)::DOUBLE / (1e-5 * cx - 2e-5 * cy + 1) AS px, (-0.02 * cx + 0.98 * cy + 5.0)::DOUBLE / (1e-5 * cx - 2e-5 * cy + 1) AS py FROM pc)"
query("project_points", f"WITH {_PROJ} SELECT cell, round(px, 6) AS px, round(py, 6) AS py FROM pp")(lambda s, d: _projected(s).select("cell", F.round("px", 6).alias("px"), F.round("py", 6).alias("py")))


def _cells(s: SparkSession) -> DataFrame:
    target, inside = M.target_cell(V("px"), V("py"), 18, 30)
    return _projected(s).select("cell", target.alias("j"), inside.alias("ok"))


query("gt_cells", f"WITH {_PROJ}, uv AS (SELECT cell, round_even((px + 0.5) / 8 - 0.5, 0)::BIGINT AS u, round_even((py + 0.5) / 8 - 0.5, 0)::BIGINT AS v FROM pp) SELECT cell, greatest(0, least(v, 29)) * 18 + greatest(0, least(u, 17)) AS j, u BETWEEN 0 AND 17 AND v BETWEEN 0 AND 29 AS ok FROM uv")(lambda s, d: _cells(s))
query("bounded_offset", "SELECT event_id, round(4 * tanh(value / 4), 6) AS offset_px FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.round(M.bounded(V("value"), 4.0), 6).alias("offset_px")))


def _spline_sql(degree: int = 3, n: int = 5) -> str:
    """The recursion spelled out degree by degree: relation s{degree} (i, x, b)."""
    h = 6 / n
    out = [f"s0 AS (SELECT vec_id, x, i, (x >= -3 + {h} * (i - {degree}) AND x < -3 + {h} * (i - {degree} + 1))::INT::DOUBLE AS b FROM xs CROSS JOIN (SELECT unnest(range(0, {n + 2 * degree})) AS i))"]
    for k in range(1, degree + 1):
        out.append(f"s{k} AS (SELECT l.vec_id, l.x, l.i, (l.x - (-3 + {h} * (l.i - {degree}))) / ({h} * {k}) * l.b + (-3 + {h} * (l.i + {k + 1} - {degree}) - l.x) / ({h} * {k}) * r.b AS b FROM s{k - 1} l JOIN s{k - 1} r ON l.vec_id = r.vec_id AND r.i = l.i + 1)")
    return ", ".join(out)


query("bspline_basis", f"WITH xs AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x FROM embeddings), {_spline_sql()} SELECT vec_id, i::INT AS k, round(b, 6) + 0 AS b FROM s3")(
    lambda s, d: patches(s, d).select("vec_id", F.posexplode(F.array(*M.spline_bases(V("f")[0] * 10))).alias("k", "b")).withColumn("b", F.round("b", 6) + 0)
)
query("layer_norm", "WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, 64))::INT AS i FROM embeddings) SELECT vec_id, i, round((x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5), 5) AS x FROM t WINDOW w AS (PARTITION BY vec_id)")(
    lambda s, d: patches(s, d).select("vec_id", F.posexplode(M.layer_norm(V("f"))).alias("i", "x")).withColumn("x", F.round("x", 5))
)


def _weights(s: SparkSession) -> tuple[DataFrame, DataFrame]:
    base = s.range(2 * 64).select((V("id") % 2).cast("int").alias("o"), F.floor(V("id") / 2).cast("int").alias("i"), (F.pmod(V("id") * 37, F.lit(101)) / 101 - 0.5).alias("w"))
    spline = s.range(2 * 64 * 8).select((V("id") % 2).cast("int").alias("o"), (F.floor(V("id") / 2) % 64).cast("int").alias("i"), F.floor(V("id") / 128).cast("int").alias("k"), (F.pmod(V("id") * 53, F.lit(103)) / 103 - 0.5).alias("w"))
    return base, spline


query(
    "kan_layer",
    f"WITH xs AS (SELECT vec_id * 64 + i AS vec_id, x FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS x, unnest(range(0, 64)) AS i FROM embeddings)), {_spline_sql()}, tm AS (SELECT vec_id // 64 AS v, vec_id % 64 AS i, 0 AS k, x / (1 + exp(-x)) AS t FROM xs UNION ALL SELECT vec_id // 64, vec_id % 64, i + 1, b FROM s3), wt AS (SELECT id % 2 AS o, id // 2 AS i, 0 AS k, (id * 37 % 101) / 101 - 0.5 AS w FROM (SELECT unnest(range(0, 128)) AS id) UNION ALL SELECT id % 2, id // 2 % 64, id // 128 + 1, (id * 53 % 103) / 103 - 0.5 FROM (SELECT unnest(range(0, 1024)) AS id)) SELECT v AS vec_id, o::INT AS o, round(sum(t * w), 5) AS y FROM tm JOIN wt USING (i, k) GROUP BY v, o",
)(lambda s, d: _kan(s, patches(s, d)))
query("gather_join", f"WITH {_PROJ}, uv AS (SELECT cell, greatest(0, least(round_even((py + 0.5) / 8 - 0.5, 0)::BIGINT, 29)) * 18 + greatest(0, least(round_even((px + 0.5) / 8 - 0.5, 0)::BIGINT, 17)) AS j FROM pp) SELECT cell, j, label FROM uv JOIN embeddings ON vec_id = j")(
    lambda s, d: T.gathered(_cells(s).select("cell", "j"), patches(s, d).select("vec_id", "label"), "j", "vec_id")
)
query("top1_acc", f"WITH {_SIM}, {_LOGP}, b AS (SELECT pair, i, j, row_number() OVER (PARTITION BY pair, i ORDER BY logp DESC, j) AS r FROM lp) SELECT pair, round(avg((j = i)::INT), 6) AS acc FROM b WHERE r = 1 GROUP BY pair")(
    lambda s, d: M.top1_accuracy(M.dual_softmax(_similar(s, d)), _truth(_similar(s, d))).withColumn("acc", F.round("acc", 6))
)
query("losses", f"WITH {_SIM}, {_LOGP} SELECT pair, count(*) AS cells, round(avg(-logp), 6) AS matching_loss FROM lp WHERE i = j GROUP BY pair")(
    lambda s, d: M.matching_loss(M.dual_softmax(_similar(s, d)), _truth(_similar(s, d))).withColumn("matching_loss", F.round("matching_loss", 6))
)


def _masked(s: SparkSession, d: str, side: int) -> DataFrame:
    """Features with a validity: every seventh cell of the first image and every fifth of the second are invalid."""
    return _features(s, d, side).withColumn("valid", V("i") % (5 if side else 7) != 0)


_MASKED = "ms AS (SELECT pair, i, j, CASE WHEN i % 7 <> 0 AND j % 5 <> 0 THEN sim ELSE -1e4 END AS sim FROM sim)"
query("masked_mutual_nn", f"WITH {_SIM}, {_MASKED}, {_LOGP.replace('FROM sim))', 'FROM ms))')}, {_MUTUAL} SELECT pair, i, j, round(conf, 6) AS conf FROM mu WHERE i % 7 <> 0 AND j % 5 <> 0")(
    lambda s, d: M.mutual_nearest(M.dual_softmax(M.similarity(_masked(s, d, 0), _masked(s, d, 1), 10.0)), 0.01).withColumn("conf", F.round("conf", 6))
)


def network(s: SparkSession, sizes: tuple[int, ...] = (128, 4, 2)) -> list[tuple[DataFrame, DataFrame]]:
    """Weights of a network of these layer sizes, from fixed formulas."""
    layers = []
    for inputs, outputs in zip(sizes, sizes[1:], strict=False):
        cell = s.range(inputs * outputs).select((V("id") % outputs).cast("int").alias("o"), F.floor(V("id") / outputs).cast("int").alias("i"))
        base = cell.select("o", "i", (F.pmod((V("i") * outputs + V("o")) * 37, F.lit(101)) / 101 - 0.5).alias("w"))
        spline = cell.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("o", "i", "k", (F.pmod((V("i") * outputs + V("o")) * 53 + V("k") * 17, F.lit(103)) / 103 - 0.5).alias("w"))
        layers.append((base, spline))
    return layers


def _forward(s: SparkSession, d: str) -> DataFrame:
    return M.match_forward(_masked(s, d, 0), _masked(s, d, 1), network(s), 5, 5, temperature=0.001, threshold=0.01, border=0)


# Two layers of splines over every match have no short SQL; a test compares with array arithmetic.
query("match_forward")(lambda s, d: _forward(s, d).select("pair", "i", "j", *[F.round(c, 6).alias(c) for c in ("conf", "x0", "y0", "x1c", "y1c", "x1", "y1")]))


def _offset(s: SparkSession, d: str) -> DataFrame:
    """Events as refined places on a grid of 18 cells a row, with the truth of their cells."""
    e = table(s, d, "events").select((V("event_id") % 7).alias("pair"), V("event_id").alias("i"), (V("value") / 50).alias("dx"), (V("user_id") % 5 - 2.0).alias("dy"))
    cx, cy = M.cell_centre(V("i"), 18)
    refined = e.select("pair", "i", cx.alias("x1c"), cy.alias("y1c"), (cx + V("dx")).alias("x1"), (cy + V("dy")).alias("y1"))
    truth = e.select("pair", "i", (cx + 1.0).alias("tx"), (cy - 0.5).alias("ty"))
    return M.offset_loss(refined, truth).select("pairs", *[F.round(c, 6).alias(c) for c in ("mse", "rmse_px", "no_offset_rmse_px")])


query("offset_loss", "SELECT count(*) AS pairs, round(avg(pow(value / 50 - 1, 2) + pow(user_id % 5 - 1.5, 2)) / 2, 6) AS mse, round(sqrt(avg(pow(value / 50 - 1, 2) + pow(user_id % 5 - 1.5, 2))), 6) AS rmse_px, round(sqrt(1.25), 6)::DOUBLE AS no_offset_rmse_px FROM events")(lambda s, d: _offset(s, d))
query(
    "true_cells",
    f"WITH {_PROJ}, uv AS (SELECT cell, px, py, round_even((px + 0.5) / 8 - 0.5, 0)::BIGINT AS u, round_even((py + 0.5) / 8 - 0.5, 0)::BIGINT AS v FROM pp), n AS (SELECT DISTINCT vec_id // 50 AS pair FROM embeddings) SELECT pair, cell AS i, greatest(0, least(v, 29)) * 18 + greatest(0, least(u, 17)) AS j, u BETWEEN 0 AND 17 AND v BETWEEN 0 AND 29 AS ok, round(px, 6) AS tx, round(py, 6) AS ty FROM uv CROSS JOIN n",
)(
    lambda s, d: M.true_cells(patches(s, d).select(F.floor(V("vec_id") / 50).alias("pair")).distinct().withColumn("h", F.array(*map(F.lit, _H))), 540, 18, 30).select("pair", "i", "j", "ok", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"))
)


def _placed(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select(V("doc_id").alias("patch_id"), F.length("source").cast("long").alias("strip_id"), (V("doc_id") * 64).alias("row0"), (V("doc_id") % 3 * 100).alias("col0"))


query("guard_band_split", "WITH p AS (SELECT doc_id AS patch_id, length(source)::BIGINT AS strip_id, doc_id * 64 AS row0, doc_id % 3 * 100 AS col0, CASE (doc_id * 64 // 512) % 8 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS s FROM documents) SELECT patch_id, strip_id, row0, col0, CASE WHEN EXISTS (SELECT 1 FROM p h WHERE h.strip_id = p.strip_id AND h.s > p.s AND greatest(abs(h.row0 - p.row0) - 128, abs(h.col0 - p.col0) - 128, 0) < 128) THEN -1 ELSE s END AS split FROM p")(
    lambda s, d: split.assign_splits(_placed(s, d), 128)
)
query("split_counts", "WITH p AS (SELECT length(source)::BIGINT AS strip_id, doc_id * 64 AS row0, doc_id % 3 * 100 AS col0, CASE (doc_id * 64 // 512) % 8 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS s FROM documents), q AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM p h WHERE h.strip_id = p.strip_id AND h.s > p.s AND greatest(abs(h.row0 - p.row0) - 128, abs(h.col0 - p.col0) - 128, 0) < 128) THEN -1 ELSE s END AS split FROM p) SELECT t.split::INT AS split, count(q.split) AS patches FROM (SELECT unnest([-1, 0, 1, 2]) AS split) t LEFT JOIN q ON q.split = t.split GROUP BY t.split")(
    lambda s, d: T.split_counts(split.assign_splits(_placed(s, d), 128))
)


def matches(s: SparkSession, d: str) -> DataFrame:
    """Matches under a known homography, one in nine of them wrong."""
    cells = s.range(3 * 90).select(F.floor(V("id") / 90).alias("pair"), (V("id") % 90).alias("c"))
    x, y = V("c") % 10 * 12.0 + V("pair"), F.floor(V("c") / 10) * 13.0
    h = F.array(*map(F.lit, _H))
    px, py = M.project(x, y, h)
    wrong = F.when(V("c") % 9 == 4, 40.0 + V("c")).otherwise(0.0)
    both = cells.select("pair", F.explode(F.array(F.lit("coarse"), F.lit("kan"))).alias("variant"), "c", x.alias("x0"), y.alias("y0"), px.alias("px"), py.alias("py"), wrong.alias("w"), h.alias("h_gt"))
    noise = F.when(V("variant") == "coarse", F.sin(V("c") * 7.0) * 0.4).otherwise(F.sin(V("c") * 7.0) * 0.1)
    return both.select("pair", "variant", "x0", "y0", (V("px") + V("w") + noise).alias("x1"), (V("py") - V("w") + noise).alias("y1"), "h_gt")


# A seeded consensus has no SQL; tests bound its errors.
query("match_metrics")(lambda s, d: M.score_matches(matches(s, d), 128))
query(
    "match_errors",
    "WITH c AS (SELECT id // 90 AS pair, id % 90 AS c FROM (SELECT unnest(range(0, 270)) AS id)), e AS (SELECT pair, variant, sqrt(pow(w + noise, 2) + pow(noise - w, 2)) AS err FROM (SELECT pair, variant, CASE WHEN c % 9 = 4 THEN 40.0::DOUBLE + c ELSE 0 END AS w, CASE WHEN variant = 'coarse' THEN sin(c * 7.0::DOUBLE) * 0.4 ELSE sin(c * 7.0::DOUBLE) * 0.1 END AS noise FROM c CROSS JOIN (SELECT unnest(['coarse', 'kan']) AS variant))) SELECT pair, variant, count(*) AS n, round(quantile_cont(err, 0.5), 6) AS median_err, round(quantile_cont(err, 0.9), 6) AS p90_err FROM e GROUP BY pair, variant",
)(lambda s, d: M.match_errors(matches(s, d)).select("pair", "variant", "n", F.round("median_err", 6).alias("median_err"), F.round("p90_err", 6).alias("p90_err")))
_SCORED = "sc AS (SELECT event_type AS variant, user_id % 11 <> 3 AS ok, event_id % 97 AS n_matches, value % 100 AS inlier_pct, value % 3 AS rmse_inliers, value % 5 AS rmse_gt, value % 7 AS corner_err FROM events)"
query("eval_summary", f"WITH {_SCORED} SELECT variant, count(*) AS pairs, count(*) FILTER (WHERE NOT ok) AS failed, round(avg(n_matches), 6) AS mean_matches, round(avg(inlier_pct) FILTER (WHERE ok), 6) AS mean_inlier_pct, round(median(rmse_inliers) FILTER (WHERE ok), 6) AS median_rmse_inliers_px, round(median(rmse_gt) FILTER (WHERE ok), 6) AS median_rmse_gt_px, round(median(corner_err) FILTER (WHERE ok), 6) AS median_corner_err_px, round(count(*) FILTER (WHERE ok AND corner_err < 3) / count(*), 6) AS success_rate FROM sc GROUP BY variant")(
    lambda s, d: M.summarise(table(s, d, "events").select(V("event_type").alias("variant"), (V("user_id") % 11 != 3).alias("ok"), (V("event_id") % 97).alias("n_matches"), (V("value") % 100).alias("inlier_pct"), (V("value") % 3).alias("rmse_inliers"), (V("value") % 5).alias("rmse_gt"), (V("value") % 7).alias("corner_err"))).select(
        "variant", "pairs", "failed", *[F.round(c, 6).alias(c) for c in ("mean_matches", "mean_inlier_pct", "median_rmse_inliers_px", "median_rmse_gt_px", "median_corner_err_px", "success_rate")]
    )
)
def _lossy(s: SparkSession, d: str) -> DataFrame:
    loss = F.when(V("user_id") % 13 == 0, float("nan")).when(V("user_id") % 13 == 1, float("inf")).otherwise(V("value"))
    return table(s, d, "events").withColumn("loss", loss)


query("skip_nonfinite", "SELECT event_type, count(*) FILTER (WHERE user_id % 13 > 1) AS used, count(*) FILTER (WHERE user_id % 13 <= 1) AS skipped FROM events GROUP BY 1")(lambda s, d: T.count_finite(_lossy(s, d), "loss", "event_type"))
query("nanmean", "SELECT event_type, round(avg(value) FILTER (WHERE user_id % 13 <> 0), 6) AS mean_loss FROM events GROUP BY 1")(
    lambda s, d: T.mean_finite(table(s, d, "events").withColumn("mean_loss", F.when(V("user_id") % 13 == 0, float("nan")).otherwise(V("value"))), ["mean_loss"], "event_type").withColumn("mean_loss", F.round("mean_loss", 6))
)
query("running_best", "SELECT event_id, event_type, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")(
    lambda s, d: T.running_best(table(s, d, "events"), "value", "event_id", "event_type").select("event_id", "event_type", "best")
)
query("history_unpivot", "SELECT o_orderkey AS epoch, 'train' AS split, 'loss' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'val', 'rmse', o_custkey::DOUBLE FROM orders")(
    lambda s, d: T.history_series(table(s, d, "orders").select(V("o_orderkey").alias("epoch"), V("o_totalprice").alias("train_loss"), V("o_custkey").cast("double").alias("val_rmse")), "epoch")
)
query("distinct_vals", "SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")(lambda s, d: table(s, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).distinct())
query("array_product", "SELECT p_partkey, (p_size * length(p_name) * 3)::BIGINT AS n FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", T.axes_product(F.create_map(F.lit("line"), V("p_size").cast("long"), F.lit("sample"), F.length("p_name").cast("long"), F.lit("band"), F.lit(3).cast("long"))).alias("n"))
)
query("cum_offsets", "SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)::BIGINT - p_size AS start_at FROM part")(
    lambda s, d: T.start_offsets(table(s, d, "part"), "p_size", "p_partkey", "p_brand").select("p_partkey", "start_at")
)
query("argmin_by", "SELECT event_type, arg_min(event_id, (value, event_id)) AS at_min, arg_max(event_id, (value, -event_id)) AS at_max FROM events GROUP BY 1")(
    lambda s, d: T.extremes(table(s, d, "events"), "event_id", "value", "event_type")
)
query("sample_cap", "SELECT event_id, value FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 1024")(
    lambda s, d: T.seeded_sample(table(s, d, "events").select("event_id", "value"), "event_id", 1024, 7)
)
query("repeat_expand", "SELECT vec_id, r::INT AS repeat, 4321 + vec_id + r * 500 AS seed FROM embeddings CROSS JOIN (SELECT unnest(range(0, 5)) AS r)")(
    lambda s, d: T.repeated(patches(s, d).select("vec_id"), "vec_id", 5, 500, 4321)
)
query("union_tagged", "SELECT 0 AS image, vec_id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 1, vec_id, label FROM embeddings WHERE vec_id % 2 = 1")(
    lambda s, d: T.stacked(first=patches(s, d).where("vec_id % 2 = 0").select("vec_id", "label"), second=patches(s, d).where("vec_id % 2 = 1").select("vec_id", "label"))
)
query("coalesce_pick", "SELECT doc_id, coalesce(CASE WHEN n_chars % 3 = 0 THEN lang END, CASE WHEN n_chars % 2 = 0 THEN source END, 'none') AS picked FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", T.first_value(F.when(V("n_chars") % 3 == 0, V("lang")), F.when(V("n_chars") % 2 == 0, V("source")), otherwise=F.lit("none")).alias("picked"))
)
query("classify_case", "SELECT page_id, CASE WHEN url LIKE '%1%' THEN 'A' WHEN url LIKE '%2%' THEN 'B' ELSE 'C' END AS kind FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", T.kind_by_part(V("url"), {"1": "A", "2": "B"}, "C").alias("kind"))
)
query("broadcast_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: T.looked_up(T.looked_up(table(s, d, "customer"), table(s, d, "nation"), "c_nationkey", "n_nationkey"), table(s, d, "region"), "n_regionkey", "r_regionkey").select("c_custkey", "n_name", "r_name")
)
query("left_default", "SELECT d.doc_id, coalesce(l.quality, 1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")(
    lambda s, d: T.looked_up(table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality"), "doc_id", "doc_id", {"quality": 1})
)
query("scalar_math", "SELECT event_id, round(abs(-value), 6) AS a, round(sqrt(value), 6) AS b, round(sin(value) + cos(value), 6) AS c, round(asin(value / 1000) + atan2(value, 2), 6) AS d, round(ln(1 + value), 6) AS e, round(exp(-value), 6) AS f, round(tanh(value / 100), 6) AS g, round(pow(value, 1.5), 4) AS h, ceil(value)::BIGINT AS i, floor(value)::BIGINT AS j, round_even(value, 0)::BIGINT AS k, radians(user_id) AS l FROM events")(
    lambda s, d: table(s, d, "events").select(
        "event_id", F.round(F.abs(-V("value")), 6).alias("a"), F.round(F.sqrt("value"), 6).alias("b"), F.round(F.sin("value") + F.cos("value"), 6).alias("c"), F.round(F.asin(V("value") / 1000) + F.atan2(V("value"), F.lit(2.0)), 6).alias("d"), F.round(F.log1p("value"), 6).alias("e"),
        F.round(F.exp(-V("value")), 6).alias("f"), F.round(F.tanh(V("value") / 100), 6).alias("g"), F.round(F.pow("value", F.lit(1.5)), 4).alias("h"), F.ceil("value").alias("i"), F.floor("value").alias("j"), F.rint("value").cast("long").alias("k"), F.radians("user_id").alias("l"),
    )
)
query("scalar_string", "SELECT p_partkey, lower(p_name) AS a, trim(p_type) AS b, replace(p_brand, '#', '-') AS c, starts_with(p_type, 'S') AS d, string_split(p_type, ' ')[1] AS e, regexp_extract_all(p_name, '[a-z]+')[1] AS f, lower(hex(p_brand)) AS g, p_brand || '/' || p_size AS h FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.lower("p_name").alias("a"), F.trim("p_type").alias("b"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("c"), V("p_type").startswith("S").alias("d"), F.split("p_type", " ")[0].alias("e"), F.get(F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0)), F.lit(0)).alias("f"), F.lower(F.hex("p_brand")).alias("g"), F.concat_ws("/", "p_brand", "p_size").alias("h"))
)
query("scalar_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(ts) // 1000 AS ms, hour(ts)::INT AS h, strftime(ts, '%Y-%m-%d') AS day FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_millis(V("ts").cast("timestamp")).alias("ms"), F.hour("ts").alias("h"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
)
query("array_map_ops", "SELECT p_partkey, map {'a': p_size, 'b': length(p_name)}['a']::INT AS a, coalesce(map {'a': p_size}['z'], -1) AS b, list_position([p_size, 7], 7)::BIGINT AS c, len(list_filter([p_size, NULL, 3], lambda x: x IS NOT NULL))::INT AS d FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.element_at(F.create_map(F.lit("a"), V("p_size"), F.lit("b"), F.length("p_name")), "a").alias("a"), F.coalesce(F.try_element_at(F.create_map(F.lit("a"), V("p_size")), F.lit("z")), F.lit(-1)).alias("b"), F.array_position(F.array(V("p_size"), F.lit(7)), 7).alias("c"), F.size(F.filter(F.array(V("p_size"), F.lit(None).cast("int"), F.lit(3)), lambda x: x.isNotNull())).alias("d"))
)
query("pca_denoise")(lambda s, d: M.pca_denoise(patches(s, d)).select("vec_id", F.posexplode("f").alias("i", "x")))
query("stream_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts::TIMESTAMP, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(
    lambda s, d: windows.tumbling(table(s, d, "events").withColumn("ts", V("ts").cast("timestamp")), "ts", "value", ["event_type"], "6 hours", "1 hour").withColumn("total", F.round("total", 4))
)
query("stream_session", "WITH l AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '20 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l) SELECT min(ts) AS start, max(ts) + INTERVAL '20 minutes' AS stop, event_type, count(*) AS n FROM g GROUP BY event_type, g")(
    lambda s, d: windows.sessions(table(s, d, "events").withColumn("ts", V("ts").cast("timestamp")), "ts", ["event_type"], "20 minutes", "1 hour")
)
