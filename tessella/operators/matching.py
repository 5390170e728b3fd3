"""Matching of features, spline networks and scores.

Features are rows (pair, side, i, f ARRAY<DOUBLE>); cells are numbered by rows of a grid. Weights of a network are small
tables (o, i, k, w), joined by Catalyst's own size check.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col
#: Fixed value: the similarity of cells that cannot match.
MASKED = -1e4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similarity(a: DataFrame, b: DataFrame, scale: float) -> DataFrame:
    """(pair, i, j, sim): scaled products of all features of one image with all of the other, within a pair. All pairs are what
    is asked for; a pair's grids bound them. If the features have a column valid, products with an invalid cell become MASKED
    and the result says in valid whether both cells are."""
    masked = "valid" in a.columns or "valid" in b.columns
    of = lambda df: F.coalesce("valid", F.lit(False)) if "valid" in df.columns else F.lit(True)
    left, right = a.select("pair", "i", V("f").alias("fa"), of(a).alias("va")), b.select("pair", V("i").alias("j"), V("f").alias("fb"), of(b).alias("vb"))
    sim = dot(V("fa"), V("fb")) * scale
    met = left.join(right, "pair").select("pair", "i", "j", F.when(V("va") & V("vb"), sim).otherwise(MASKED).alias("sim"), (V("va") & V("vb")).alias("valid"))
    return met if masked else met.drop("valid")


def dual_softmax(sim: DataFrame) -> DataFrame:
    """Adds logp: the sum of the log-softmax over j and over i."""

    wi, wj = Window.partitionBy("pair", "i"), Window.partitionBy("pair", "j")
    t = sim.withColumn("ti", F.max("sim").over(wi)).withColumn("tj", F.max("sim").over(wj))
    t = t.withColumn("si", F.log(F.sum(F.exp(V("sim") - V("ti"))).over(wi)) + V("ti")).withColumn("sj", F.log(F.sum(F.exp(V("sim") - V("tj"))).over(wj)) + V("tj"))
    return t.withColumn("logp", 2 * V("sim") - V("si") - V("sj")).drop("ti", "tj", "si", "sj")


def inner_cell(index: Column, width: int, height: int, border: int) -> Column:
    x, y = index % width, F.floor(index / width)
    return x.between(border, width - border - 1) & y.between(border, height - border - 1)


def mutual_nearest(scored: DataFrame, threshold: float = 0.2, border: int = 0, width: int = 1, height: int = 1) -> DataFrame:
    """(pair, i, j, conf) where each is the other's best (the first of equals), confident and away from the border; both cells
    must be valid if ``scored`` has that column."""
    best = lambda key, other: F.row_number().over(Window.partitionBy("pair", key).orderBy(F.desc("logp"), other)) == 1
    kept = scored.withColumn("bi", best("i", "j")).withColumn("bj", best("j", "i")).where("bi and bj").withColumn("conf", F.exp("logp")).where(V("conf") > threshold)
    if "valid" in scored.columns:
        kept = kept.where("valid")
    return (kept.where(inner_cell(V("i"), width, height, border)) if border else kept).select("pair", "i", "j", "conf")


def cell_centre(index: Column, width: int, stride: int = 8) -> tuple[Column, Column]:
    return (index % width + 0.5) * stride - 0.5, (F.floor(index / width) + 0.5) * stride - 0.5


def project(x: Column, y: Column, h: Column, *, guarded: bool = False) -> tuple[Column, Column]:
    """A point under a homography (array of nine); guarded: a vanishing denominator becomes 1e-6."""
    z = h[6] * x + h[7] * y + h[8]
    z = F.when(F.abs(z) < 1e-6, 1e-6).otherwise(z) if guarded else z
    return (h[0] * x + h[1] * y + h[2]) / z, (h[3] * x + h[4] * y + h[5]) / z


def target_cell(x: Column, y: Column, width: int, height: int, stride: int = 8) -> tuple[Column, Column]:
    """The cell nearest to a point (clamped), and whether the point lies inside."""
    u, v = F.rint((x + 0.5) / stride - 0.5).cast("long"), F.rint((y + 0.5) / stride - 0.5).cast("long")
    bound = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    return bound(v, height) * width + bound(u, width), u.between(0, width - 1) & v.between(0, height - 1)


def bounded(raw: Column, most: float) -> Column:
    return most * F.tanh(raw / most)


def spline_bases(x: Column, grid_size: int = 5, order: int = 3, low: float = -3.0, high: float = 3.0) -> list[Column]:
    """Values at x of the B-splines over evenly spaced knots, ``order`` beyond either end; the lowest degree is half-open."""
    h = (high - low) / grid_size
    knots = [low + h * i for i in range(-order, grid_size + order + 1)]
    bases = [F.when((x >= a) & (x < b), 1.0).otherwise(0.0) for a, b in zip(knots, knots[1:], strict=False)]
    for k in range(1, order + 1):
        bases = [(x - knots[i]) / (knots[i + k] - knots[i]) * bases[i] + (knots[i + k + 1] - x) / (knots[i + k + 1] - knots[i + 1]) * bases[i + 1] for i in range(len(bases) - 1)]
    return bases


def layer_norm(f: Column) -> Column:
    """An array less its mean, over its population deviation (1e-5 added to the variance)."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.get(F.transform(F.array(mean(f)), lambda m: F.transform(f, lambda x: (x - m) / F.sqrt(F.aggregate(f, F.lit(0.0), lambda s, y: s + (y - m) * (y - m)) / F.size(f) + 1e-5))), F.lit(0))


def kan_layer(rows: DataFrame, key: str, base: DataFrame, spline: DataFrame) -> DataFrame:
    """(key, f) -> (key, f): W_b SiLU(x) + W_s B(x), weights as tables base(o, i, w) and spline(o, i, k, w)."""
    long = rows.select(key, F.posexplode("f").alias("i", "x"))
    silu = V("x") / (1 + F.exp(-V("x")))
    terms = long.select(key, "i", F.posexplode(F.array(silu, *spline_bases(V("x")))).alias("k", "t")).where("t <> 0")
    weights = base.select("o", "i", F.lit(0).alias("k"), "w").unionByName(spline.select("o", "i", (V("k") + 1).alias("k"), "w"))
    summed = terms.join(weights, ["i", "k"]).groupBy(key, "o").agg(F.sum(V("t") * V("w")).alias("v"))
    return summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("f")).select(key, F.transform("f", lambda p: p["v"]).alias("f"))


def kan_network(rows: DataFrame, key: str, layers: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(key, f) -> (key, f) through layers of (base, spline) weights, each after a layer norm."""
    for base, spline in layers:
        rows = kan_layer(rows.select(key, layer_norm(V("f")).alias("f")), key, base, spline)
    return rows


def fit_spline(x: np.ndarray, y: np.ndarray, grid_size: int = 5, order: int = 3, low: float = -3.0, high: float = 3.0) -> np.ndarray:
    """Least-squares coefficients (inputs, bases, outputs) of splines through samples x (n, inputs) -> y (n, inputs, outputs); for
    starting values, on the driver."""
    h = (high - low) / grid_size
    knots = low + h * np.arange(-order, grid_size + order + 1)
    bases = ((x[..., None] >= knots[:-1]) & (x[..., None] < knots[1:])).astype(float)
    for k in range(1, order + 1):
        rise = (x[..., None] - knots[: -k - 1]) / (knots[k:-1] - knots[: -k - 1])
        fall = (knots[k + 1 :] - x[..., None]) / (knots[k + 1 :] - knots[1:-k])
        bases = rise * bases[..., :-1] + fall * bases[..., 1:]
    return np.stack([np.linalg.lstsq(bases[:, i], y[:, i], rcond=None)[0] for i in range(x.shape[1])])


def encode_features(patches: DataFrame, make_encoder, schema: str = "pair long, i long, f array<double>") -> DataFrame:
    """Features of patches by a network that the caller brings: ``make_encoder()`` is called once a task and gives a function
    from a pandas frame of patches to one of the schema."""

    def run(batches):
        encode = make_encoder()
        for batch in batches:
            yield encode(batch)

    return patches.mapInPandas(run, schema)


def refine(found: DataFrame, a: DataFrame, b: DataFrame, layers: list[tuple[DataFrame, DataFrame]], width: int, most: float = 4.0, stride: int = 8) -> DataFrame:
    """``found`` (pair, i, j, ...) with the cells' centres (x0, y0), (x1c, y1c) and the refined place (x1, y1): both features,
    joined end to end, go through the network, whose bounded output is added to the second centre."""
    of = lambda df, side, index: df.select("pair", V("i").alias(index), V("f").alias(side))
    both = found.join(of(a, "fa", "i"), ["pair", "i"]).join(of(b, "fb", "j"), ["pair", "j"])
    moved = kan_network(both.select(F.struct("pair", "i", "j").alias("cell"), F.concat("fa", "fb").alias("f")), "cell", layers)
    offsets = moved.select("cell.*", bounded(V("f")[0], most).alias("dx"), bounded(V("f")[1], most).alias("dy"))
    (x0, y0), (x1, y1) = cell_centre(V("i"), width, stride), cell_centre(V("j"), width, stride)
    placed = found.join(offsets, ["pair", "i", "j"])
    return placed.select(*found.columns, x0.alias("x0"), y0.alias("y0"), x1.alias("x1c"), y1.alias("y1c"), (x1 + V("dx")).alias("x1"), (y1 + V("dy")).alias("y1"))


def match_forward(
    a: DataFrame, b: DataFrame, layers: list[tuple[DataFrame, DataFrame]], width: int, height: int, temperature: float = 0.1, threshold: float = 0.2, border: int = 2, most: float = 4.0, stride: int = 8
) -> DataFrame:
    """(pair, i, j, conf, x0, y0, x1c, y1c, x1, y1) from feature tables (pair, i, f [, valid]) of two images: similarities, their
    dual softmax, mutual nearest cells and refined places, as one plan. All features have as many values as the first."""
    dim = F.size("f")
    scaled = lambda df: df.withColumn("f", F.transform("f", lambda x: x / F.sqrt(dim)))
    found = mutual_nearest(dual_softmax(similarity(scaled(a), scaled(b), 1.0 / temperature)), threshold, border, width, height)
    return refine(found, a, b, layers, width, most, stride)


def true_cells(pairs: DataFrame, cells: int, width: int, height: int, stride: int = 8) -> DataFrame:
    """(pair, i, j, ok, tx, ty): where a homography (pair, h) takes each cell's centre, the cell nearest to that place, and whether
    it lies inside."""
    grid = pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    x, y = cell_centre(V("i"), width, stride)
    tx, ty = project(x, y, V("h"), guarded=True)
    placed = grid.select("pair", "i", tx.alias("tx"), ty.alias("ty"))
    j, ok = target_cell(V("tx"), V("ty"), width, height, stride)
    return placed.select("pair", "i", j.alias("j"), ok.alias("ok"), "tx", "ty")


def matching_loss(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(pair, cells, matching_loss): the mean of -logp at the true cells (pair, i, j, ok)."""
    met = scored.join(truth.where("ok").select("pair", "i", "j"), ["pair", "i", "j"])
    return met.groupBy("pair").agg(F.count(F.lit(1)).alias("cells"), F.avg(-V("logp")).alias("matching_loss"))


def top1_accuracy(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(pair, acc): the share of cells (pair, i, j, ok) whose best j (the first of equals) is the true one."""
    best = scored.groupBy("pair", "i").agg(F.max_by("j", F.struct("logp", -V("j"))).alias("best"))
    return truth.where("ok").join(best, ["pair", "i"]).groupBy("pair").agg(F.avg((V("best") == V("j")).cast("int")).alias("acc"))


def offset_loss(refined: DataFrame, truth: DataFrame, most_pairs: int | None = None, seed: int = 0) -> DataFrame:
    """One row: pairs, mse (over both coordinates), rmse_px of the refined places and no_offset_rmse_px of the bare cell centres against the
    true places (pair, i, tx, ty). ``most_pairs``: a seeded sample of so many."""
    met = refined.join(truth.select("pair", "i", "tx", "ty"), ["pair", "i"])
    if most_pairs:
        met = met.orderBy(F.xxhash64(F.lit(seed), "pair", "i"), "pair", "i").limit(most_pairs)
    far = lambda x, y: F.pow(V(x) - V("tx"), F.lit(2)) + F.pow(V(y) - V("ty"), F.lit(2))
    return met.agg(F.count(F.lit(1)).alias("pairs"), (F.avg(far("x1", "y1")) / 2).alias("mse"), F.sqrt(F.avg(far("x1", "y1"))).alias("rmse_px"), F.sqrt(F.avg(far("x1c", "y1c"))).alias("no_offset_rmse_px"))


def match_errors(matches: DataFrame) -> DataFrame:
    """(pair, variant, n, median_err, p90_err): distances between matches (x1, y1) and the true places of (x0, y0) under h_gt."""
    tx, ty = project(V("x0"), V("y0"), V("h_gt"))
    err = matches.withColumn("err", F.sqrt(F.pow(V("x1") - tx, F.lit(2)) + F.pow(V("y1") - ty, F.lit(2))))
    return err.groupBy("pair", "variant").agg(F.count(F.lit(1)).alias("n"), F.percentile("err", 0.5).alias("median_err"), F.percentile("err", 0.9).alias("p90_err"))


def solve_homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Least-squares homography of matched points, on centred and scaled coordinates."""

    def scaling(p: np.ndarray) -> np.ndarray:
        c = p.mean(0)
        s = math.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
        return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])

    a, b = scaling(src), scaling(dst)
    p, q = (np.c_[x, np.ones(len(x))] @ t.T for x, t in ((src, a), (dst, b)))
    zero = np.zeros_like(p)
    system = np.r_[np.c_[p, zero, -q[:, :1] * p], np.c_[zero, p, -q[:, 1:2] * p]]
    h = np.linalg.inv(b) @ np.linalg.svd(system)[2][-1].reshape(3, 3) @ a
    return h / h[2, 2]


def apply_homography(points: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = np.c_[points, np.ones(len(points))] @ h.T
    return p[:, :2] / p[:, 2:]


def random_homography(patch: int, most: float, rng: np.random.Generator) -> np.ndarray:
    """The homography that moves each corner by a uniform shift of at most ``most`` pixels."""
    if most >= patch / 4:
        raise ValueError("corners may move by less than a quarter of the patch")
    corners = np.array([[0, 0], [patch - 1, 0], [patch - 1, patch - 1], [0, patch - 1]], float)
    return solve_homography(corners, corners + rng.uniform(-most, most, (4, 2)))


def warp(image: np.ndarray, h: np.ndarray, *, nearest: bool = False) -> np.ndarray:
    """The image seen through h: a pixel takes the value of its place before the warp, 0 outside."""
    n, m = image.shape
    ys, xs = np.mgrid[:n, :m]
    at = apply_homography(np.c_[xs.ravel(), ys.ravel()].astype(float), np.linalg.inv(h))
    if nearest:
        x, y = np.rint(at[:, 0]).astype(int), np.rint(at[:, 1]).astype(int)
        ok = (x >= 0) & (x < m) & (y >= 0) & (y < n)
        return np.where(ok, image[np.clip(y, 0, n - 1), np.clip(x, 0, m - 1)], 0).reshape(n, m)
    x0, y0 = np.floor(at[:, 0]).astype(int), np.floor(at[:, 1]).astype(int)
    fx, fy = at[:, 0] - x0, at[:, 1] - y0
    out = np.zeros(n * m)
    for dy in (0, 1):
        for dx in (0, 1):
            x, y = x0 + dx, y0 + dy
            ok = (x >= 0) & (x < m) & (y >= 0) & (y < n)
            out += np.where(ok, image[np.clip(y, 0, n - 1), np.clip(x, 0, m - 1)], 0) * (fx if dx else 1 - fx) * (fy if dy else 1 - fy)
    return out.reshape(n, m)


def robust_homography(p: np.ndarray, q: np.ndarray, limit: float = 1.5, rounds: int = 10_000, confidence: float = 0.999, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """Seeded sampling of four matches, the largest consensus, refitted until it is stable: (h, inliers). Sampling ends when a
    better consensus has been ruled out with the confidence, or after so many rounds. Every group of matches has the same seed."""
    if len(p) < 4:
        return None
    rng, best = np.random.default_rng(seed), None
    for done in range(rounds):
        if best is not None and done >= math.log(1 - confidence) / math.log(1 - min(max((best.sum() / len(p)) ** 4, 1e-12), 1 - 1e-12)):
            break
        pick = rng.choice(len(p), 4, replace=False)
        with np.errstate(all="ignore"):
            h = solve_homography(p[pick], q[pick])
            near = np.linalg.norm(apply_homography(p, h) - q, axis=1) < limit
        if best is None or near.sum() > best.sum():
            best = near
    for _ in range(5):
        if best.sum() < 4:
            return None
        h = solve_homography(p[best], q[best])
        again = np.linalg.norm(apply_homography(p, h) - q, axis=1) < limit
        if (again == best).all():
            break
        best = again
    return h, best


def score_matches(matches: DataFrame, patch: int) -> DataFrame:
    """(pair, variant, x0, y0, x1, y1, h_gt) -> per pair and variant: n_matches, ok, inlier_pct, rmse_inliers, rmse_gt, corner_err.
    A group is one pair's matches, at most one per grid cell."""

    def score(m: pd.DataFrame) -> pd.DataFrame:
        p, q, truth = m[["x0", "y0"]].to_numpy(float), m[["x1", "y1"]].to_numpy(float), np.array(m.h_gt.iloc[0], float).reshape(3, 3)
        row = {"pair": m.pair.iloc[0], "variant": m.variant.iloc[0], "n_matches": len(m), "ok": False, "inlier_pct": None, "rmse_inliers": None, "rmse_gt": None, "corner_err": None}
        found = robust_homography(p, q)
        if found:
            h, near = found
            corners = np.array([[0, 0], [patch - 1, 0], [patch - 1, patch - 1], [0, patch - 1]], float)
            rmse = lambda a, b: float(np.sqrt(((a - b) ** 2).sum(1).mean()))
            row |= {"ok": True, "inlier_pct": 100.0 * near.mean(), "rmse_inliers": rmse(q[near], apply_homography(p[near], h)), "rmse_gt": rmse(q, apply_homography(p, truth)), "corner_err": float(np.linalg.norm(apply_homography(corners, h) - apply_homography(corners, truth), axis=1).mean())}
        return pd.DataFrame([row])

    return matches.groupBy("pair", "variant").applyInPandas(score, "pair long, variant string, n_matches long, ok boolean, inlier_pct double, rmse_inliers double, rmse_gt double, corner_err double")


def summarise(scores: DataFrame, limit: float = 3.0) -> DataFrame:
    """Per variant: pairs, failed, mean matches over all, the rest over pairs that succeeded (null if none did)."""
    good = lambda c: F.when(V("ok"), V(c))
    median = lambda c: F.percentile(good(c), 0.5)
    any_ok = F.count_if("ok") > 0
    return scores.groupBy("variant").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(~V("ok")).alias("failed"), F.when(any_ok, F.avg("n_matches")).alias("mean_matches"), F.avg(good("inlier_pct")).alias("mean_inlier_pct"),
        median("rmse_inliers").alias("median_rmse_inliers_px"), median("rmse_gt").alias("median_rmse_gt_px"), median("corner_err").alias("median_corner_err_px"),
        F.when(any_ok, F.count_if(V("ok") & (V("corner_err") < limit)) / F.count(F.lit(1))).alias("success_rate"),
    )


def pca_denoise(patches: DataFrame, keep: float = 0.95) -> DataFrame:
    """(vec_id, f) -> (vec_id, f): f on the principal components that explain the share ``keep``. Means and products are one
    aggregate of d(d+1)/2 rows; the driver decomposes a d x d matrix only."""
    long = patches.select("vec_id", F.posexplode("f").alias("i", "x"))
    pairs = long.join(long.select("vec_id", V("i").alias("j"), V("x").alias("y")), "vec_id").where("i <= j").groupBy("i", "j").agg(F.covar_pop("x", "y").alias("c"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    rows = pairs.collect()
    d = max(r.j for r in rows) + 1
    cov, mean = np.zeros((d, d)), np.zeros(d)
    for r in rows:
        cov[r.i, r.j] = cov[r.j, r.i] = r.c
        mean[r.i] = r.mx
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    share = np.cumsum(values[order]) / max(values.sum(), 1e-300)
    kept = vectors[:, order[: int(np.searchsorted(share, keep) + 1)]]
    onto = kept @ kept.T

    @F.pandas_udf("array<double>")
    def denoise(f: pd.Series) -> pd.Series:
        x = np.stack(f.to_numpy()) - mean
        return pd.Series(list(x @ onto + mean))

    return patches.withColumn("f", denoise("f"))
