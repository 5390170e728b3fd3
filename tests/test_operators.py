"""Operators against array arithmetic on small rasters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import matching, radiometry, resample, series, shift, stencil


def frame(spark, a, product="p"):
    return spark.createDataFrame([(product, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(a)], "product string, y long, x long, v double")


def array(df, value="v"):
    rows = df.select("y", "x", F.col(value).cast("double").alias("v")).collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(4).integers(0, 256, (9, 7)).astype(float)


def test_stretch(spark, image):
    lo, hi = np.percentile(image, (1, 99))
    assert (array(radiometry.normalize_u8(frame(spark, image))) == np.trunc((np.clip(image, lo, hi) - lo) / (hi - lo) * 255)).all()
    flat = array(radiometry.normalize_u8(frame(spark, np.full((3, 3), 5.0))))
    assert (flat == 0).all()


def test_gradient_and_box(spark, image):
    gy, gx = np.gradient(image)
    g = stencil.gradient(frame(spark, image))
    assert np.allclose(array(g, "gx"), gx) and np.allclose(array(g, "gy"), gy)
    padded = np.pad(image, 2, mode="reflect")
    mean = sum(padded[dy : dy + 9, dx : dx + 7] for dy in range(5) for dx in range(5)) / 25
    assert np.allclose(array(stencil.box_mean(frame(spark, image), floor=False)), mean)


def test_median_and_dilation(spark, image):
    padded = np.pad(image, 2, mode="edge")
    stack = np.stack([padded[dy : dy + 9, dx : dx + 7] for dy in range(5) for dx in range(5)])
    assert np.allclose(array(stencil.median_blur(frame(spark, image))), np.median(stack, 0))
    p = np.pad(image, 1, mode="edge")
    cross = np.max([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]], 0)
    assert (array(stencil.dilate_cross(frame(spark, image))) == cross).all()


def test_known_shift_is_found_by_both_forms(spark):
    a = np.random.default_rng(1).uniform(1, 255, (40, 30))
    b = np.roll(a, (2, -1), (0, 1))
    one = shift.best(shift.correlate(frame(spark, a), frame(spark, b), 4, 100)).collect()
    two = shift.best(shift.correlate_bands(frame(spark, a), frame(spark, b), 4, 100, 7)).collect()
    assert (one[0].dx, one[0].dy, one[0].score) == (1, -2, 1.0)
    assert [(r.dx, r.dy, r.n) for r in one] == [(r.dx, r.dy, r.n) for r in two]


def test_constant_rasters_have_no_score(spark):
    flat = frame(spark, np.ones((12, 12)))
    assert shift.correlate(flat, flat, 1, 1).count() == 0


def test_bins(spark, image):
    wide = np.random.default_rng(2).integers(0, 255, (4, 58)).astype(float)
    edges = np.linspace(0, 58, 8).astype(int)
    want = np.array([[wide[y, a:b].mean() for a, b in zip(edges, edges[1:], strict=False)] for y in range(4)])
    assert (array(resample.bin_means(frame(spark, wide), 7, half_even=False)) == np.trunc(want)).all()
    whole = array(resample.area_resize(frame(spark, np.kron(image, np.ones((2, 3)))), 9, 7))
    assert np.allclose(whole, image)


def test_bin_means_of_short_decimals(spark):
    # In every order of its terms the sum falls below 244 (mean 61).
    assert array(resample.bin_means(frame(spark, np.array([[60.48, 86.1, 97.35, 0.07]])), 1, half_even=False)) == [[61]]


def test_bin_means_on_a_half(spark):
    # The mean is 59.5; in every order of its terms the sum falls below 238, which gave 59.
    assert array(resample.bin_means(frame(spark, np.array([[72.6, 97.85, 67.1, 0.45]])), 1, half_even=True)) == [[60]]


def test_patches_round_trip(spark, image):
    even = image[:8, :6]
    assert (array(resample.unpatchify(resample.patchify(frame(spark, even), 2), 2)) == even).all()


def test_cubic_keeps_constants_and_size(spark):
    out = array(resample.resample(frame(spark, np.full((10, 6), 7.0)), 2.0, 4.0))
    assert out.shape == (5, 3) and np.allclose(out, 7)
    with pytest.raises(ValueError, match="positive"):
        resample.resample(frame(spark, np.ones((2, 2))), 0, 1)


def test_histogram_match_of_a_raster_to_itself(spark, image):
    both = frame(spark, image, "a").unionByName(frame(spark, image, "b"))
    assert (array(radiometry.histogram_match(both, "a", "b")) == image).all()


def test_equalisation_stays_in_range(spark):
    ramp = np.add.outer(np.arange(16), np.arange(16)).astype(float) * 8
    out = array(stencil.equalize_adaptive(frame(spark, ramp), tiles=2))
    assert out.min() >= 0 and out.max() <= 255 and (np.diff(out[0]) >= 0).all()


def test_nearest_takes_the_first_of_equals(spark):
    records = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 3.0), (3, 900.0)], "i int, v double")
    targets = spark.createDataFrame([(2.0,), (3.1,), (5000.0,), (-700.0,)], "t double")
    got = {r.t: r.i for r in series.nearest(targets, records, "t", "v", "i").collect()}
    assert got == {2.0: 0, 3.1: 1, 5000.0: 3, -700.0: 0}


def test_homographies():
    rng = np.random.default_rng(3)
    h = matching.random_homography(64, 10, rng)
    p = rng.uniform(0, 63, (60, 2))
    q = matching.apply_homography(p, h)
    q[:12] += rng.uniform(20, 40, (12, 2))
    found, near = matching.robust_homography(p, q)
    assert near.sum() == 48 and np.allclose(found, h, atol=1e-6)
    assert matching.robust_homography(p[:3], q[:3]) is None
    smooth = np.add.outer(np.arange(64.0), 2 * np.arange(64.0))
    back = matching.warp(matching.warp(smooth, h), np.linalg.inv(h))
    assert np.allclose(back[16:48, 16:48], smooth[16:48, 16:48], atol=0.01)
    with pytest.raises(ValueError, match="quarter"):
        matching.random_homography(64, 16, rng)


def test_splines_sum_to_one(spark):
    x = spark.createDataFrame([(i / 7 - 2.9,) for i in range(40)], "x double")
    total = sum(matching.spline_bases(F.col("x")), F.lit(0.0))
    assert all(abs(r.t - 1) < 1e-9 for r in x.select(total.alias("t")).collect())


def test_scores_of_true_matches(spark):
    from tessella.plans.matching_queries import matches

    for r in matching.score_matches(matches(spark, ""), 128).collect():
        assert r.ok and r.n_matches == 90 and 80 < r.inlier_pct < 95 and r.corner_err < 1


def test_pca_keeps_what_is_on_a_plane(spark):
    rng = np.random.default_rng(5)
    plane = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(plane)], "vec_id long, f array<double>")
    got = np.array([r.f for r in matching.pca_denoise(df, 0.9999).orderBy("vec_id").collect()])
    assert np.allclose(got, plane, atol=1e-2)


def test_no_records_are_counted_as_none(spark):
    empty = spark.createDataFrame([], "ts timestamp, a double, b double")
    assert {(r.field, r.records, r.v_min) for r in series.series_stats(empty, ["a", "b"], [], "ts").collect()} == {("a", 0, None), ("b", 0, None)}
