"""Composed plans and refusals, against array arithmetic."""

import duckdb
import numpy as np
import pytest
from compare import SF_DIR
from pyspark.sql import functions as F
from test_files import array, frame

from tessella import plans
from tessella.operators import geometry, matching, radiometry, resample, shift, stencil, tables
from tessella.plans import matching_queries, recipes
from tessella.registry import RUNS, SQL
from tessella.sources import catalogue, raster_files

plans.load()


def network_of(layers):
    return [({(r.o, r.i): r.w for r in b.collect()}, {(r.o, r.i, r.k): r.w for r in s.collect()}) for b, s in layers]


def apply_network(layers, x):
    knots = [-3 + 1.2 * i for i in range(-3, 9)]
    for base, spline in layers:
        x = (x - x.mean()) / np.sqrt(x.var() + 1e-5)
        outputs = 1 + max(o for o, _ in base)
        out = np.zeros(outputs)
        for i, v in enumerate(x):
            b = [float(p <= v < q) for p, q in zip(knots, knots[1:], strict=False)]
            for k in (1, 2, 3):
                b = [(v - knots[m]) / (1.2 * k) * b[m] + (knots[m + k + 1] - v) / (1.2 * k) * b[m + 1] for m in range(len(b) - 1)]
            for o in range(outputs):
                out[o] += base[o, i] * v / (1 + np.exp(-v)) + sum(spline[o, i, k] * t for k, t in enumerate(b))
        x = out
    return x


def test_match_forward_is_the_composition(spark):
    got = {(r.pair, r.i, r.j): r for r in RUNS["match_forward"](spark, SF_DIR).collect()}
    rows = matching_queries.patches(spark, SF_DIR).select("vec_id", "f").collect()
    layers = network_of(matching_queries.network(spark))
    seen = 0
    for pair in sorted({r.vec_id // 50 for r in rows}):
        a, b = (np.array([r.f for r in sorted(rows) if r.vec_id // 50 == pair and r.vec_id % 2 == s]) for s in (0, 1))
        sim = (a / 8) @ (b / 8).T / 0.001
        va, vb = np.arange(25) % 7 != 0, np.arange(25) % 5 != 0
        sim = np.where(va[:, None] & vb[None], sim, -1e4)
        soft = lambda x, axis: x - x.max(axis, keepdims=True) - np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis, keepdims=True))
        conf = np.exp(soft(sim, 1) + soft(sim, 0))
        for i in range(25):
            j = int(conf[i].argmax())
            if conf[:, j].argmax() != i or conf[i, j] <= 0.01 or not (va[i] and vb[j]):
                assert not any(k[:2] == (pair, i) for k in got)
                continue
            seen += 1
            r = got[pair, i, j]
            centre = lambda c: np.array([(c % 5 + 0.5) * 8 - 0.5, (c // 5 + 0.5) * 8 - 0.5])
            assert abs(r.conf - conf[i, j]) < 1e-5 and (r.x0, r.y0) == tuple(centre(i)) and (r.x1c, r.y1c) == tuple(centre(j))
            moved = centre(j) + 4 * np.tanh(apply_network(layers, np.concatenate([a[i], b[j]])) / 4)
            assert np.allclose((r.x1, r.y1), moved, atol=1e-4)
    assert seen == len(got) > 0


def test_splines_are_fitted():
    x = np.random.default_rng(1).uniform(-2.9, 2.9, (200, 3))
    y = np.stack([np.sin(x), x**2], 2)
    coefficients = matching.fit_spline(x, y)
    assert coefficients.shape == (3, 8, 2)
    again = matching.fit_spline(x, np.einsum("nio,->nio", y, 1.0))
    assert np.allclose(coefficients, again)


def test_features_come_from_the_callers_network(spark):
    patches = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0])], "pair long, i long, image array<double>")

    def make():
        return lambda batch: batch.assign(f=[[sum(x)] for x in batch.image])[["pair", "i", "f"]]

    assert {r.i: r.f for r in matching.encode_features(patches, make).collect()} == {0: [3.0], 1: [7.0]}


def test_null_products_keep_their_pixels(spark):
    image = np.random.default_rng(2).integers(1, 255, (12, 10)).astype(float)
    for product in (None, "a"):
        df = frame(spark, image, product)
        for made in (radiometry.normalize_u8(df), radiometry.normalize_masked(df), radiometry.minmax_stretch(df), stencil.gradient_magnitude(df), stencil.equalize_adaptive(df, tiles=2), resample.pad_to_multiple(df, 2), resample.area_resize(df, 12, 10), resample.bin_means(df, 10, half_even=True), stencil.median_blur(df, 3), resample.resample(df, 1, 1)):
            assert made.count() == 120
        assert np.allclose(array(resample.resample(df, 1, 1)), image)


@pytest.mark.parametrize("n", [1, 2, 7, 30, 5000])
def test_percentiles_of_many_values(spark, n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), rng.integers(0, 3, n).astype(float)):
        df = spark.createDataFrame([(None if i % 2 else "a", float(v)) for i, v in enumerate(values)], "product string, v double")
        got = {r["product"]: (r.lo_, r.hi_) for r in radiometry.percentiles(df, 2, 99, ["product"], discrete=False).collect()}
        for i, product in enumerate(("a", None)):
            if len(values[i::2]):
                assert np.allclose(got[product], np.percentile(values[i::2], (2, 99)))
    none = spark.createDataFrame([("a", 1.0)], "product string, v double")
    assert radiometry.percentiles(none, 2, 98, ["product"], F.col("v") > 5, discrete=False).first().hi_ is None


def test_medians_and_bilateral_means(spark):
    image = np.random.default_rng(3).integers(0, 255, (9, 7)).astype(float)
    wide = np.pad(image, 2, mode="edge")
    around = np.stack([wide[dy : dy + 9, dx : dx + 7] for dy in range(5) for dx in range(5)])
    assert (array(stencil.median_blur(frame(spark, image))) == np.median(around, 0)).all()
    disc = np.array([dy * dy + dx * dx for dy in range(-2, 3) for dx in range(-2, 3)])[:, None, None]
    w = np.where(disc <= 4, np.exp(-disc / 5000 - (around - image) ** 2 / 5000), 0)
    assert np.allclose(array(stencil.bilateral(frame(spark, image))), (w * around).sum(0) / w.sum(0))


@pytest.mark.parametrize(("source", "target"), [(2.0, 3.0), (3.0, 1.0), (1.0, 1.7)])
def test_cubic_resampling(spark, source, target):
    image = np.random.default_rng(4).normal(size=(11, 14))

    def line(v):
        out = max(1, round(len(v) * source / target))
        at = (np.arange(out) + 0.5) * len(v) / out - 0.5
        base = np.floor(at).astype(int)
        total = np.zeros(out)
        for k in range(-1, 3):
            d = np.abs(at - base - k)
            w = np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, ((-0.75 * d + 3.75) * d - 6) * d + 3)
            total += w * v[np.clip(base + k, 0, len(v) - 1)]
        return total

    want = np.apply_along_axis(line, 0, np.apply_along_axis(line, 1, image))
    assert np.allclose(array(resample.resample(frame(spark, image), source, target)), want)


def test_both_forms_of_the_shift_search_agree(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 60000, (30, 20)).astype(float)
    b = np.roll(a, (2, -1), (0, 1))
    one, two = frame(spark, a), frame(spark, b)
    scores = lambda df: {(r.dx, r.dy): (r.n, round(r.score, 9)) for r in df.collect()}
    joined = scores(shift.correlate(one, two, 3, 50))
    assert joined == scores(shift.correlate_bands(one, two, 3, 50, 7)) and max(joined, key=lambda k: joined[k][1]) == (1, -2)
    turned = [stencil.orientation(x) for x in (one, two)]
    by_join = scores(shift.orientation_scores(*[t.drop("product") for t in turned], 3, 50))
    assert by_join == scores(shift.orientation_bands(*turned, 3, 50, 7))


def test_refusals(spark):
    with pytest.raises(Exception, match="no valid pixel"):
        radiometry.normalize_masked(frame(spark, np.zeros((3, 3)))).collect()
    one_row = frame(spark, np.ones((1, 9)))
    assert resample.trim_ramp(one_row, 5, 8).count() == 5
    with pytest.raises(Exception, match="shapes differ"):
        tables.pair_check(frame(spark, np.ones((2, 2))), frame(spark, np.ones((2, 3))), strict=True).collect()
    with pytest.raises(Exception, match="no common"):
        tables.pair_check(frame(spark, np.eye(2)), frame(spark, 1 - np.eye(2)), strict=True).collect()
    files = spark.createDataFrame([("x", 628 * 3)], "path string, length long")
    assert tables.whole_records(files, 628).first().records == 3
    with pytest.raises(Exception, match="whole number"):
        tables.whole_records(files, 600).collect()
    ring = "array<struct<lon:double,lat:double>>"
    with pytest.raises(Exception, match="not valid"):
        tables.sound_rings(spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)])], f"key string, ring {ring}")).collect()
    star = [(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)]
    with pytest.raises(Exception, match="not convex"):
        geometry.overlaps(spark.createDataFrame([("a", star), ("b", star)], f"key string, ring {ring}"), "key").collect()
    with pytest.raises(KeyError, match="images"):
        tables.first_column(["a"], ["b", "c"], "images")
    with pytest.raises(Exception, match="none of the options"):
        spark.range(1).select(tables.first_value(F.when(F.col("id") > 5, F.lit("x")))).collect()


def test_disjoint_footprints_are_listed(spark):
    square = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    rings = spark.createDataFrame([("a", square(0.0, 0.0)), ("b", square(0.5, 0.5)), ("c", square(0.0, 40.0))], "key string, ring array<struct<lon:double,lat:double>>")
    got = {(r.key_a, r.key_b): r for r in geometry.overlaps(rings, "key").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "c"].shared_km2 == 0 and got["a", "c"].lon_min is None
    assert 24 < got["a", "b"].percent_a < 26 and geometry.overlaps(rings, "key", disjoint=False).count() == 1


def test_bands_are_picked(spark):
    cube = tables.stack_bands(*[frame(spark, np.arange(12.0).reshape(3, 4) * k) for k in (1, 5, 3)])
    assert (array(recipes.pick_contrast(cube)) == np.arange(12.0).reshape(3, 4) * 5).all()
    assert (array(recipes.pick_nadir(cube)) == np.arange(12.0).reshape(3, 4) * 5).all()
    assert (array(recipes.pick_nadir(cube, ["aft", "fore", "Nadir"])) == np.arange(12.0).reshape(3, 4) * 3).all()
    waves = spark.createDataFrame([("a", 0, 1.1), ("a", 1, 1.9), ("a", 2, 1.45)], "product string, band int, wavelength_um double")
    assert (array(recipes.pick_wavelength(cube, waves)) == np.arange(12.0).reshape(3, 4) * 3).all()
    with pytest.raises(Exception, match="one to one"):
        recipes.pick_wavelength(cube, waves.where("band < 2")).collect()
    steps = recipes.run_recipe(cube, "OHRC_NAC", source_res=1.0, target_res=2.0).first().steps_applied
    assert steps == ["reference_band", "resample", "normalize_u8", "clahe", "invert", "dilate"]
    nm = spark.createDataFrame([(1500.0,), (1.5,)], "w double").select(raster_files.in_micrometres(F.col("w")).alias("w"))
    assert [r.w for r in nm.collect()] == [1.5, 1.5]


def test_a_failing_product_does_not_stop_the_others(spark):
    saved = {}

    def load(name, sensor):
        if name == "broken":
            raise ValueError("file is damaged")
        return frame(spark, np.random.default_rng(6).integers(1, 200, (16, 16)).astype(float), name)

    report = recipes.process_dataset([("one", "TMC"), ("broken", "OHRC"), ("odd", "XYZ"), ("two", "IIRS")], load, lambda name, df: saved.update({name: df.count()}))
    assert [(r["product"], r["ok"]) for r in report] == [("one", True), ("broken", False), ("odd", False), ("two", True)]
    assert report[1]["error"] == "file is damaged" and saved == {"one": 256, "two": 256} and report[0]["steps"] == ["normalize_u8", "clahe"]


def test_the_corridor_finds_its_shift(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(1, 4000, (40, 30)).astype(float)
    for _ in range(2):
        a = (a + np.roll(a, 1, 0) + np.roll(a, 1, 1)) / 3
    found = recipes.register_corridor(frame(spark, a), frame(spark, np.roll(a, (2, -1), (0, 1)), "b"), (2, 36, 2, 26), 26, 3, 100)
    for name in ("shifts", "orientation_shifts"):
        best = found[name].first()
        assert (best.dx, best.dy) == (1, -2)
    check = found["check"].first()
    assert check.common == check.pixels == 36 * 26
    assert found["pair"].count() == 40 * 32


def test_reprojection_of_a_plane(spark):
    ys, xs = np.mgrid[:40, :50]
    plane = frame(spark, 3.0 * xs + 2.0 * ys)
    metre = geometry.MOON_RADIUS * np.pi / 180
    target = (23.0 * metre + 500, 800.0, 0.0, 6.0 * metre - 500, 0.0, -900.0)
    inverse = lambda x, y: geometry.from_equirectangular(x, y)
    got = geometry.reproject(plane, (23.0, 0.02, 0.0, 6.0, 0.0, -0.02), target, 20, 25, inverse).collect()
    assert len(got) > 300
    for r in got:
        lon, lat = (target[0] + (r.x + 0.5) * 800) / metre, (target[3] - (r.y + 0.5) * 900) / metre
        assert abs(r.v - (3 * ((lon - 23) / 0.02 - 0.5) + 2 * ((6 - lat) / 0.02 - 0.5))) < 1e-6


def test_label_leaves_and_audit(spark):
    xml = """<p:Product xmlns:p="x" xmlns:isda="y"><p:File><p:file_name>a.img</p:file_name><p:file_size unit="byte">2400</p:file_size><p:md5_checksum>ABCDEF</p:md5_checksum></p:File>
    <p:Array_2D_Image><p:Axis_Array><p:axis_name>Line</p:axis_name><p:elements>40</p:elements></p:Axis_Array><p:Axis_Array><p:axis_name>Sample</p:axis_name><p:elements>30</p:elements></p:Axis_Array>
    <p:Element_Array><p:data_type>UnsignedLSB2</p:data_type></p:Element_Array></p:Array_2D_Image><isda:sun unit='deg' isda:kind="x:y">12.5</isda:sun></p:Product>"""
    texts = spark.createDataFrame([("f", xml)], "path string, value string")
    audit = catalogue.label_audit(texts).first()
    assert audit.axes == {"line": 40, "sample": 30} and (audit.file_size, audit.expected_bytes, audit.bands, audit.md5) == (2400, 2400, 1, "abcdef")
    leaves = {r.tag: (r.value, r.attributes) for r in catalogue.label_leaves(texts).collect()}
    assert leaves["sun"] == ("12.5", {"unit": "deg", "kind": "x:y"}) and leaves["file_size"] == ("2400", {"unit": "byte"})


def test_gaps_start_at_clicks_without_a_value(spark, tmp_path):
    clicks = [(0, 9, 0.0), (0, 11, 2.0), (1, 5, 1.0), (1, 6, 0.0), (2, 3, -4.0), (3, 8, 0.00001), (3, 9, 7.0)]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01 00:30:00' + to_hours({x}), {y}, 'click', {v}::DOUBLE)" for i, (y, x, v) in enumerate(clicks))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    columns = "y, gap, gap_min, gap_median, gap_max"
    want = con.sql(f"SELECT {columns} FROM ({SQL['gap_stats']}) ORDER BY y").fetchall()
    assert [tuple(r) for r in RUNS["gap_stats"](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("y").collect()] == want
