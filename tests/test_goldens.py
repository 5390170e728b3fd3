"""Published values that the operators must reach without any pixels."""

import math

import pytest

from tessella.operators import geometry as G
from tessella.operators import split
from tessella.plans.geometry_queries import FOOTPRINTS, footprints
from tessella.registry import RUNS


def test_areas(spark):
    got = {r.key: r.area_km2 for r in G.footprint_area(footprints(spark), "key").collect()}
    want = {"O21": 91.98945819, "O24": 90.40578943, "IIRS": 26498.288018, "TMC_system": 26493.112180, "TMC_refined": 26951.318030, "TMC_corrected": 44217.923798}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6 if v < 100 else 2e-5)


def test_overlaps(spark):
    got = {(r.key_a, r.key_b): r for r in G.overlaps(footprints(spark), "key").collect()}
    want = {("O21", "O24"): 2.64272534, ("IIRS", "O24"): 24.08145077, ("IIRS", "TMC_refined"): 25258.00855445, ("O24", "TMC_refined"): 7.05749870, ("O24", "TMC_system"): 18.62342895, ("O24", "TMC_corrected"): 90.40578943, ("IIRS", "O21"): 0, ("O21", "TMC_refined"): 0}
    for k, v in want.items():
        assert got[k].shared_km2 == pytest.approx(v, rel=1e-7, abs=1e-7)
    assert got["O21", "O24"].percent_a == pytest.approx(2.8729, abs=1e-3) and got["O21", "O24"].percent_b == pytest.approx(2.9232, abs=1e-3)
    assert got["IIRS", "O21"].lon_min is None


def test_split_of_the_published_origins(spark):
    rows = [(i, 0, r, 0) for i, r in enumerate(r for r in range(0, 4213, 64) if r % 512 <= 384 and r <= 4160)]
    assert len(rows) == 58
    out = split.assign_splits(spark.createDataFrame(rows, "patch_id long, strip_id long, row0 long, col0 long"), 128)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {0: 36, 1: 7, 2: 7, -1: 8}


def test_grid_and_padding(spark):
    from tessella.operators import resample

    tiny = spark.createDataFrame([("p", 4339, 140, 1.0)], "product string, y long, x long, v double")
    out = resample.pad_to_multiple(tiny, 8)
    assert (out.agg({"y": "max"}).first()[0], out.agg({"x": "max"}).first()[0]) == (4343, 143)
    assert RUNS["common_grid"](spark, "").first().n_rows == 4340


def test_inverse_model(spark):
    from pyspark.sql import functions as F

    corner = [F.lit(v).alias(f"{n}_{c}") for n, p in zip(("ul", "ur", "lr", "ll"), FOOTPRINTS["O24"], strict=True) for c, v in zip(("lat", "lon"), p, strict=True)]
    x, y = 0.3, 0.7
    ul, ur, lr, ll = FOOTPRINTS["O24"]
    lat, lon = ((1 - x) * (1 - y) * ul[i] + x * (1 - y) * ur[i] + (1 - x) * y * ll[i] + x * y * lr[i] for i in (0, 1))
    row = G.inverse_search(spark.createDataFrame([(lat, lon)], "lat double, lon double").select("*", *corner)).first()
    assert math.isclose(row.bx, x, abs_tol=1e-5) and math.isclose(row.by, y, abs_tol=1e-5)
