"""Sources on small files made here, and recipes and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.plans import recipes
from tessella.sources import catalogue, raster_files, raw_image, text_records
from tessella.streaming import windows

LABEL = """<Product xmlns="urn:a" xmlns:isda="urn:b"><File><file_name>a.img</file_name></File><Array_2D_Image><offset unit="byte">16</offset><axes>2</axes>
<Axis_Array><axis_name>Line</axis_name><elements>5</elements></Axis_Array><Axis_Array><axis_name>Sample</axis_name><elements>4</elements></Axis_Array>
<Element_Array><data_type>UnsignedLSB2</data_type></Element_Array></Array_2D_Image><isda:roll unit="deg">1.5</isda:roll><isda:roll unit="deg">2.5</isda:roll></Product>"""


def test_labels(spark):
    row = catalogue.parse_labels(spark.createDataFrame([("p", LABEL)], "path string, value string")).first()
    assert (row.file_name, row.data_type, row.offset, row.axes, row.params) == ("a.img", "UnsignedLSB2", 16, {"Line": 5, "Sample": 4}, {"roll": "2.5"})
    leaves = {r.tag: r.value for r in catalogue.label_leaves(spark.createDataFrame([("p", LABEL)], "path string, value string")).collect()}
    assert leaves["data_type"] == "UnsignedLSB2" and leaves["roll"] in ("1.5", "2.5")
    with pytest.raises(Exception, match="without an array"):
        catalogue.parse_labels(spark.createDataFrame([("p", "<a><b>1</b></a>")], "path string, value string")).collect()


def test_catalogue(spark, tmp_path):
    for name in ("ohr_1/a.img", "ohr_1/a.xml", "ohr_1/.git/a.img", "iir/x.QUB", "iir/x.hdr", "other/y.tif", "other/y.xml", "none/z.xml"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("version https://git-lfs.github.com/spec/v1\n" if name.endswith("tif") else "data")
    found = catalogue.files(spark, str(tmp_path))
    got = {(r.dir.rsplit("/", 1)[1], r.sensor, r.kind) for r in catalogue.discover(found).collect()}
    assert got == {("ohr_1", "OHRC", "raw"), ("iir", "IIRS", "cube"), ("other", "UNKNOWN_TIFF", "tiff")}
    assert [r.path.rsplit("/", 1)[1] for r in found.where(catalogue.is_pointer(F.col("content"))).collect()] == ["y.tif"]
    assert catalogue.find_one(found, "x.hdr").first().path.endswith("iir/x.hdr")
    with pytest.raises(Exception, match="not found"):
        catalogue.find_one(found, "nothing.img").collect()


def test_raw_images(spark, tmp_path):
    spark.dataSource.register(raw_image.RawImageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    cube = np.random.default_rng(1).integers(0, 60000, (3, 5, 4)).astype("<u2")
    (tmp_path / "c.qub").write_bytes(b"h" * 16 + cube.tobytes() + b"half a band")
    options = {"path": str(tmp_path / "c.qub"), "lines": "5", "samples": "4", "offset": "16", "dtype": "<u2", "rows_per_partition": "2"}
    df = spark.read.format("rawimage").options(**options, bands="7", truncated="true").load()
    assert df.count() == 60
    one = df.where("band = 1")
    assert one.rdd.getNumPartitions() == 3
    assert all(cube[r.band, r.y, r.x] == r.v for r in one.collect()) and one.count() == 20
    with pytest.raises(Exception, match="holds 3 of 7"):
        spark.read.format("rawimage").options(**options, bands="7").load().collect()
    window = df.where("band = 2 and y >= 2 and y < 4")
    assert window.rdd.getNumPartitions() == 1 and sorted((r.y, r.x, r.v) for r in window.collect()) == sorted((y, x, cube[2, y, x]) for y in (2, 3) for x in range(4))
    (tmp_path / "whole.qub").write_bytes(cube.tobytes())
    stored = raw_image.read_lines(spark, f"file://{tmp_path}/whole.qub", 5, 4, "<u2").collect()
    assert len(stored) == 60 and all(cube[r.band, r.y, r.x] == r.v for r in stored)
    header = {"lines": 5, "samples": 4, "bands": 7, "offset": 16, "dtype": "<u2", "interleave": "bsq"}
    assert raster_files.read_cube(spark, str(tmp_path / "c.qub"), header).count() == 60
    assert raw_image.nearest_band({0: 0.8, 1: 0.9, 2: 1.0, 5: 1.5}, 3, 1.5) == 2 and raw_image.nearest_band({}, 3, 1.5) == 0


def test_headers_and_tables(spark):
    lines = spark.createDataFrame([("samples = 250",), ("Data Type=2",), ("lines = 13101 ",), ("note = a = b",), ("none",), ("byte order = 1",)], "value string")
    pairs = {r.key: r.value for r in text_records.key_values(lines).collect()}
    assert pairs["lines"] == "13101" and pairs["note"] == "a = b"
    assert text_records.header_info(pairs) == {"samples": 250, "lines": 13101, "bands": 1, "offset": 0, "dtype": ">i2", "interleave": "bsq"}
    with pytest.raises(ValueError, match="unknown"):
        text_records.header_info(pairs | {"data type": "99"})


def test_orbit_records(spark):
    line = list(" " * 627)

    def put(at, text):
        line[at : at + len(text)] = text

    put(0, "ORBTATTD")
    put(8, "     1")
    for (at, w), v in zip(text_records.ORBIT_TIME.values(), (2024, 3, 30, 0, 35, 6, 376), strict=True):
        put(at, str(v).rjust(w))
    for name, value in (("subsat_lat", "0.55449111"), ("altitude", "119.939"), ("slant_range", "1234567.89"), ("orbit_no", "20599")):
        at, w = text_records.ORBIT_FIELDS[name]
        put(at, value.rjust(w))
    row = text_records.parse_orbit(spark.createDataFrame([("".join(line),), ("HEADER",)], "value string")).first()
    assert (str(row.ts), row.record_no, row.subsat_lat, row.slant_range, row.orbit_no, row.phase) == ("2024-03-30 00:35:06.376000", 1, 0.55449111, 1234567.89, 20599, None)


def test_recipes(spark):
    tiny = spark.createDataFrame([("p", y, x, float((y * 13 + x * 7) % 50)) for y in range(16) for x in range(16)], "product string, y long, x long, v double")
    for name in ("OHRC_NAC", "IIRS_WAC", "DFSAR_SELENE", "TMC_NAC", "IIRS_1P5UM"):
        out = recipes.run_recipe(tiny, name)
        assert out.count() == 256 and out.where("v < 0 or v > 255").count() == 0
        assert out.first().steps_applied[0] == "normalize_u8"
    assert recipes.run_recipe(tiny, "OHRC_NAC", 1.0, 2.0).count() == 64
    with pytest.raises(ValueError, match="unknown sensor pair"):
        recipes.recipe("X_Y")


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", m % 2, float(m)) for m in range(0, 50, 3)]
    batch = spark.createDataFrame(rows, "ts string, k int, value double").withColumn("ts", F.to_timestamp("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, "ts", "value", ["k"], "10 minutes", "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("tumbled").collect()) == sorted(windows.tumbling(batch, "ts", "value", ["k"], "10 minutes", "1 hour").collect())
    assert windows.sessions(batch, "ts", ["k"], "5 minutes", "1 hour").count() == 17
