"""Files written and read again, and files of other programs' making."""

import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import tiff
from tessella.operators import samples
from tessella.sinks import documents, raster_files
from tessella.sources import raster_files as sources


def frame(spark, image, product="a"):
    rows = [(product, y, x, float(v)) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "product string, y long, x long, v double")


def array(df):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r.v
    return out


@pytest.mark.parametrize("size", [0, 1, 253, 254, 255, 3837, 3838, 3839, 20000])
def test_lzw_round_trip(size):
    for values in (1, 2, 256):
        data = np.random.default_rng(size).integers(0, values, size, dtype=np.uint8).tobytes()
        assert tiff.lzw_unpack(tiff.lzw_pack(data)) == data


def strips(image, *, order="<", compression=1, rows=5):
    """A file of strips, as other programs write it: the small variant."""
    data = image.astype(image.dtype.newbyteorder(order))
    parts = [tiff.pack(data[i : i + rows].tobytes(), compression) for i in range(0, len(data), rows)]
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    bands = image.shape[2] if image.ndim == 3 else 1
    tags = [(256, 4, [image.shape[1]]), (257, 4, [image.shape[0]]), (258, 3, [image.dtype.itemsize * 8]), (259, 3, [compression]), (273, 4, offsets), (277, 3, [bands]), (278, 4, [rows]), (279, 4, [len(p) for p in parts]), (339, 3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]]), (33550, 12, [0.5, 0.25, 0]), (33922, 12, [0, 0, 0, 23.0, 6.5, 0])]
    body, beyond, after = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *values)
        place = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack(f"{order}I", after + len(beyond))
        beyond += packed if len(packed) > 4 else b""
        body += struct.pack(f"{order}HHI", tag, kind, len(values)) + place
    head = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, at)
    return head + b"".join(parts) + struct.pack(f"{order}H", len(tags)) + body + struct.pack(f"{order}I", 0) + beyond


@pytest.mark.parametrize(("order", "compression", "dtype"), [("<", 1, "u1"), (">", 1, "u2"), ("<", 5, "i2"), (">", 8, "f4")])
def test_strips_are_read(spark, tmp_path, order, compression, dtype):
    image = np.random.default_rng(2).integers(0, 100, (13, 9)).astype(dtype)
    (tmp_path / "one.tif").write_bytes(strips(image, order=order, compression=compression))
    pixels = sources.read_single_band(spark, f"file://{tmp_path}/one.tif")
    assert (array(pixels) == image).all()
    info = sources.probe(sources.read_files(spark, f"file://{tmp_path}/one.tif")).first()
    assert (info.width, info.height, info.bands, info.error) == (9, 13, 1, None)
    assert info.geotransform == [23.0, 0.5, 0.0, 6.5, 0.0, -0.25] and info.bounds == [23.0, 3.25, 27.5, 6.5]


def test_colours_become_grey_and_bad_files_raise(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (4, 6, 3)).astype("u1")
    (tmp_path / "c.tif").write_bytes(strips(image))
    got = array(sources.read_raster(spark, f"file://{tmp_path}/c.tif"))
    assert np.abs(got - image @ [0.299, 0.587, 0.114]).max() <= 0.5 + 1e-9
    with pytest.raises(Exception, match="more than one band"):
        sources.read_single_band(spark, f"file://{tmp_path}/c.tif").count()
    (tmp_path / "p.tif").write_text("version https://git-lfs.github.com/spec/v1\n")
    with pytest.raises(Exception, match="pointer"):
        sources.read_raster(spark, f"file://{tmp_path}/p.tif").count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        sources.read_raster(spark, f"file://{tmp_path}/none.tif").count()


def test_tiles_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(0, 60000, (70, 45)), "b": rng.integers(0, 9, (33, 100))}
    both = frame(spark, images["a"], "a").unionByName(frame(spark, images["b"], "b"))
    geo = (22.9, 0.001, 0.0, 6.6, 0.0, -0.002)
    assert raster_files.write_files(raster_files.encode_tiff(both, tile=32, geotransform=geo), f"file://{tmp_path}/out") == 2
    for name, image in images.items():
        files = sources.read_files(spark, f"file://{tmp_path}/out/{name}.tif")
        assert (array(sources.read_raster(spark, f"file://{tmp_path}/out/{name}.tif")) == image).all()
        info = sources.probe(files).first()
        assert info.tiled and info.compression == 5 and np.allclose(info.geotransform, geo)
        assert sources.full_read(files).first().passed
    damaged = bytearray((tmp_path / "out" / "a.tif").read_bytes())
    (tmp_path / "bad.tif").write_bytes(damaged[: len(damaged) // 2])
    assert not sources.full_read(sources.read_files(spark, f"file://{tmp_path}/bad.tif")).first().passed
    assert sources.probe(sources.read_files(spark, f"file://{tmp_path}/bad.tif")).first().error
    with pytest.raises(Exception, match="do not fit"):
        raster_files.encode_tiff(frame(spark, np.array([[70000]])), "<u2").count()
    with pytest.raises(ValueError, match="mount"):
        raster_files.write_files(raster_files.encode_tiff(both), "s3a://bucket/out")


def test_a_file_known_by_two_ranges(spark, tmp_path):
    image = np.arange(40 * 30).reshape(40, 30)
    raster_files.write_files(raster_files.encode_tiff(frame(spark, image), tile=16, geotransform=(23.0, 0.5, 0, 6.5, 0, -0.25)), str(tmp_path))
    data = (tmp_path / "a.tif").read_bytes()
    at = struct.unpack("<Q", data[8:16])[0]
    files = sources.read_files(spark, f"file://{tmp_path}/a.tif")
    parts = sources.byte_ranges(files, [(0, 16), (at, len(data) - at)])
    info = sources.probe_sparse(parts).first()
    assert (info.height, info.width, info.geotransform[0]) == (40, 30, 23.0)
    scale = parts.where("place > 0").select(sources.numbers(F.substring("content", 1, 8), "<Q").alias("n")).first().n
    assert scale == [struct.unpack("<Q", data[at : at + 8])[0]]
    assert "not at hand" in sources.probe_sparse(parts.where("place = 0")).first().error
    with pytest.raises(Exception, match="beyond the end"):
        sources.byte_ranges(files, [(len(data) - 4, 10)]).count()


def read_png(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, size = 8, b"", None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        content = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + content)
        size = struct.unpack(">II", content[:8]) if name == b"IHDR" else size
        body += content if name == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    assert not raw[:, 0].any()
    return raw[:, 1:]


def test_images_and_arrays_round_trip(spark, tmp_path):
    image = np.random.default_rng(5).integers(0, 256, (50, 21))
    raster_files.write_files(raster_files.encode_png(frame(spark, image), lines=8), str(tmp_path))
    assert (read_png((tmp_path / "a.png").read_bytes()) == image).all()
    raster_files.write_files(raster_files.encode_png(frame(spark, image / 255, "u"), unit=True), str(tmp_path))
    assert (read_png((tmp_path / "u.png").read_bytes()) == image).all()
    raster_files.write_files(raster_files.encode_npy(frame(spark, image / 255), lines=8), str(tmp_path))
    back = np.load(tmp_path / "a.npy")
    assert back.shape == (1, 1, 50, 21) and back.dtype == np.float32 and np.allclose(back[0, 0], image / 255)
    row = sources.read_arrays(spark, f"file://{tmp_path}/a.npy").first()
    assert row.shape == [1, 1, 50, 21] and np.allclose(np.array(row["values"]).reshape(50, 21), image / 255, atol=1e-6)


def patch_rows(n=6, side=16):
    rng = np.random.default_rng(6)
    return [(i, i % 2, i * 64, 0, rng.random(side * side).tolist(), rng.random(side * side).tolist(), (rng.random(side * side) > 0.2).astype(float).tolist()) for i in range(n)]


PATCHES = "patch_id long, strip_id long, row0 long, col0 long, img0 array<double>, img1 array<double>, mask array<double>"


def test_patch_sets_round_trip(spark, tmp_path):
    rows = patch_rows()
    patches = spark.createDataFrame(rows, PATCHES).withColumn("shard", F.concat(F.lit("set"), F.col("strip_id").cast("string")))
    assert raster_files.write_files(raster_files.encode_patch_sets(patches, "shard"), str(tmp_path)) == 2
    back = {r.patch_id: r for r in sources.read_patches(spark, f"file://{tmp_path}/*.npz").collect()}
    for i, strip, row0, col0, img0, img1, mask in rows:
        r = back[i]
        assert (r.strip_id, r.row0, r.col0) == (strip, row0, col0) and r.mask == mask
        assert np.abs(np.array(r.img0) - img0).max() <= 0.5 / 255 + 1e-9 and np.abs(np.array(r.img1) - img1).max() <= 0.5 / 255 + 1e-9
    out = io.BytesIO()
    np.savez(out, ohrc=np.zeros((2, 1, 8, 8), np.uint8), img1=np.full((2, 1, 8, 8), 255, np.uint8), origin_row_col_lat_lon=np.array([[0, 1, 0.5, 23.0], [64, 2, 0.4, 23.0]]))
    (tmp_path / "other.npz").write_bytes(out.getvalue())
    other = sources.read_patches(spark, f"file://{tmp_path}/other.npz").orderBy("patch_id").collect()
    assert [(r.row0, r.col0, r.mask, r.img1[0]) for r in other] == [(0, 1, None, 1.0), (64, 2, None, 1.0)]
    out = io.BytesIO()
    np.savez(out, img0=np.zeros((2, 1, 9, 9)), img1=np.zeros((2, 1, 9, 9)), origin_row_col=np.zeros((2, 2)))
    (tmp_path / "odd.npz").write_bytes(out.getvalue())
    with pytest.raises(Exception, match="divisible by 8"):
        sources.read_patches(spark, f"file://{tmp_path}/odd.npz").count()


def test_samples(spark):
    rows = patch_rows(3)
    patches = spark.createDataFrame(rows, PATCHES)
    made = samples.assemble(patches, repeat=2, seed=5, most=3.0).orderBy("patch_id", "repeat").collect()
    again = samples.assemble(patches.repartition(3), repeat=2, seed=5, most=3.0).orderBy("patch_id", "repeat").collect()
    assert made == again and len(made) == 6 and made[0].h_gt != made[1].h_gt
    for r in made:
        assert all(v == 0 for v, m in zip(r.image1, r.mask1, strict=True) if m == 0) and set(r.mask1) <= {0.0, 1.0}
        assert all(v == 0 for v, m in zip(r.image0, r.mask0, strict=True) if m == 0)
    plain = samples.assemble(patches, warped=False, photometric=0.0).orderBy("patch_id").collect()
    for r, (_, _, _, _, img0, img1, mask) in zip(plain, rows, strict=True):
        assert np.allclose(r.image0, np.array(img0) * mask) and np.allclose(r.image1, np.array(img1) * mask) and r.h_gt == np.eye(3).ravel().tolist()
    with pytest.raises(Exception, match="0..1"):
        samples.assemble(patches.withColumn("img0", F.transform("img0", lambda x: x * 300))).count()


def test_crater_scenes_are_repeatable(spark):
    one, two, other = (array(samples.crater_scene(spark, 60, 80, seed=s)) for s in (1, 1, 2))
    assert (one == two).all() and (one != other).any() and one.min() >= 0 and one.max() <= 255 and one.std() > 5
    flat = array(samples.crater_scene(spark, 100, 100, craters=0, seed=3))
    assert abs(flat.mean() - 120) < 0.5 and abs(flat.std() - 6) < 0.3


def test_documents(spark, tmp_path):
    meta = spark.createDataFrame([("x", 1.5, [1, 2], [0.5, 0.5], None)], "name string, gsd double, size array<int>, pixels array<double>, note string").withColumn("shape", F.struct(F.lit(3).alias("h")))
    raster_files.write_files(documents.one_each(meta, "name"), str(tmp_path))
    assert json.loads((tmp_path / "x.json").read_text()) == {"gsd": 1.5, "note": None, "shape": {"h": 3}}
    epochs = spark.createDataFrame([(2, 0.5, 1.0), (1, 0.9, 2.0), (3, 0.4, 1.5), (4, 0.3, 0.9)], "epoch int, loss double, rmse double")
    raster_files.write_files(documents.history(epochs), str(tmp_path))
    assert [r["epoch"] for r in json.loads((tmp_path / "history.json").read_text())] == [1, 2, 3, 4]
    assert sorted(r.epoch for r in documents.improvements(epochs, "rmse").collect()) == [1, 2, 4]
    pairs = spark.createDataFrame([(1, "kan", 0.5), (0, "kan", 0.7)], "pair long, variant string, rmse double")
    raster_files.write_files(documents.telemetry(pairs, pairs.groupBy("variant").agg(F.avg("rmse").alias("mean")), {"seed": 1}), str(tmp_path))
    told = json.loads((tmp_path / "evaluation.json").read_text())
    assert told["summary"]["kan"]["mean"] == 0.6 and [p["pair"] for p in told["pairs"]] == [0, 1] and told["args"] == {"seed": "1"}
