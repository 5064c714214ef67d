"""Files: GeoTIFF in all its packings, cubes by byte ranges, control points, packages."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterloom.plans import files as P
from craterloom.sources import control, cubes, geotiff, sinks


def images():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (5, 7), (200, 130)):
        yield rng.normal(size=shape).astype(np.float32)
        yield rng.integers(0, 4, shape).astype(np.float32)
        yield np.zeros(shape, np.float32)


@pytest.mark.parametrize("compress", ["lzw", "deflate", "none"])
def test_geotiff_round_trip(compress):
    for image in images():
        t = geotiff.read_geotiff(geotiff.write_geotiff(image, 2.5, (10.0, 20.0), sun=(100.0, 30.0), compress=compress))
        assert np.array_equal(t.image, image)
        assert (t.gsd_m, t.origin, t.crs, t.nodata, t.sun_azimuth, t.sun_elevation) == (2.5, (10.0, 20.0), "IAU2000:30100", -9999.0, 100.0, 30.0)
    holes = np.array([[1.0, np.nan], [np.nan, 4.0]], np.float32)
    assert geotiff.read_geotiff(geotiff.write_geotiff(holes, compress=compress)).image.tolist() == [[1.0, -9999.0], [-9999.0, 4.0]]
    assert geotiff.verified(geotiff.write_geotiff(holes, compress=compress), holes)
    with pytest.raises(ValueError, match="VERIFICATION"):
        geotiff.verified(geotiff.write_geotiff(holes, compress=compress), holes + 1)


def test_lzw_of_any_bytes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 254, 255, 256, 257, 300, 3838, 3839, 3840, 20_000):
        for raw in (bytes(n), rng.integers(0, 256, n).astype(np.uint8).tobytes(), rng.integers(0, 3, n).astype(np.uint8).tobytes()):
            assert geotiff._lzw(geotiff._to_lzw(raw)) == raw
    assert geotiff._packbits(bytes([2, 7, 8, 9, 254, 5, 128, 0, 1])) == bytes([7, 8, 9, 5, 5, 5, 1])


def tiff(tags, blocks, order="<"):
    """A file from tags (tag: (kind, values)) and blocks; tag 273 or 324 is filled in."""
    body, places = b"", []
    for b in blocks:
        places.append(8 + len(body))
        body += b
    where = 324 if 322 in tags else 273
    tags = tags | {where: (4, places), where + (1 if where == 324 else 6): (4, [len(b) for b in blocks])}
    codes = {2: "s", 3: "H", 4: "I", 12: "d"}
    at = 8 + len(body)
    beyond, extra, head = at + 2 + 12 * len(tags) + 4, b"", struct.pack(order + "H", len(tags))
    for tag, (kind, values) in sorted(tags.items()):
        raw = values if kind == 2 else struct.pack(f"{order}{len(values)}{codes[kind]}", *values)
        n = len(values)
        head += struct.pack(order + "HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", beyond + len(extra)))
        extra += b"" if len(raw) <= 4 else raw
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, at) + body + head + struct.pack(order + "I", 0) + extra


def test_tiles_predictors_and_orders():
    image = np.arange(40 * 50, dtype=np.uint16).reshape(40, 50) * 7 % 5003
    base = {256: (3, [50]), 257: (3, [40]), 258: (3, [16]), 277: (3, [1]), 339: (3, [1])}
    for order in "<>":
        tiles = []
        for y in range(0, 40, 16):
            for x in range(0, 50, 16):
                tile = np.zeros((16, 16), np.uint16)
                part = image[y:y + 16, x:x + 16]
                tile[:part.shape[0], :part.shape[1]] = part
                tiles.append(tile)
        plain = [t.astype(order + "u2").tobytes() for t in tiles]
        differenced = [zlib.compress(np.diff(t, axis=1, prepend=np.uint16(0)).astype(order + "u2").tobytes()) for t in tiles]
        shape = {322: (3, [16]), 323: (3, [16])}
        assert np.array_equal(geotiff.read_geotiff(tiff(base | shape | {259: (3, [1])}, plain, order)).image, image)
        assert np.array_equal(geotiff.read_geotiff(tiff(base | shape | {259: (3, [8]), 317: (3, [2])}, differenced, order)).image, image)
    real = np.random.default_rng(3).normal(size=(6, 9)).astype(np.float32)
    rows = real.astype(">f4").view(np.uint8).reshape(6, 9, 4).transpose(0, 2, 1).reshape(6, 36)
    packed = zlib.compress(np.diff(rows, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes())
    tags = {256: (3, [9]), 257: (3, [6]), 258: (3, [32]), 259: (3, [8]), 277: (3, [1]), 278: (3, [6]), 317: (3, [3]), 339: (3, [3]), 34264: (12, [3.0, 0, 0, 7, 0, -3.0, 0, 8, 0, 0, 0, 0, 0, 0, 0, 1])}
    t = geotiff.read_geotiff(tiff(tags, [packed]))
    assert np.array_equal(t.image, real) and (t.gsd_m, t.origin, t.nodata) == (3.0, (7.0, 8.0), None)


def test_files_that_are_not_read(spark):
    good = geotiff.write_geotiff(np.ones((4, 4), np.float32))
    huge = tiff({256: (4, [200_000]), 257: (4, [10]), 258: (3, [8]), 277: (3, [1])}, [b""])
    heavy = tiff({256: (4, [90_000]), 257: (4, [90_000]), 258: (3, [8]), 277: (3, [1])}, [b""])
    odd = tiff({256: (4, [2]), 257: (4, [2]), 258: (3, [8]), 259: (3, [7]), 277: (3, [1])}, [b"1234"])
    short = tiff({256: (4, [4]), 257: (4, [4]), 258: (3, [8]), 259: (3, [1]), 277: (3, [1])}, [b"1234"])
    evil = good.replace(b"IAU2000:30100|", b"IAU2000:30100|") + b""
    rows = [("a", good), ("b", b"nothing"), ("c", huge), ("d", heavy), ("e", odd), ("f", short), ("g", evil), ("h", b"")]
    got = {r.path: r for r in geotiff.read_headers(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).collect()}
    assert [got[p].problem and got[p].problem.split(":")[0] for p, _ in rows] == [None, "not a TIFF file", "DIMENSIONS_TOO_LARGE", "TOO_MANY_BYTES", "UNKNOWN_COMPRESSION", "TRUNCATED", None, "not a TIFF file"]
    assert geotiff.read_headers(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_ranges_of_files(spark, tmp_path):
    cube = np.arange(3 * 50 * 4, dtype=">i2").reshape(3, 50, 4)
    files = spark.createDataFrame([("x/c.img", bytearray(b"HEAD" + cube.tobytes()))], "name string, content binary")
    path = sinks.write_files(files, str(tmp_path)).first().path
    layout = spark.createDataFrame([(path, 4, 3, 50, 4, "SignedMSB2", 5.0)], "path string, offset long, bands int, lines int, samples int, kind string, nodata double")
    for at_once in (7, 256):
        got = {(r.band, r.y, r.x): r.value for r in cubes.read_ranges(layout, at_once).collect()}
        assert len(got) == cube.size and got[0, 1, 1] is None and all(v == cube[k] for k, v in got.items() if v is not None)
    with pytest.raises(Exception, match="TRUNCATED"):
        cubes.read_ranges(layout.withColumn("bands", F.lit(4))).count()
    assert cubes.read_ranges(layout.limit(0)).count() == 0


def test_layout_of_an_image(spark):
    text = "<r><Array_2D><offset unit='byte'>1,024 bytes</offset><data_type>UnsignedLSB2</data_type><elements>30</elements><elements>40</elements></Array_2D><bits>16</bits></r>"
    r = cubes.layouts(spark.createDataFrame([("p", text), ("q", "<r/>")], "path string, text string")).orderBy("path").collect()
    assert (r[0].offset, r[0].bands, r[0].lines, r[0].samples, r[0].kind, r[0].problem) == (1024, 1, 30, 40, "UnsignedLSB2", None)
    assert r[1].problem == "NO_DIMENSIONS"


def test_control_points(spark):
    point = {"source_x": 1, "source_y": 2.5, "reference_x": 3, "reference_y": 4}
    docs = [
        (1, {"method": "MANUAL", "points": [point, point | {"uncertainty_px": 0.3}], "source": "s"}), (2, {"method": "manual", "pair_id": "2", "points": [point]}), (3, {"method": "manual", "pair_id": 9, "points": [point]}),
        (4, {"method": "guess", "points": [point]}), (5, {"method": "manual", "points": []}), (6, {"method": "manual"}), (7, {"method": "manual", "points": [{"source_x": 1}]}), (8, {"method": "manual", "points": [point | {"source_x": "far"}]}), (9, [1]), (10, None),
    ]
    df = spark.createDataFrame([(k, None if d is None else json.dumps(d)) for k, d in docs], "pair_id long, text string")
    got = {r.pair_id: r.verdict for r in control.judged(df).collect()}
    assert got == {1: "OK", 2: "OK", 3: "OTHER_PAIR", 4: "UNSUPPORTED_METHOD", 5: "NO_POINTS", 6: "NO_POINTS", 7: "MISSING_FIELD", 8: "NOT_A_NUMBER", 9: "NOT_AN_OBJECT", 10: "NOT_AN_OBJECT"}
    rows = sorted((r.pair_id, r["index"], r.source_y, r.uncertainty_px, r.source) for r in control.imported(df).collect())
    assert rows == [(1, 0, 2.5, 0.0, "s"), (1, 1, 2.5, 0.3, "s"), (2, 0, 2.5, 0.0, "unknown")]


def test_package_is_json(spark, data):
    got = P._package(spark, data).collect()
    assert len(got) == 50
    for r in got:
        doc = json.loads(r.content)
        if r.file == "transform.json":
            assert len(doc["matrix"]) == 3 and doc["model"] == "HOMOGRAPHY"
        if r.file == "geometry.json":
            assert doc["held_out_residuals"] == [] and doc["fit_residuals"] == sorted(doc["fit_residuals"]) and doc["fit_point_count"] >= doc["inlier_count"]
    assert len({r.file for r in got}) == 10
