"""Operators that SQL can't express, and edge cases, against brute force."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from craterloom.functions import geometry as G
from craterloom.functions import labels as L
from craterloom.functions import transforms as T
from craterloom.operators import checkpoints, estimation, kernels, matching, raster, registration, spectral, thinning, warping
from craterloom.plans import catalog_all, inputs, matches, registering
from craterloom.sources import readers, sinks
from craterloom.sources.scratch import ensure_checkpoint_dir


def points(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, tp_id long, src_x double, src_y double, ref_x double, ref_y double, confidence double")


def test_seam_suppression_is_greedy(spark):
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), i, 0.0, 0.0, float(x), float(y), float(c)) for i, (x, y, c) in enumerate(zip(rng.uniform(0, 60, 240), rng.uniform(0, 60, 240), rng.integers(1, 20, 240) / 20))]
    got = {(r.pair_id, r.tp_id) for r in thinning.seam_survivors(points(spark, rows), 6.0).collect()}
    want = set()
    for pair in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == pair), key=lambda r: (-r[6], r[1])):
            if all((r[4] - k[4]) ** 2 + (r[5] - k[5]) ** 2 > 36 for k in kept):
                kept.append(r)
        want |= {(pair, k[1]) for k in kept}
    assert got == want


def test_seam_suppression_of_nothing(spark):
    ensure_checkpoint_dir(spark)
    assert thinning.seam_survivors(points(spark, []), 4.0).count() == 0
    assert thinning.seam_survivors(points(spark, [(0, 1, 0.0, 0.0, 5.0, 5.0, 0.5)]), 4.0).count() == 1


def test_empty_region():
    assert thinning.empty_region([0] * 64) == 64
    assert thinning.empty_region([1] * 64) == 0
    wall = [1 if i % 8 == 3 else 0 for i in range(64)]
    assert thinning.empty_region(wall) == 32


def test_consensus_finds_a_homography_among_outliers(spark):
    rng = np.random.default_rng(2)
    h = np.array([[1.02, 0.03, 5], [-0.02, 0.98, -7], [1e-5, 2e-5, 1]])
    src = rng.uniform(0, 1000, (80, 2))
    p = np.column_stack([src, np.ones(80)]) @ h.T
    ref = p[:, :2] / p[:, 2:]
    ref[:20] += rng.uniform(30, 90, (20, 2))
    rows = [(1, i, *map(float, src[i]), *map(float, ref[i]), 1.0) for i in range(80)]
    best = estimation.selected(estimation.fitted(points(spark, rows), tuple(estimation.MODELS), 1.0)).collect()[0]
    assert best.model == "HOMOGRAPHY" and best.inliers == 60 and best.rmse < 1e-6
    assert np.allclose([[best[f"h{i}{j}"] for j in range(3)] for i in range(3)], h, atol=1e-6)
    few = estimation.fitted(points(spark, rows[:3]), ("HOMOGRAPHY",), 1.0)
    assert few.count() == 0


def test_consensus_draws_until_many_outliers_are_passed(spark):
    """A fifth of the points are inliers: 200 draws meet four of them with 27 per cent chance, 5000 with over 99.9."""
    rows, h = [], np.array([[1.02, 0.03, 5], [-0.02, 0.98, -7], [1e-5, 2e-5, 1]])
    for pair in range(6):
        rng = np.random.default_rng(pair)
        src = rng.uniform(0, 1000, (100, 2))
        p = np.column_stack([src, np.ones(100)]) @ h.T
        ref = p[:, :2] / p[:, 2:]
        ref[rng.permutation(100)[20:]] = rng.uniform(0, 1000, (80, 2))
        rows += [(pair, i, *map(float, src[i]), *map(float, ref[i]), 1.0) for i in range(100)]
    found = lambda **bound: sum(r.inliers >= 20 and np.allclose([[r[f"h{i}{j}"] for j in range(3)] for i in range(3)], h, atol=1e-3) for r in estimation.fitted(points(spark, rows), ("HOMOGRAPHY",), 1.0, **bound).collect())
    assert found() == 6
    assert found(rounds=200) < 6
    assert estimation.draws(0.5, 4, 0.999) == pytest.approx(np.log(0.001) / np.log(1 - 0.5**4)) and estimation.draws(1.0, 4, 0.999) == 0


def test_inverse_undoes(spark):
    df = spark.createDataFrame([(1.1, 0.2, 3.0, -0.1, 0.9, 4.0, 1e-4, 2e-4, 1.0)], ", ".join(f"{c} double" for c in T.H))
    x, y = T.applied(F.lit(10.0), F.lit(20.0))
    out = df.select(x.alias("x"), y.alias("y"), *(c.alias(n) for n, c in T.inverse().items()))
    bx, by = T.applied(F.col("x"), F.col("y"))
    r = out.select(bx.alias("bx"), by.alias("by")).first()
    assert abs(r.bx - 10) < 1e-9 and abs(r.by - 20) < 1e-9
    flat = spark.createDataFrame([(0.0,) * 9], ", ".join(f"{c} double" for c in T.H)).select(T.plausibility().alias("v"), T.inverse()["h00"].alias("i")).first()
    assert flat.v == "NON_POSITIVE_DETERMINANT" and flat.i is None


def test_two_nearest_of_one(spark):
    a = spark.createDataFrame([(1, 1, [0.0, 0.0])], "pair_id long, id long, v array<double>")
    b = spark.createDataFrame([(1, 7, [3.0, 4.0])], "pair_id long, id long, v array<double>")
    r = matching.two_nearest(a, b).first()
    assert (r.near1, r.d1, r.d2, r.mutual) == (7, 5.0, None, True)
    assert matching.ratio_matches(a, b).count() == 0


def test_boxes_of_all_sizes_meet_once(spark):
    from craterloom.operators import pairing

    rng = np.random.default_rng(15)
    rows = []
    for k in range(60):
        w, h = rng.choice([0.5, 3.0, 30.0, 200.0, 360.0], 2)
        lon, lat = rng.uniform(-180, 180), rng.uniform(-90, 90)
        rows.append((k, lon, lat, *((None,) * 4 if k % 7 == 0 else (float(lon - w / 2), float(lon + w / 2), float(lat - h / 2), float(lat + h / 2)))))
    df = spark.createDataFrame([(r[0], float(r[1]), float(r[2]), *r[3:]) for r in rows], "k long, lon double, lat double, min_lon double, max_lon double, min_lat double, max_lat double")
    df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in pairing.SIDE))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[3] is not None and b[3] is not None and min(a[4], b[4]) > max(a[3], b[3]) and min(a[6], b[6]) > max(a[5], b[5])}
    got = [(r.a_k, r.b_k) for r in pairing.overlapping_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert pairing.overlapping_cells(df, 2.0).groupBy("k", "level").count().agg(F.max("count")).first()[0] <= 16
    near = {(r.a_k, r.b_k) for r in pairing.proximate_pairs(df, 20.0).collect()}
    assert near == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[3] is None or b[3] is None) and np.hypot(a[1] - b[1], a[2] - b[2]) <= 20}


def test_unwrapped_and_area(spark):
    r = spark.range(1).select(G.unwrapped(F.array(F.lit(170.0), F.lit(-175.0), F.lit(-160.0), F.lit(10.0))).alias("u"), G.polygon_area_km2(F.array(F.lit(0.0), F.lit(90.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(90.0))).alias("a")).first()
    assert r.u == [170.0, 185.0, 200.0, 370.0]
    assert abs(r.a - 4 * np.pi * 1737.4**2 / 8) < 1e-3


def test_labels(spark):
    text = 'A = "x" /* c */\nB = 3 <km>\nB = 4\nno line\n'
    xml = '<r xmlns:p="u"><p:v> 12.5 m/px </p:v><p:w/></r>'
    r = spark.createDataFrame([(text, xml)], "t string, x string").select(L.pds3_map(F.col("t")).alias("kv"), L.number("x", "v").alias("n"), L.first_value("x", "w", "v").alias("f")).first()
    assert r.kv == {"A": "x", "B": "3"} and r.n == 12.5 and r.f == "12.5 m/px"


def test_checkpoint_rules(spark):
    rows = [("a", 1.0, 1.0, 1.0, 1.0, "A", "m"), ("b", None, 1.0, 1.0, 1.0, "A", "m"), ("c", 1.0, 1.0, 1.0, 1.0, "Z", "m"), ("d", 900.0, 1.0, 1.0, 1.0, "b", "m"), ("a", 2.0, 2.0, 1.0, 1.0, "A", "m"), ("e", 1.0, 1.0, 1.0, 1.0, "A", None)]
    df = spark.createDataFrame(rows, "point_id string, source_x double, source_y double, reference_x double, reference_y double, quality string, provenance string")
    got = sorted((r.point_id, r.verdict) for r in checkpoints.judged(df, (100.0, 100.0)).collect())
    assert got == [("a", "DUPLICATE_ID")] * 2 + [("b", "MISSING_FIELD"), ("c", "BAD_QUALITY"), ("d", "OUT_OF_BOUNDS"), ("e", "MISSING_PROVENANCE")]
    with pytest.raises(ValueError, match="DUPLICATE_ID"):
        checkpoints.require_sound(df, "point_id", source_shape=(100.0, 100.0))


def test_raw_rasters(spark, tmp_path):
    image = np.arange(2 * 3 * 4, dtype=">i2").reshape(2, 3, 4)
    (tmp_path / "a.img").write_bytes(b"HEAD" + image.tobytes())
    files = readers.read_files(spark, str(tmp_path), "*.img")
    layout = files.select("path").selectExpr("path", "4 as offset", "2 as bands", "3 as lines", "4 as samples", "'SignedMSB2' as kind", "5.0D as nodata")
    got = {(r.band, r.y, r.x): r.value for r in readers.read_raw_rasters(files, layout).collect()}
    assert len(got) == 24 and got[0, 1, 1] is None and got[1, 2, 3] == 23.0
    with pytest.raises(Exception, match="TRUNCATED"):
        readers.read_raw_rasters(files, layout.withColumn("bands", F.lit(3))).count()


def test_tiff_round_trip():
    image = np.random.default_rng(3).normal(size=(5, 7)).astype(np.float32)
    assert (readers.read_tiff(readers.write_tiff(image)) == image).all()
    with pytest.raises(KeyError):
        readers.read_tiff(b"xx")


def test_phase_shift():
    rng = np.random.default_rng(4)
    a = kernels.gaussian(rng.normal(size=(32, 36)), 1.0)
    dx, dy, response = kernels.phase_shift(a, np.roll(a, (3, -2), (0, 1)))
    assert abs(dx + 2) < 1e-6 and abs(dy - 3) < 1e-6 and 0.99 < response <= 1.01
    a = rng.normal(size=(64, 64))
    fy, fx = np.fft.fftfreq(64)[:, None], np.fft.fftfreq(64)[None]
    moved = np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (4.25 * fx - 2.5 * fy))).real
    dx, dy, _ = kernels.phase_shift(a, moved)
    assert abs(dx - 4.25) < 0.5 and abs(dy + 2.5) < 0.5  # the centroid of five places leans to whole pixels


def test_similarity_turns_and_scales():
    rng = np.random.default_rng(14)
    big = kernels.gaussian(rng.normal(size=(256, 256)), 2.0)
    a = big - big.min()
    for turn, size in ((0, 1.0), (5, 1.0), (-20, 1.0), (0, 0.9), (12, 1.1), (170, 1.0)):
        rotation, scale, dx, dy, response = kernels.similarity(a, kernels.turned(a, turn, size))
        assert abs((rotation - turn + 180) % 360 - 180) < 1 and abs(scale - size) < 0.02 and abs(dx) < 2 and abs(dy) < 2 and response > 0


def test_phase_congruency_against_its_definition():
    rng = np.random.default_rng(6)
    image = kernels.gaussian(rng.normal(size=(24, 30)), 1.0)
    low, high = np.percentile(image, [2, 98])
    spectrum = np.fft.fft2(np.clip((image - low) / (high - low), 0, 1))
    even, odd, amplitude = np.zeros((6, 24, 30)), np.zeros((6, 24, 30)), np.zeros((24, 30))
    for o in range(6):
        for s in range(4):
            g = np.zeros((24, 30))
            for i in range(24):
                for j in range(30):
                    v, u = (i - 12) / 24, (j - 15) / 30
                    r = np.hypot(u, v)
                    if r:
                        d = np.arctan2(-v, u) - o * np.pi / 6
                        d = abs(np.arctan2(np.sin(d), np.cos(d)))
                        g[i, j] = np.exp(-np.log(r * 3 * 2.1**s) ** 2 / (2 * np.log(0.55) ** 2)) * np.exp(-d**2 / (2 * (np.pi / 6 / 1.2) ** 2))
            answer = np.fft.ifft2(spectrum * np.fft.ifftshift(g))
            even[o] += answer.real
            odd[o] += answer.imag
            amplitude += abs(answer)
    energy = np.sqrt(even**2 + odd**2)
    pc, top, least, index = kernels.phase_congruency(image)
    assert np.allclose(pc, np.clip(np.hypot(even.sum(0), odd.sum(0)) / (amplitude + 1e-5), 0, 1)) and (index == energy.argmax(0)).all()
    t = np.arange(6)[:, None, None] * np.pi / 6
    xx, yy, xy = ((energy * np.cos(t)) ** 2).sum(0) / 3, ((energy * np.sin(t)) ** 2).sum(0) / 3, 2 * (energy**2 * np.cos(t) * np.sin(t)).sum(0) / 3
    for sign, got in ((1, top), (-1, least)):
        m = (xx + yy + sign * np.sqrt((xx - yy) ** 2 + xy**2)) / 2
        assert np.allclose(got, (m - m.min()) / (m.max() - m.min() + 1e-6))


def test_retinex_and_equalisation_against_their_definitions():
    rng = np.random.default_rng(7)
    image = rng.uniform(0, 1, (20, 17))
    mirror = lambda i, n: (lambda a: 2 * n - 2 - a if a >= n else a)(abs(i) % (2 * n - 2))

    def blur(sigma):
        r = int(np.ceil(2 * sigma))
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        k /= k.sum()
        rows = np.array([[sum(k[d + r] * image[y, mirror(x + d, 17)] for d in range(-r, r + 1)) for x in range(17)] for y in range(20)])
        return np.array([[sum(k[d + r] * rows[mirror(y + d, 20), x] for d in range(-r, r + 1)) for x in range(17)] for y in range(20)])

    for sigma in (1.0, 3.0, 15.0):
        assert np.allclose(kernels.gaussian(image, sigma), blur(sigma))
    flat = kernels.equalised(np.full((16, 16), 0.5))
    assert np.unique(flat).size == 1
    out = kernels.equalised(image * 0.2 + 0.4, tiles=1, clip=1e9)
    level = ((image * 0.2 + 0.4) * 255).astype(int)
    want = np.array([[np.rint((level <= v).sum() * 255 / level.size) for v in row] for row in level]) / 255
    assert np.allclose(out, want)
    assert kernels.enhanced(image).min() >= 0 and kernels.enhanced(image).max() <= 1


def test_descriptors_corners_and_correlation_against_definitions():
    rng = np.random.default_rng(8)
    mim = rng.integers(0, 6, (60, 64))
    assert kernels.mim_descriptor(mim, 23, 30) is None and kernels.mim_descriptor(mim, 36, 30) is None
    want = np.zeros((4, 4, 6))
    for i in range(48):
        for j in range(48):
            want[i // 12, j // 12, mim[30 - 24 + i, 31 - 24 + j]] += 1
    want = np.minimum(want.ravel() / np.linalg.norm(want), 0.2)
    assert np.allclose(kernels.mim_descriptor(mim, 30, 31), want / np.linalg.norm(want))
    image = kernels.gaussian(rng.normal(size=(40, 44)), 1.5)
    at = kernels.corners(image)
    assert len(at) > 4 and all(np.hypot(a - c, b - d) >= 6 for i, (a, b) in enumerate(at) for c, d in at[:i]) and len(kernels.corners(image, most=3)) == 3
    ref, target = image, np.roll(image, (1, -1), (0, 1))
    got = kernels.ncc_surface(ref, target, 20, 20)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            p, q = ref[12:29, 12:29], target[12 + dy:29 + dy, 12 + dx:29 + dx]
            assert abs(got[dy + 2, dx + 2] - np.corrcoef(p.ravel(), q.ravel())[0, 1]) < 1e-9
    assert np.unravel_index(got.argmax(), got.shape) == (3, 1) and kernels.ncc_surface(ref, target, 9, 20) is None and kernels.ncc_surface(0 * ref, target, 20, 20) is None


def test_kernel_queries_see_every_pixel_once(spark, data):
    px = inputs.relation(spark, data, "frames")
    n = px.count()
    for q in ("t8_orientation_index", "r3_retinex_clahe", "r5_phase_congruency"):
        out = catalog_all.QUERIES[q](spark, data)
        assert (out.count(), out.select("raster_id", "y", "x").distinct().count()) == (n, n)
    image = kernels.image_of(px.where("raster_id = 3 and y < 152 and x < 152").toPandas())
    top = kernels.phase_congruency(image)[1][:128, :128]
    got = catalog_all.QUERIES["r5_phase_congruency"](spark, data).where("raster_id = 3 and y < 128 and x < 128").toPandas().sort_values(["y", "x"])["value"].to_numpy()
    assert np.allclose(got, top.ravel(), atol=1e-5)


def test_corner_queries_keep_all_corners(spark, data):
    """Each tile gives every corner that the operator finds in it; r9 those whose patch fits, r11 those whose correlations peak inside."""
    px = inputs.relation(spark, data, "frames").toPandas()
    want, moments = [], []
    for k, g in px.groupby("raster_id"):
        for ty in (0, 128):
            for tx in (0, 128):
                y0, x0 = max(0, ty - 24), max(0, tx - 24)
                own = g[g.y.between(y0, ty + 151) & g.x.between(x0, tx + 151)]
                tile = kernels.image_of(own.assign(y=own.y - y0, x=own.x - x0))
                inside = lambda y, x: ty <= y < ty + 128 and tx <= x < tx + 128  # noqa: B023, E731
                want += [(k, y + y0, x + x0) for y, x in kernels.corners(tile) if inside(y + y0, x + x0)]
                _, moment, _, mim = kernels.phase_congruency(tile)
                moments += [(k, y + y0, x + x0) for y, x in kernels.corners(moment) if inside(y + y0, x + x0) and kernels.mim_descriptor(mim, y, x) is not None]
    assert sorted((r.raster_id, r.y, r.x) for r in matches.t10_corners(spark, data).collect()) == sorted(want) and len(want) > 1000
    assert sorted((r.raster_id, r.y, r.x) for r in matches.r9_descriptors(spark, data).collect()) == sorted(moments)
    got = matches.r11_ncc_subpixel(spark, data).toPandas()
    assert {(r.pair * 2, r.y, r.x) for r in got.itertuples()} <= set(want) and len(got) > 100
    # the true move of the ground at each corner
    truth = {r.pair_id: r for r in registration.ground_truth(spark.range(5).withColumnRenamed("id", "k")).collect()}
    h = lambda r, a, b, c: getattr(truth[r.pair], a) * r.x + getattr(truth[r.pair], b) * r.y + getattr(truth[r.pair], c)
    off = [np.hypot(h(r, "h00", "h01", "h02") - r.x - r.dx, h(r, "h10", "h11", "h12") - r.y - r.dy) for r in got.itertuples()]
    assert np.median(off) < 0.15


def test_shifts_of_frames(spark, data):
    truth = {r.pair_id: r for r in registration.ground_truth(spark.range(5).withColumnRenamed("id", "k")).collect()}
    for r in matches.r7_phase_shift(spark, data).collect():
        t = truth[r.pair]
        move = [t.h00 * 128 + t.h01 * 128 + t.h02 - 128, t.h10 * 128 + t.h11 * 128 + t.h12 - 128]
        assert abs(2 * r.dx - move[0]) < 1.5 and abs(2 * r.dy - move[1]) < 1.5
    for r in matches.r6_similarity(spark, data).collect():
        assert abs(abs(r.rotation) - np.degrees(0.012)) < 1 and abs(r.scale - 1) < 0.03 and r.response > 0.2


def test_registration_from_rasters(spark, data):
    """The transforms found from pixels alone lie within half a pixel of the true ones, on every pair."""
    px = registering._pairs(spark, data)
    points, fits = registration.registered(px, 160, 32)
    truth = {r.pair_id: r for r in registration.ground_truth(spark.range(5).withColumnRenamed("id", "k")).collect()}
    got = fits.collect()
    assert {r.pair_id for r in got} == set(truth)
    for r in got:
        h = np.array([[r[f"h{i}{j}"] for j in range(3)] for i in range(3)])
        t = truth[r.pair_id]
        for x, y in ((40, 40), (210, 40), (40, 210), (210, 210), (128, 128)):
            p = h @ [x, y, 1]
            assert np.hypot(p[0] / p[2] - (t.h00 * x + t.h01 * y + t.h02), p[1] / p[2] - (t.h10 * x + t.h11 * y + t.h12)) < 0.5
    windows = registration.windows_of(px, 160, 128)
    assert windows.groupBy("pair_id").count().agg(F.max("count")).first()[0] <= 9 and registration.windows_of(px, 160, 128, max_tiles=1, coarse=False).count() == 5
    with pytest.raises(ValueError, match="overlap"):
        registration.registered(px, 64, 64)


def test_warp_brings_the_source_to_its_reference(spark, data):
    out = registering.r21_registered_images(spark, data).where("y between 40 and 215 and x between 40 and 215").toPandas()
    assert np.corrcoef(out["value"], out["reference"].fillna(out["value"]))[0, 1] > 0.97
    plain = inputs.relation(spark, data, "frames").where("side = 0").selectExpr("pair_id as key", "y", "x", "value").join(registering._images(spark, data, 1).withColumnRenamed("value", "reference"), ["key", "y", "x"]).toPandas().dropna()
    assert abs(np.corrcoef(plain["value"], plain["reference"])[0, 1]) < 0.6


def test_cascade_composes_both_steps(spark, data):
    rows = {(r.pair_id, r.step): r for r in registering.r22_cascade(spark, data).collect()}
    truth = {r.pair_id: r for r in registration.ground_truth(spark.range(5).withColumnRenamed("id", "k")).collect()}
    assert len(rows) == 15
    for pair in range(5):
        one, two, both = (np.array([[rows[pair, s][f"h{i}{j}"] for j in range(3)] for i in range(3)]) for s in ("fine_to_middle", "middle_to_coarse", "fine_to_coarse"))
        assert np.allclose(both, two @ one / (two @ one)[2, 2], atol=0.05)
        t = truth[pair]
        p = one @ [128, 128, 1]
        assert np.hypot(p[0] / p[2] - (t.h00 * 128 + t.h01 * 128 + t.h02) / 2, p[1] / p[2] - (t.h10 * 128 + t.h11 * 128 + t.h12) / 2) < 1


def test_warping_of_nothing_and_of_flat_images(spark):
    flat = spark.createDataFrame([(1, y, x, 3.0) for y in range(20) for x in range(24)], "key long, y int, x int, value double")
    small, h, w = warping.to_common_gsd(flat, 20, 24, 1.0, 1.25)
    assert (h, w) == (16, 19) and {round(r.value, 9) for r in small.collect()} == {3.0} and small.count() == 16 * 19
    assert warping.to_common_gsd(flat, 20, 24, 1.0, 1.005)[0] is flat
    with pytest.raises(ValueError, match="finer"):
        warping.to_common_gsd(flat, 20, 24, 2.0, 1.0)
    none = spark.createDataFrame([(1, *[None] * 9), (2, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "key long, " + ", ".join(f"{c} double" for c in T.H))
    out = warping.warped(flat, none, 4, 5).toPandas()
    assert len(out) == 40 and (out["value"] == 0).all()  # no inverse, and no image


def test_nearest_against_all_distances():
    rng = np.random.default_rng(9)
    for n, m in ((1, 1), (1, 5), (70, 1), (60, 90)):
        x, y = rng.integers(0, 3, (n, 6)).astype(float), rng.integers(0, 3, (m, 6)).astype(float)
        before, matching.BLOCK = matching.BLOCK, 16
        near, d1, d2, back = matching.nearest_two(x, y)
        matching.BLOCK = before
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)).round(9)
        assert (near == d.argmin(1)).all() and (d1 == d.min(1)).all() and (back == d.argmin(0)).all()
        assert (d2 == (np.sort(d, 1)[:, 1] if m > 1 else np.inf)).all()
    for xy in (rng.uniform(0, 100, (300, 2)), np.repeat(rng.uniform(0, 9, (40, 2)), 2, 0), np.array([[0.0, 0], [1e6, 5], [1e6, 6]]), np.zeros((3, 2)), np.stack([np.arange(50.0) ** 3, np.zeros(50)], 1)):
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        assert np.allclose(thinning.nearest_distance(xy), d.min(1))
        assert np.allclose(thinning.nearest_distance(xy, ignore_zero=True), np.where(d == 0, np.inf, d).min(1))
        rank = rng.permutation(len(xy))
        assert np.allclose(thinning.nearest_distance(xy, rank), np.where(rank[None] < rank[:, None], d, np.inf).min(1))


def test_hamming_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 1 << 20, 40), rng.integers(0, 1 << 20, 70)
    side = lambda v: spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(v)], "pair_id long, id long, v long")
    d = np.array([[bin(int(x) ^ int(y)).count("1") for y in b] for x in a])
    got = {r.id: (r.near1, r.d1, r.d2) for r in matching.hamming_two_nearest(side(a), side(b)).collect()}
    assert got == {i: (int(d[i].argmin()), int(d[i].min()), int(np.sort(d[i])[1])) for i in range(40)}


def test_seams_settled_at_once_or_in_rounds(spark):
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(11)
    rows = [(int(i % 2), i, 0.0, 0.0, float(x), float(y), float(c)) for i, (x, y, c) in enumerate(zip(rng.uniform(0, 40, 120), rng.uniform(0, 40, 120), rng.integers(1, 9, 120) / 9))]
    once, rounds = (sorted(r.tp_id for r in thinning.seam_survivors(points(spark, rows), 5.0, at_once=n).collect()) for n in (10**6, 0))
    assert once == rounds and 0 < len(once) < 120


def test_local_tiles_and_their_summary(spark):
    """A tile with its own affine, one whose fit moves too far, and empty ones."""
    rows = [(0, i, x, y, x + 0.5, y, 1.0) for i, (x, y) in enumerate([(10.0, 10.0), (200.0, 30.0), (90.0, 220.0), (150.0, 120.0), (60.0, 180.0)])]
    rows += [(0, 50 + i, x, y, x + 50, y, 1.0) for i, (x, y) in enumerate([(800.0, 800.0), (900.0, 800.0), (800.0, 900.0), (950.0, 990.0)])]
    h = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)], "pair_id long, " + ", ".join(f"{c} double" for c in T.H))
    tiles = {r.tile: r for r in estimation.local_affine(points(spark, rows), h, 1024.0).collect()}
    assert len(tiles) == 16 and (tiles[0].source, tiles[0].n) == ("local", 5) and abs(tiles[0].shift - 0.5) < 1e-9 and tiles[0].rmse < 1e-9
    assert (tiles[15].source, tiles[15].n, tiles[15].rmse) == ("fallback", 4, 50.0) and tiles[5].n == 0
    s = estimation.local_summary(estimation.local_affine(points(spark, rows), h, 1024.0)).first()
    assert (s.local_tiles, s.fallback_tiles) == (1, 15) and abs(s.max_shift - 0.5) < 1e-9 and s.mean_rmse >= 25


def test_structural_band_is_the_first_component(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 6))
    rows = [(0, b, y, x, float((b + 1) * base[y, x] + 0.01 * rng.normal())) for b in range(4) for y in range(6) for x in range(6)]
    cube = spark.createDataFrame(rows, "cube_id long, band int, y int, x int, value double")
    got, shown = (spectral.structural_band(cube, s).toPandas().sort_values(["y", "x"])["value"].to_numpy() for s in (False, True))
    assert np.corrcoef(got, base.ravel())[0, 1] > 0.999
    low, high = np.percentile(got, [1, 99])
    assert np.allclose(shown, np.clip((got - low) / (high - low), 0, 1))


def test_continuum_reads_every_wavelength(spark):
    cube = spark.createDataFrame([(1, b, 0, x, v) for b in (1, 25_000) for x, v in enumerate([1.0, 2.0, 3.0] if b == 1 else [9.0, 5.0, 7.0])], "cube_id long, band int, y int, x int, value double")
    table = spark.range(25_001).selectExpr("CAST(id AS INT) AS band", "CASE id WHEN 25000 THEN 1100.0D ELSE 400.0D END AS nm")
    got = {r.x: r.value for r in spectral.continuum(cube, table).collect()}
    assert got[0] == 1 and got[1] == 0 and 0.4 < got[2] < 0.6  # band 25,000 alone is in the range


def test_flat_raster(spark):
    df = spark.createDataFrame([(1, y, x, 2.0) for y in range(3) for x in range(3)], "raster_id long, y int, x int, value double")
    r = raster.quality(df).first()
    assert (r.valid_fraction, r.extreme_fraction, r.variance, r.gradient_energy) == (1.0, 1.0, 0.0, 0.0)


def test_csv_keeps_blanks_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, " a ", None, [1.0])], "k long, s string, n double, v array<double>")
    sinks.write_csv(df, str(tmp_path / "c"))
    r = readers.read_catalog(spark, str(tmp_path / "c"), "k long, s string, n double, v string").first()
    assert (r.k, r.s, r.n, r.v) == (1, " a ", None, "[1.0]")


def test_archive_status(spark):
    from craterloom.sources import archive

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

    ok = archive.archive_status(spark, "m", "http://example.org/x", lambda *a, **k: Answer()).first()
    assert ok.available and ok.http_status == 200 and ok.message is None

    def broken(*a, **k):
        raise OSError("no network")

    bad = archive.archive_status(spark, "m", "http://example.org/x", broken).first()
    assert not bad.available and bad.http_status is None and "no network" in bad.message


def test_dataset_manifest(spark, tmp_path):
    pytest.importorskip("yaml")
    from craterloom.sources import archive

    (tmp_path / "m.yaml").write_text("datasets:\n- {id: a, mission: m, instrument: i, status: pending}\n")
    assert archive.dataset_manifest(spark, str(tmp_path / "m.yaml")).first().status == "pending"
    (tmp_path / "m.yaml").write_text("datasets:\n- {id: a}\n")
    with pytest.raises(ValueError, match="missing mission"):
        archive.dataset_manifest(spark, str(tmp_path / "m.yaml"))


def test_full_manifest(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    from craterloom.sources import archive

    def read(**fields):
        (tmp_path / "m.yaml").write_text(yaml.safe_dump({"datasets": [{k: v for k, v in fields.items() if v != "-"}]}))
        return archive.full_manifest(spark, str(tmp_path / "m.yaml"))

    whole = {f: f"a {f}" for f in archive.REQUIRED_FIELDS} | {"validation_status": "Not_tested"}
    assert len(whole) == 23 and read(**whole).first().asDict() == whole
    for f in archive.REQUIRED_FIELDS:
        with pytest.raises(ValueError, match=f"missing {f}$"):
            read(**whole | {f: "-"})
    with pytest.raises(ValueError, match="validation_status fine is none of"):
        read(**whole | {"validation_status": "fine"})


def test_find_one_fails_on_none(spark):
    from craterloom.sources import archive

    df = spark.createDataFrame([("a",), ("b",), ("B",)], "product_id string")
    assert archive.find_one(df, "A").count() == 1
    with pytest.raises(Exception, match="2 products"):
        archive.find_one(df, "b").collect()


def test_clip_and_sphere():
    from craterloom.functions.clip import clip, sphere_area_km2

    box = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert sorted(clip(box, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)])) == [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]
    assert clip(box, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]) == [] and sphere_area_km2([]) == 0.0


def test_streams_of_nothing(spark, tmp_path):
    from craterloom.streaming import catalog

    spark.createDataFrame([], "product_id string, status string").write.parquet(str(tmp_path / "in"))
    catalog.run_once(catalog.ingest(spark, str(tmp_path / "in"), "product_id string, status string"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.schema("product_id string, status string").parquet(str(tmp_path / "out")).count() == 0


def test_coverage_names_its_queries():
    """Every query that COVERAGE.md names exists, and every row with one is not said to be undone."""
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "COVERAGE.md"), encoding="utf-8") as f:
        text = f.read()
    named = {x for x in re.findall(r"`([a-z]+\d+_\w+)`", text)}
    assert named <= set(catalog_all.QUERIES)
    rows = dict(line.strip("| \n").split(" | ", 1) for line in text.splitlines() if line.startswith("| "))
    assert {x for x, y in rows.items() if y.startswith("not done")} == {"S27", "K16"}


def test_command_line():
    import craterloom.__main__ as cli

    assert cli.main(["list"]) == 0 and cli.main([]) == 2 and cli.main(["show", "nothing", "/"]) == 2


def test_ground_truth_given_in_the_wrong_shape(spark):
    from craterloom.sources import control

    four = "[[1, 2], [3, 4], [5, 6], [7, 8]]"
    docs = {
        "OK 4": f'{{"src_points": {four}, "target_points": [], "target": {four}}}', "NO_POINTS None": f'{{"source": {four}}}', "BAD_SHAPE None": f'{{"source": {four}, "target": [1, 2, 3, 4]}}',
        "BAD_SHAPE 0": f'{{"source": {four}, "target": []}}', "NO_POINTS None ": f'{{"source": {four}, "target_points": []}}', "BAD_SHAPE 4": f'{{"source": {four}, "target": [[1], [2], [3], [4]]}}',
        "TOO_FEW_POINTS 1": '{"source": [[1, 2]], "target": [[1, 2]]}', "BAD_SHAPE 0 ": '{"source": [], "target": []}',
    }
    df = spark.createDataFrame(list(docs.items()), "name string, text string")
    got = control.ground_truth(df).select("name", "verdict", F.expr("if(ref is null, null, size(ref))").alias("n")).collect()
    assert {r.name: f"{r.verdict} {r.n}" for r in got} == {n: n.strip() for n in docs}


def test_ground_truth_of_pairs_under_two_rules(spark, tmp_path):
    """Pair 86 is the first one whose document breaks the shape and holds no points."""
    from craterloom.plans import files

    rows = [(pair * 300 + i, i + 1) for pair in (5, 6, 56, 86) for i in range(5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.pair_id: (r.verdict, r.points) for r in files.s19_ground_truth(spark, str(tmp_path)).collect()}
    assert got == {5: ("BAD_SHAPE", 5), 6: ("NO_POINTS", None), 56: ("NO_POINTS", None), 86: ("BAD_SHAPE", None)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_close_pairs_at_cell_borders_are_never_broadcast(spark):
    """Spark takes points that are computed from a small file for a small table."""
    rng = np.random.default_rng(29)
    xy = np.concatenate([rng.integers(-8, 9, (150, 2)) * 12.0, rng.uniform(-90, 90, (150, 2))])
    rows = [(i % 2, i, 0.0, 0.0, float(x), float(y), float(c)) for i, ((x, y), c) in enumerate(zip(xy, rng.integers(1, 9, 300) / 9))]
    df = thinning.close_pairs(points(spark, rows), 24.0)
    assert "SortMergeJoin" in plan_of(df) and "Broadcast" not in plan_of(df)
    got = [(r.strong, r.weak) for r in df.collect()]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and (-a[6], a[1]) < (-b[6], b[1]) and np.hypot(a[4] - b[4], a[5] - b[5]) <= 24}
    assert len(got) == len(set(got)) and set(got) == want


def test_seam_suppression_is_never_broadcast(spark):
    ensure_checkpoint_dir(spark)
    df = points(spark, [(0, i, 0.0, 0.0, float(i), 0.0, float(i % 5)) for i in range(30)])
    for at_once in (10**6, 0):
        plan = plan_of(thinning.seam_survivors(df, 2.0, at_once))
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_of_products_are_dealt_over_tasks(spark):
    """A catalog's small file makes many pairs: no side is broadcast."""
    from craterloom.operators import pairing

    n = 400
    df = spark.range(n).selectExpr("id AS k", "cast(id % 20 as double) AS lon", "cast(id / 20 as double) AS lat").selectExpr("*", *(f"{c} {s} 0.6D AS {m}_{c}" for c in ("lon", "lat") for m, s in (("min", "-"), ("max", "+"))))
    df = df.selectExpr("k", "lon", "lat", *(f"if(k % 10 = 3, null, {m}_{c}) AS {m}_{c}" for c in ("lon", "lat") for m in ("min", "max")))
    df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in pairing.SIDE))
    for pairs in (pairing.overlapping_pairs(df), pairing.proximate_pairs(df)):
        assert "SortMergeJoin" in plan_of(pairs) and "Broadcast" not in plan_of(pairs)
        assert pairs.count() > 30
