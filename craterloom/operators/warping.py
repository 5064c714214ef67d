"""Image geometry over pixels in long form: warp, remap, resampling to a common ground sample distance, orthorectification.

Every output pixel finds its four source pixels by one equi-join; no task holds an image.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterloom.functions import transforms as T
from craterloom.operators.kernels import gaussian_kernel


def remapped(places: DataFrame, pixels: DataFrame, empty: float = 0.0) -> DataFrame:
    """key, y, x, value: at each place (key, y, x, u, v) the bilinear value of that key's image at column u, row v.

    What lies outside the image, or has no data, counts as ``empty``; a null u or v gives ``empty``.
    """
    fu, fv = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
    corner = lambda j, i: F.struct((F.floor("v") + j).cast("int").alias("sy"), (F.floor("u") + i).cast("int").alias("sx"), ((fv if j else 1 - fv) * (fu if i else 1 - fu)).alias("w"))
    at = places.select("key", "y", "x", F.explode(F.array(*(corner(j, i) for j in (0, 1) for i in (0, 1)))).alias("c")).select("key", "y", "x", "c.*")
    source = pixels.select("key", F.col("y").alias("sy"), F.col("x").alias("sx"), "value")
    value = F.when(F.col("w") > 0, F.col("w") * F.coalesce("value", F.lit(empty))).otherwise(F.lit(0.0))
    out = at.join(source, ["key", "sy", "sx"], "left").groupBy("key", "y", "x").agg(F.sum(value).alias("value"))
    return out.withColumn("value", F.coalesce("value", F.lit(empty)))


def grid(keys: DataFrame, height: Column, width: Column) -> DataFrame:
    """All places y, x of an image of this size for each row of keys."""
    of = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    return keys.where((height > 0) & (width > 0)).withColumn("y", of(height)).withColumn("x", of(width))


def warped(pixels: DataFrame, transforms: DataFrame, height: int, width: int) -> DataFrame:
    """Source images (key, y, x, value) drawn in the reference's frame: key, y, x, value.

    transforms: key and h00 .. h22, source to reference.  A pixel of the result shows the place that the inverse leads to.
    """
    back = transforms.select("key", *(c.alias(name) for name, c in T.inverse().items()))
    at = grid(back, F.lit(height), F.lit(width))
    u, v = T.applied(F.col("x"), F.col("y"))
    return remapped(at.select("key", "y", "x", F.round(u, 9).alias("u"), F.round(v, 9).alias("v")), pixels)


def _mirrored(axis: str, shift: int, size: Column) -> Column:
    """The place that stands in for ``axis + shift``: mirrored at the border without repeating the edge."""
    period = F.greatest(F.lit(1), 2 * size - 2)
    at = F.pmod(F.abs(F.col(axis) + shift), period)
    return F.when(at >= size, 2 * size - 2 - at).otherwise(at)


def blurred(pixels: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur of 2 * ceil(2 sigma) + 1 weights along rows, then along columns; borders mirrored.

    A pixel hands its weighted value to the pixels around it, as often as mirroring asks for, and these add up.
    """
    k = [float(w) for w in gaussian_kernel(sigma)]
    r = len(k) // 2
    for axis in ("x", "y"):
        size = F.max(axis).over(Window.partitionBy("key")) + 1
        lines = pixels.withColumn("size", size)
        # the pixel at p takes from mirrored(p + d): as an array of values along the line
        line, other = ("y", "x") if axis == "x" else ("x", "y")
        held = lines.groupBy("key", line).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "value"))), lambda s: s.value).alias("line"), F.first("size").alias("size"))
        n = F.col("size")

        def mixed(i: Column) -> Column:
            period = F.greatest(F.lit(1), 2 * n - 2)
            out = None
            for d, w in zip(range(-r, r + 1), k):
                at = F.pmod(F.abs(i + d), period)
                term = F.element_at("line", F.when(at >= n, 2 * n - 2 - at).otherwise(at).cast("int") + 1) * w
                out = term if out is None else out + term
            return out

        pixels = held.select("key", line, F.posexplode(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), mixed)).alias(axis, "value")).select("key", "y", "x", "value")
    return pixels


def area_resized(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Smaller images: each new pixel is the mean over the area that it covers, part pixels by their part."""
    def shares(axis: str, ratio: float) -> Column:
        first = F.floor(F.col(axis) / ratio)
        last = F.ceil((F.col(axis) + 1) / ratio) - 1
        over = lambda o: F.least(F.col(axis) + 1, (o + 1) * ratio) - F.greatest(F.col(axis), o * ratio)
        return F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda o: F.struct(o.alias("o"), over(o).alias("w")))

    ry, rx = height / new_height, width / new_width
    dealt = pixels.withColumn("cy", F.explode(shares("y", ry))).withColumn("cx", F.explode(shares("x", rx)))
    w = F.col("cy.w") * F.col("cx.w")
    dealt = dealt.where((F.col("cy.w") > 1e-9) & (F.col("cx.w") > 1e-9) & (F.col("cy.o") < new_height) & (F.col("cx.o") < new_width))
    return dealt.groupBy("key", F.col("cy.o").alias("y"), F.col("cx.o").alias("x")).agg((F.sum(w * F.col("value")) / F.sum(F.when(F.col("value").isNotNull(), w))).alias("value"))


def to_common_gsd(fine: DataFrame, height: int, width: int, fine_gsd: float, coarse_gsd: float) -> tuple[DataFrame, int, int]:
    """The finer images on the coarser ones' pixels: blurred by the half excess of the ratio, then area-resized (16 pixels at least)."""
    ratio = coarse_gsd / fine_gsd
    if abs(ratio - 1) <= 1e-2 + 1e-5:
        return fine, height, width
    if ratio < 1:
        raise ValueError("the first images must be the finer ones")
    h, w = (max(16, round(n / ratio)) for n in (height, width))
    return area_resized(blurred(fine, max(0.5, (ratio - 1) * 0.5)), height, width, h, w), h, w


def orthorectified(pixels: DataFrame, dem: DataFrame, camera: dict[str, float], pixel_size: float, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Images on the grid of an elevation model: key, y, x, value, parallax (pixels by which relief moved the place).

    dem: key, y, x, z; camera: focal length f, principal point cx, cy, position x, y, z, looking straight down.
    The datum of the parallax is the median elevation; places that the camera does not see are 0 with a null parallax.
    """
    held = dem.join(dem.groupBy("key").agg(F.percentile("z", 0.5).alias("datum")), "key").withColumn("z", F.coalesce("z", "datum"))

    def seen(z: Column) -> tuple[Column, Column]:
        depth = F.lit(camera["z"]) - z
        ok = depth > 1e-6
        x, y = origin[0] + F.col("x") * pixel_size, origin[1] + F.col("y") * pixel_size
        return F.when(ok, camera["cx"] + camera["f"] * (x - camera["x"]) / depth), F.when(ok, camera["cy"] + camera["f"] * (y - camera["y"]) / depth)

    (u, v), (pu, pv) = seen(F.col("z")), seen(F.col("datum"))
    at = held.select("key", "y", "x", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"), F.sqrt(F.pow(u - pu, 2) + F.pow(v - pv, 2)).alias("parallax"))
    return remapped(at, pixels).join(at.select("key", "y", "x", "parallax"), ["key", "y", "x"])


def parallax_report(ortho: DataFrame, dem: DataFrame) -> DataFrame:
    """For each key: datum, relief, largest and mean parallax."""
    heights = dem.groupBy("key").agg(F.percentile("z", 0.5).alias("datum"), (F.max("z") - F.min("z")).alias("relief"))
    moved = ortho.groupBy("key").agg(F.coalesce(F.max("parallax"), F.lit(0.0)).alias("max_parallax"), F.coalesce(F.avg("parallax"), F.lit(0.0)).alias("mean_parallax"))
    return heights.join(moved, "key")


def steps(start: Column, stop: Column, size: Column, tile: int, step: int) -> Column:
    """Offsets of tiles that cover [start, stop) of an axis of this size; the last one reaches the stop or the border."""
    n = F.greatest(F.lit(0), F.ceil((F.least(stop, size) - tile - start) / step))
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: start + i * step)


def roi_windows(rasters: DataFrame, tile: int, step: int, max_tiles: int | None = None) -> DataFrame:
    """Windows (all columns of rasters and row_off, col_off, h, w, number) over each raster's region of interest.

    rasters: height, width, min_x, min_y, max_x, max_y.  The region is clamped to the raster; one without an area,
    before or after that, has no windows (``roi_problem`` says why).  max_tiles: so many in row-major order.
    """
    clamp = lambda c, size: F.greatest(F.lit(0), F.least(F.col(c), F.col(size))).cast("int")
    held = rasters.where(roi_problem().isNull()).withColumns({"x0": clamp("min_x", "width"), "x1": clamp("max_x", "width"), "y0": clamp("min_y", "height"), "y1": clamp("max_y", "height")})
    held = held.withColumn("row_off", F.explode(steps(F.col("y0"), F.col("y1"), F.col("height"), tile, step))).withColumn("col_off", F.explode(steps(F.col("x0"), F.col("x1"), F.col("width"), tile, step)))
    per_row = F.size(steps(F.col("x0"), F.col("x1"), F.col("width"), tile, step))
    number = ((F.col("row_off") - F.col("y0")) / step).cast("int") * per_row + ((F.col("col_off") - F.col("x0")) / step).cast("int")
    out = held.select(*rasters.columns, "row_off", "col_off", F.least(F.lit(tile), F.col("height") - F.col("row_off")).alias("h"), F.least(F.lit(tile), F.col("width") - F.col("col_off")).alias("w"), number.alias("number"))
    return out if max_tiles is None else out.where(F.col("number") < max_tiles)


def roi_problem() -> Column:
    """Why a region of interest has no windows, or null."""
    c = F.col
    outside = (F.least(c("max_x"), c("width")) <= F.greatest(c("min_x"), F.lit(0))) | (F.least(c("max_y"), c("height")) <= F.greatest(c("min_y"), F.lit(0)))
    return (F.when((c("width") <= 0) | (c("height") <= 0) | c("width").isNull() | c("height").isNull(), "EMPTY_IMAGE")
            .when((c("min_x") >= c("max_x")) | (c("min_y") >= c("max_y")), "EMPTY_ROI").when(outside, "ROI_OUTSIDE_IMAGE"))


def coarse_roi(tile: int = 1024) -> dict[str, Column]:
    """min_x, min_y, max_x, max_y of the overlap in the reference, from dx, dy, scale, confidence and the sizes of both rasters."""
    c = F.col
    whole = lambda x: F.rint(x).cast("long")
    sure = c("confidence") > 0.15
    low = lambda d: F.greatest(F.lit(0), whole(F.when(sure, c(d)).otherwise(F.least(F.lit(0.0), c(d)))))
    high = lambda d, ref, src: F.least(c(ref), whole(F.when(sure, c(src) * c("scale") + c(d)).otherwise(c(ref) + F.greatest(F.lit(0.0), c(d)))))
    box = {"min_x": low("dx"), "min_y": low("dy"), "max_x": high("dx", "ref_w", "src_w"), "max_y": high("dy", "ref_h", "src_h")}
    small = (box["max_x"] - box["min_x"] < tile // 2) | (box["max_y"] - box["min_y"] < tile // 2)
    full = {"min_x": F.lit(0), "min_y": F.lit(0), "max_x": c("ref_w"), "max_y": c("ref_h")}
    return {k: F.when(small, full[k]).otherwise(v).cast("long") for k, v in box.items()}


def source_windows(windows: DataFrame, tile: int) -> DataFrame:
    """Windows with the source's window (src_row, src_col, src_h, src_w) at the coarse offset, clamped; those under 64 pixels go.

    windows: row_off, col_off, h, w, dx, dy, confidence, src_h_all, src_w_all.
    """
    c = F.col
    at = lambda off, d, size: F.greatest(F.lit(0), F.least(c(size) - tile // 4, F.rint(F.when(c("confidence") > 0.20, c(off) - c(d)).otherwise(c(off))).cast("int")))
    held = windows.withColumn("src_col", at("col_off", "dx", "src_w_all")).withColumn("src_row", at("row_off", "dy", "src_h_all"))
    held = held.withColumn("src_w", F.least(c("w"), c("src_w_all") - c("src_col"))).withColumn("src_h", F.least(c("h"), c("src_h_all") - c("src_row")))
    return held.where((c("src_w") >= 64) & (c("src_h") >= 64))


def overview_size(height: int, width: int, size: int = 512) -> int:
    return min(size, height, width, 1 << int(math.log2(max(1, min(height, width)))))
