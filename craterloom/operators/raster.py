"""Raster operators over pixels in long form (raster_id, y, x, value) and over tile windows.

Stencils are window functions along rows and columns of one raster's lines; statistics are grouped
aggregates joined back.  No operator collects a raster on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterloom.functions import photometry as P


def along_row():
    return Window.partitionBy("raster_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("raster_id", "x").orderBy("y")


def _difference(value: Column, w) -> Column:
    """Central difference along a window, one-sided at its ends."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull(), after - value).when(after.isNull(), value - before).otherwise((after - before) / 2)


def filled(pixels: DataFrame) -> DataFrame:
    """With filled: pixels without data take the raster's median."""
    median = pixels.groupBy("raster_id").agg(F.percentile("value", 0.5).alias("median"))
    return pixels.join(median, "raster_id").withColumn("filled", F.coalesce("value", "median")).drop("median")


def gradients(pixels: DataFrame, value: str = "filled") -> DataFrame:
    return pixels.withColumn("gx", _difference(F.col(value), along_row())).withColumn("gy", _difference(F.col(value), along_column()))


def sobel(pixels: DataFrame, value: str = "value", gsd: float = 1.0) -> DataFrame:
    """dzdx, dzdy by 3 x 3 Sobel over 8 * gsd; borders mirror without repeating the edge pixel."""
    def shifted(c: Column, w, n: int) -> Column:
        out = (F.lag if n < 0 else F.lead)(c, 1).over(w)
        other = (F.lead if n < 0 else F.lag)(c, 1).over(w)
        return F.coalesce(out, other, c)

    v = F.col(value)
    rows = pixels.withColumn("_dx", shifted(v, along_row(), 1) - shifted(v, along_row(), -1)).withColumn("_sx", shifted(v, along_row(), 1) + 2 * v + shifted(v, along_row(), -1))
    out = rows.withColumn("dzdx", (shifted(F.col("_dx"), along_column(), 1) + 2 * F.col("_dx") + shifted(F.col("_dx"), along_column(), -1)) / (8.0 * gsd))
    return out.withColumn("dzdy", (shifted(F.col("_sx"), along_column(), 1) - shifted(F.col("_sx"), along_column(), -1)) / (8.0 * gsd)).drop("_dx", "_sx")


def normals(pixels: DataFrame) -> DataFrame:
    n = F.sqrt(F.col("dzdx") * F.col("dzdx") + F.col("dzdy") * F.col("dzdy") + 1)
    return pixels.withColumns({"nx": -F.col("dzdx") / n, "ny": -F.col("dzdy") / n, "nz": 1 / n})


def quality(pixels: DataFrame) -> DataFrame:
    """valid_fraction, extreme_fraction, variance (of min-max scaled values) and gradient_energy of each raster."""
    g = gradients(filled(pixels))
    span = pixels.groupBy("raster_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    s = F.col("high") - F.col("low")
    scaled = (F.col("value") - F.col("low")) / F.when(s > 1e-12, s)
    extreme = ((scaled <= 0.02) | (scaled >= 0.98)).cast("int")
    slope = F.when(F.col("value").isNotNull(), F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    out = g.join(span, "raster_id").groupBy("raster_id", s.alias("span")).agg(
        (F.count("value") / F.count("*")).alias("valid_fraction"), F.avg(extreme).alias("e"), F.var_pop(scaled).alias("v"), F.avg(slope).alias("g"))
    flat = F.coalesce(F.col("span") <= 1e-12, F.lit(True))
    return out.select("raster_id", "valid_fraction", F.when(flat, 1.0).otherwise(F.col("e")).alias("extreme_fraction"), F.when(flat, 0.0).otherwise(F.col("v")).alias("variance"),
                      F.when(flat, 0.0).otherwise(F.col("g") / (F.col("span") + 1e-8)).alias("gradient_energy"))


def stretch(pixels: DataFrame, low: float = 0.01, high: float = 0.99, empty: float = 0.5) -> DataFrame:
    """Percentile stretch of each raster to [0, 1]; pixels without data become ``empty``."""
    cuts = pixels.groupBy("raster_id").agg(F.percentile("value", low).alias("_low"), F.percentile("value", high).alias("_high"))
    return pixels.join(cuts, "raster_id").withColumn("stretched", F.coalesce(P.stretched(F.col("value"), F.col("_low"), F.col("_high")), F.lit(empty))).drop("_low", "_high")


def shadow_stretch(pixels: DataFrame, dark: float = 0.05, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """With lit (above the raster's dark quantile) and stretched (between two percentiles; pixels without data null)."""
    cuts = pixels.groupBy("raster_id").agg(*(F.percentile("value", q).alias(n) for n, q in (("_dark", dark), ("_low", low), ("_high", high))))
    out = pixels.join(cuts, "raster_id").withColumn("lit", F.col("value") > F.col("_dark")).withColumn("stretched", P.stretched(F.col("value"), F.col("_low"), F.col("_high")))
    return out.drop("_dark", "_low", "_high")


def overview(pixels: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """Block averages on a size x size grid."""
    return pixels.groupBy("raster_id", F.floor(F.col("y") * size / height).cast("int").alias("oy"), F.floor(F.col("x") * size / width).cast("int").alias("ox")).agg(F.avg("value").alias("value"))


def border_strips(pixels: DataFrame, share: float = 0.98) -> DataFrame:
    """For each raster the first and last row and column that are not part of an empty border (null if all are)."""
    def lines(axis: str) -> DataFrame:
        black = F.coalesce(F.col("value") <= 0, F.lit(True)).cast("int")
        line = pixels.groupBy("raster_id", axis).agg((F.avg(black) < share).alias("used"))
        return line.where("used").groupBy("raster_id").agg(F.min(axis).alias(f"first_{axis}"), F.max(axis).alias(f"last_{axis}"))

    return pixels.select("raster_id").distinct().join(lines("y"), "raster_id", "left").join(lines("x"), "raster_id", "left")


def photometric(pixels: DataFrame, azimuth: float, elevation: float, minnaert_k: float | None = None, reference_deg: float = 30.0) -> DataFrame:
    """Intensities corrected to a reference geometry with slopes from the raster itself: cos_i, factor, corrected."""
    sx, sy, sz = P.sun_vector(F.lit(azimuth), F.lit(elevation))
    n = normals(sobel(filled(pixels), "filled"))
    cos_i = F.col("nx") * sx + F.col("ny") * sy + F.col("nz") * sz
    n = n.withColumn("cos_i", cos_i)
    model = P.lommel_seeliger if minnaert_k is None else (lambda i, e: P.minnaert(i, e, minnaert_k))
    ref = model(F.cos(F.radians(F.lit(reference_deg))), F.lit(1.0))
    got = model(F.greatest("cos_i", F.lit(0.005)), F.greatest("nz", F.lit(0.005)))
    return n.withColumn("factor", P.correction(ref, got)).withColumn("corrected", F.col("filled") * F.col("factor"))


def tile_windows(rasters: DataFrame, tile: int, step: int) -> DataFrame:
    """Windows (row_off, col_off, h, w) over rasters (raster_id, height, width), row-major; the last one ends at the border."""
    def offsets(size: str) -> Column:
        n = F.when(F.col(size) <= tile, 0).otherwise(F.ceil((F.col(size) - tile) / step))
        return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: i * step)

    rows = rasters.withColumn("row_off", F.explode(offsets("height"))).withColumn("col_off", F.explode(offsets("width")))
    return rows.select("raster_id", "row_off", "col_off", F.least(F.lit(tile), F.col("height") - F.col("row_off")).alias("h"), F.least(F.lit(tile), F.col("width") - F.col("col_off")).alias("w"))


def bilinear(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """The raster's value at each point (raster_id, point_id, px, py); missing corners weigh nothing."""
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corner = lambda dy, dx: F.struct((F.floor("py") + dy).cast("int").alias("y"), (F.floor("px") + dx).cast("int").alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
    at = points.select("raster_id", "point_id", F.explode(F.array(*(corner(dy, dx) for dy in (0, 1) for dx in (0, 1)))).alias("c")).select("raster_id", "point_id", "c.*")
    got = at.where("w > 0").join(pixels.where("value is not null"), ["raster_id", "y", "x"])
    return got.groupBy("raster_id", "point_id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
