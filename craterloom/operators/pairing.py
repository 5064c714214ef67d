"""Pairs of catalog products: theta joins on spherical geometry, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from craterloom.functions import geometry as G

SIDE = ("k", "product_id", "image_path", "mission", "instrument", "status", "gsd_m", "lat", "lon", "min_lon", "max_lon", "min_lat", "max_lat", "footprint_status", "sun_az", "sun_el", "acquisition_time")


def side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in SIDE))


def overlap(df: DataFrame) -> DataFrame:
    """Overlap of the bounding boxes of sides a and b: inter_area, area_a, area_b (square degrees), overlap_ratio."""
    area = lambda p: (F.col(f"{p}_max_lon") - F.col(f"{p}_min_lon")) * (F.col(f"{p}_max_lat") - F.col(f"{p}_min_lat"))
    # nulls are kept: greatest and least would skip them
    known = F.col("a_min_lon").isNotNull() & F.col("b_min_lon").isNotNull()
    w = F.least("a_max_lon", "b_max_lon") - F.greatest("a_min_lon", "b_min_lon")
    h = F.least("a_max_lat", "b_max_lat") - F.greatest("a_min_lat", "b_min_lat")
    inter = F.when(known, F.when((w > 0) & (h > 0), w * h).otherwise(0.0))
    smaller = F.least(area("a"), area("b"))
    return df.withColumns({"inter_area": inter, "area_a": F.when(known, area("a")), "area_b": F.when(known, area("b")), "overlap_ratio": F.when(known & (smaller > 0), inter / smaller)})


def proposed(df: DataFrame, max_center_deg: float = 1.0) -> DataFrame:
    """The decision ladder of one pair: overlap_status, candidate_class, pair_status, with distances and ratios."""
    df = overlap(df)
    dist = F.sqrt(F.pow(F.col("a_lat") - F.col("b_lat"), 2) + F.pow(F.col("a_lon") - F.col("b_lon"), 2))
    ratio, both = F.col("overlap_ratio"), (F.col("a_footprint_status") == "AUTHORITATIVE") & (F.col("b_footprint_status") == "AUTHORITATIVE")
    df = df.withColumns({
        "center_deg": dist,
        "center_km": G.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")),
        "gsd_ratio": G.gsd_ratio(F.col("a_gsd_m"), F.col("b_gsd_m")),
        "solar_deg": G.solar_separation_deg(F.col("a_sun_az"), F.col("a_sun_el"), F.col("b_sun_az"), F.col("b_sun_el")),
        "seconds": G.seconds_between(F.col("a_acquisition_time"), F.col("b_acquisition_time")),
        "overlap_status": F.when(ratio <= 0, "NON_OVERLAPPING").when(ratio.isNotNull() & ~both, "OVERLAP_UNKNOWN").when(ratio.isNotNull(), "CONFIRMED_OVERLAP").otherwise("UNKNOWN"),
    })
    fine = (ratio >= 0.15) & F.coalesce(F.col("gsd_ratio") <= 320, F.lit(True))
    return df.withColumns({
        "candidate_class": F.when(ratio <= 0, "REJECTED").when(ratio.isNotNull() & ~both, "PROXIMITY_CANDIDATE").when(ratio.isNotNull(), F.when(fine, "HIGH_CONFIDENCE").otherwise("CANDIDATE_UNVERIFIED"))
        .when(F.col("center_deg").isNull(), "GEOMETRY_UNAVAILABLE").when(F.col("center_deg") > max_center_deg, "REJECTED").otherwise("PROXIMITY_CANDIDATE"),
        "pair_status": F.when(ratio <= 0, "rejected").when(ratio.isNotNull() & ~both, "proximity_candidate").when(ratio.isNotNull(), "confirmed_overlap")
        .when(F.col("center_deg").isNull(), "insufficient_metadata").when(F.col("center_deg") > max_center_deg, "rejected").otherwise("proximity_candidate"),
    })


def scored(df: DataFrame, max_km: float = 500.0, max_ratio: float = 320.0) -> DataFrame:
    """proposed() with candidate_score, is_valid and rejection (unknown overlap counts as none)."""
    df = proposed(df)
    none = (F.col("overlap_status") == "NON_OVERLAPPING") | (F.coalesce("overlap_ratio", F.lit(0.0)) <= 0)
    rejection = F.when(none, "NON_OVERLAPPING").when(F.col("center_km") > max_km, "DISTANCE_EXCEEDED").when(F.col("gsd_ratio") > max_ratio, "SCALE_INCOMPATIBLE")
    score = G.candidate_score(F.col("overlap_ratio"), F.col("solar_deg"), F.col("gsd_ratio"), F.col("overlap_status"))
    df = df.withColumn("rejection", rejection).withColumn("is_valid", F.col("rejection").isNull())
    return df.withColumn("candidate_score", F.when(F.col("is_valid"), score).otherwise(0.0))


#: Grids for boxes of any size: each is so many times coarser than the one before.
LEVELS, COARSER = 5, 4


def overlapping_cells(df: DataFrame, cell_deg: float) -> DataFrame:
    """Rows (level, cell_x, cell_y, own) for the cells of a lon/lat grid that a product's bounding box touches.

    A box's own level is the finest whose cells are at least half its size, so it owns few cells whatever its
    size; it visits those of all coarser levels too.
    """
    size = lambda level: F.lit(cell_deg) * F.pow(F.lit(float(COARSER)), level)
    extent = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"), F.lit(0.0))
    level = F.lit(LEVELS - 1)
    for i in range(LEVELS - 2, -1, -1):
        level = F.when(extent <= 2 * cell_deg * COARSER**i, i).otherwise(level)
    held = df.where("min_lon is not null").withColumn("own_level", level).withColumn("level", F.explode(F.sequence("own_level", F.lit(LEVELS - 1))))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size(F.col("level"))), F.floor(F.col(hi) / size(F.col("level"))))
    held = held.withColumn("cell_x", F.explode(span("min_lon", "max_lon"))).withColumn("cell_y", F.explode(span("min_lat", "max_lat")))
    return held.withColumn("own", F.col("level") == F.col("own_level"))


def dealt(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The equi-join of a and b, dealt over many tasks by its keys.

    A catalog's file is small for the pairs that it makes: left to Spark, one side is broadcast and the few parts of the
    file, or few shuffled ones, make all pairs.  The ladder of a pair is more than 8000 bytes of code in one method, which
    HotSpot would interpret for each pair: beyond that, Spark is told to evaluate it in several methods.
    """
    conf = a.sparkSession.conf
    conf.set("spark.sql.codegen.hugeMethodLimit", min(8000, int(conf.get("spark.sql.codegen.hugeMethodLimit"))))
    n = max(4 * a.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    return a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys)


def overlapping_pairs(products: DataFrame, cell_deg: float = 1.0) -> DataFrame:
    """Pairs a.k < b.k whose bounding boxes intersect, by an equi-join on grid cells: no product of all rows.

    A pair meets on the own level of its larger box, and is given in the one cell that holds the lower left corner of
    its intersection.  Boxes that only visit a level never meet there: turn 0 joins a's own cells with all of b's, turn 1
    those that a visits with b's own.
    """
    a, b = (side_with_cells(products, p, cell_deg) for p in "ab")
    a = a.withColumn("turn", F.when(F.col("a_own"), 0).otherwise(1))
    b = b.withColumn("turn", F.explode(F.when(F.col("b_own"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    met = dealt(a, b, ["level", "cell_x", "cell_y", "turn"])
    met = met.where("a_k < b_k and least(a_max_lon, b_max_lon) > greatest(a_min_lon, b_min_lon) and least(a_max_lat, b_max_lat) > greatest(a_min_lat, b_min_lat)")
    at = lambda lo, hi: F.floor(F.greatest(lo, hi) / (F.lit(cell_deg) * F.pow(F.lit(float(COARSER)), F.col("level"))))
    first = (at("a_min_lon", "b_min_lon") == F.col("cell_x")) & (at("a_min_lat", "b_min_lat") == F.col("cell_y"))
    return met.where(first).drop("level", "cell_x", "cell_y", "turn", "a_own", "b_own")


def side_with_cells(products: DataFrame, prefix: str, cell_deg: float) -> DataFrame:
    return overlapping_cells(products, cell_deg).select("level", "cell_x", "cell_y", F.col("own").alias(f"{prefix}_own"), *(F.col(c).alias(f"{prefix}_{c}") for c in SIDE))


def proximate_pairs(products: DataFrame, limit_deg: float = 1.0) -> DataFrame:
    """Pairs a.k < b.k of which one has no footprint and whose centres are within limit_deg (plain degrees), by grid cells.

    Products with footprints never meet each other here.
    """
    cell = lambda c: F.floor(F.col(c) / limit_deg)
    a = side(products, "a").where("a_lat is not null and a_lon is not null").withColumns({"cell_x": cell("a_lon"), "cell_y": cell("a_lat")})
    b = side(products, "b").where("b_lat is not null and b_lon is not null")
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    b = b.withColumn("cell_x", F.explode(F.transform(near, lambda i: cell("b_lon") + i))).withColumn("cell_y", F.explode(F.transform(near, lambda i: cell("b_lat") + i)))
    dist = F.sqrt(F.pow(F.col("a_lat") - F.col("b_lat"), 2) + F.pow(F.col("a_lon") - F.col("b_lon"), 2))
    # turn 0: a has no footprint, b is any product; turn 1: only b has none
    a = a.withColumn("turn", F.when(F.col("a_min_lon").isNull(), 0).otherwise(1))
    b = b.withColumn("turn", F.explode(F.when(F.col("b_min_lon").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return dealt(a, b, ["cell_x", "cell_y", "turn"]).where("a_k < b_k").where(dist <= limit_deg).drop("cell_x", "cell_y", "turn")


def candidates(products: DataFrame) -> DataFrame:
    """Every pair that the ladder does not reject outright, found without a product of all rows."""
    return overlapping_pairs(products).unionByName(proximate_pairs(products))


def discovery_counts(products: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row: products_scanned, combinations (pairs of different ids), valid_candidates, confirmed_overlaps."""
    sizes = products.groupBy("product_id").count()
    n = sizes.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("product_id") != "", F.col("count") * (F.col("count") - 1) / 2).otherwise(0)).alias("same"))
    found = ranked.agg(F.count_if("is_valid").alias("valid_candidates"), F.count_if(F.col("overlap_status") == "CONFIRMED_OVERLAP").alias("confirmed_overlaps"))
    return n.join(found).select(F.col("n").alias("products_scanned"), (F.col("n") * (F.col("n") - 1) / 2 - F.col("same")).cast("long").alias("combinations"), "valid_candidates", "confirmed_overlaps")
