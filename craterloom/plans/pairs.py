"""Queries on geometry and product pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from craterloom.functions import geometry as G
from craterloom.operators import pairing
from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))"
    return f"(2*1737.4*atan2(sqrt(greatest(0,least(1,{h}))),sqrt(greatest(0,least(1,1-{h})))))"


def _sun(p: str, q: str) -> str:
    dot = f"(cos(radians({p}_sun_el))*cos(radians({q}_sun_el))*(sin(radians({p}_sun_az))*sin(radians({q}_sun_az))+cos(radians({p}_sun_az))*cos(radians({q}_sun_az)))+sin(radians({p}_sun_el))*sin(radians({q}_sun_el)))"
    return f"CASE WHEN {p}_sun_az IS NULL OR {q}_sun_az IS NULL OR {p}_sun_el IS NULL OR {q}_sun_el IS NULL THEN NULL ELSE degrees(acos(greatest(-1.0,least(1.0,{dot})))) END"


_SIDES = ", ".join(f"{p}.{c} AS {p}_{c}" for p in "ab" for c in pairing.SIDE)
_TIME = "epoch(TRY_CAST({0} AS TIMESTAMPTZ))"
#: Pairs of the scenes with all the measures of the ladder.
_PAIRS = duck("scenes") + f""", crossed AS (SELECT {_SIDES} FROM scenes a JOIN scenes b ON a.k < b.k),
boxed AS (SELECT *, (a_max_lon-a_min_lon)*(a_max_lat-a_min_lat) AS area_a, (b_max_lon-b_min_lon)*(b_max_lat-b_min_lat) AS area_b,
  least(a_max_lon,b_max_lon)-greatest(a_min_lon,b_min_lon) AS w, least(a_max_lat,b_max_lat)-greatest(a_min_lat,b_min_lat) AS h, a_min_lon IS NOT NULL AND b_min_lon IS NOT NULL AS known FROM crossed),
measured AS (SELECT *, CASE WHEN known THEN CASE WHEN w > 0 AND h > 0 THEN w*h ELSE 0 END END AS inter_area,
  CASE WHEN known THEN CASE WHEN w > 0 AND h > 0 THEN w*h ELSE 0 END / least(area_a, area_b) END AS overlap_ratio,
  sqrt(pow(a_lat-b_lat,2)+pow(a_lon-b_lon,2)) AS center_deg, {_hav('a_lat', 'a_lon', 'b_lat', 'b_lon')} AS center_km,
  CASE WHEN a_gsd_m > 0 AND b_gsd_m > 0 THEN greatest(a_gsd_m,b_gsd_m)/least(a_gsd_m,b_gsd_m) END AS gsd_ratio, {_sun('a', 'b')} AS solar_deg,
  abs({_TIME.format('a_acquisition_time')}-{_TIME.format('b_acquisition_time')}) AS seconds, a_footprint_status = 'AUTHORITATIVE' AND b_footprint_status = 'AUTHORITATIVE' AS sure FROM boxed),
laddered AS (SELECT *, CASE WHEN overlap_ratio <= 0 THEN 'NON_OVERLAPPING' WHEN overlap_ratio IS NOT NULL AND NOT sure THEN 'OVERLAP_UNKNOWN' WHEN overlap_ratio IS NOT NULL THEN 'CONFIRMED_OVERLAP' ELSE 'UNKNOWN' END AS overlap_status,
  CASE WHEN overlap_ratio <= 0 THEN 'REJECTED' WHEN overlap_ratio IS NOT NULL AND NOT sure THEN 'PROXIMITY_CANDIDATE' WHEN overlap_ratio IS NOT NULL THEN CASE WHEN overlap_ratio >= 0.15 AND coalesce(gsd_ratio <= 320, true) THEN 'HIGH_CONFIDENCE' ELSE 'CANDIDATE_UNVERIFIED' END
    WHEN center_deg IS NULL THEN 'GEOMETRY_UNAVAILABLE' WHEN center_deg > 1.0 THEN 'REJECTED' ELSE 'PROXIMITY_CANDIDATE' END AS candidate_class,
  CASE WHEN overlap_ratio <= 0 THEN 'rejected' WHEN overlap_ratio IS NOT NULL AND NOT sure THEN 'proximity_candidate' WHEN overlap_ratio IS NOT NULL THEN 'confirmed_overlap'
    WHEN center_deg IS NULL THEN 'insufficient_metadata' WHEN center_deg > 1.0 THEN 'rejected' ELSE 'proximity_candidate' END AS pair_status FROM measured),
judged AS (SELECT *, CASE WHEN overlap_status = 'NON_OVERLAPPING' OR coalesce(overlap_ratio,0) <= 0 THEN 'NON_OVERLAPPING' WHEN center_km > 500 THEN 'DISTANCE_EXCEEDED' WHEN gsd_ratio > 320 THEN 'SCALE_INCOMPATIBLE' END AS rejection,
  0.40*least(1.0,coalesce(overlap_ratio,0)) + 0.25*(CASE WHEN solar_deg IS NULL THEN 0.5 WHEN solar_deg <= 90 THEN 1-solar_deg/90*0.5 ELSE greatest(0.1,1-solar_deg/180) END)
  + 0.20*(CASE WHEN gsd_ratio IS NULL THEN 0.5 WHEN gsd_ratio <= 4 THEN 1.0 WHEN gsd_ratio <= 20 THEN 0.8 WHEN gsd_ratio <= 320 THEN 0.5 ELSE 0.1 END)
  + 0.15*(CASE overlap_status WHEN 'CONFIRMED_OVERLAP' THEN 1.0 WHEN 'OVERLAP_UNKNOWN' THEN 0.6 WHEN 'NON_OVERLAPPING' THEN 0.0 ELSE 0.5 END) AS score FROM laddered)
"""


@query("M3", duck("products") + f"SELECT k, round({_hav('lat', 'lon', '0.5e0', '12.25e0')}, 6) AS km FROM products")
def m3_great_circle(spark, d):
    p = relation(spark, d, "products")
    return rounded(p.select("k", G.haversine_km(F.col("lat"), F.col("lon"), F.lit(0.5), F.lit(12.25)).alias("km")))


def _xyz(lon: str, lat: str) -> list[str]:
    return [f"cos(radians({lat}))*cos(radians({lon}))", f"cos(radians({lat}))*sin(radians({lon}))", f"sin(radians({lat}))"]


_CORNERS = [("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat")]


def _triangle(p: str, q: str, r: str) -> str:
    c = lambda i, n: f"{i}{n}"
    det = f"abs({p}x*({q}y*{r}z-{q}z*{r}y)+{p}y*({q}z*{r}x-{q}x*{r}z)+{p}z*({q}x*{r}y-{q}y*{r}x))"
    dots = "+".join("+".join(f"{c(u, n)}*{c(v, n)}" for n in "xyz") for u, v in ((p, q), (q, r), (r, p)))
    return f"2*atan2({det},greatest(1+{dots},1e-15))"


_VECTORS = ", ".join(f"{e} AS p{i}{n}" for i, (lon, lat) in enumerate(_CORNERS) for n, e in zip("xyz", _xyz(lon, lat)))


@query("M4 G18 J6", duck("products") + f", v AS (SELECT k, {_VECTORS} FROM products WHERE min_lon IS NOT NULL) SELECT k, round(({_triangle('p0', 'p1', 'p2')}+{_triangle('p0', 'p2', 'p3')})*1737.4*1737.4, 3) AS area_km2 FROM v")
def m4_polygon_area(spark, d):
    p = relation(spark, d, "products").where("min_lon is not null")
    area = G.polygon_area_km2(F.array("min_lon", "max_lon", "max_lon", "min_lon"), F.array("min_lat", "min_lat", "max_lat", "max_lat"))
    return rounded(p.select("k", area.alias("area_km2")), 3)


@query("M6 M7", duck("products") + ", c AS (SELECT k, sun_az AS a_sun_az, sun_el AS a_sun_el, 100.0e0 AS b_sun_az, 35.0e0 AS b_sun_el FROM products) SELECT k, round(" + _sun("a", "b") + ", 6) AS separation_deg, round(abs(((a_sun_az - b_sun_az + 180) % 360 + 360) % 360 - 180), 6) AS azimuth_delta FROM c")
def m6_solar_angles(spark, d):
    p = relation(spark, d, "products")
    az, el = F.col("sun_az"), F.col("sun_el")
    return rounded(p.select("k", G.solar_separation_deg(az, el, F.lit(100.0), F.lit(35.0)).alias("separation_deg"), G.azimuth_delta_deg(az, F.lit(100.0)).alias("azimuth_delta")))


@query("W4", duck("products") + """, t AS (SELECT k, lon AS l1, (lon * 3) % 360 AS l2, (lon * 7) % 360 - 180 AS l3 FROM products),
u AS (SELECT k, l1, l2, l3, l2 - 360 * (CASE WHEN l2 - l1 > 180 THEN ceil((l2 - l1 - 180) / 360) WHEN l2 - l1 < -180 THEN -ceil((l1 - l2 - 180) / 360) ELSE 0 END) AS m2 FROM t)
SELECT k, round(l1, 6) AS l1, round(m2, 6) AS l2, round(l3 - 360 * (CASE WHEN l3 - m2 > 180 THEN ceil((l3 - m2 - 180) / 360) WHEN l3 - m2 < -180 THEN -ceil((m2 - l3 - 180) / 360) ELSE 0 END), 6) AS l3 FROM u""")
def w4_longitude_unwrap(spark, d):
    p = relation(spark, d, "products")
    u = G.unwrapped(F.array(F.col("lon"), F.col("lon") * 3 % 360, F.col("lon") * 7 % 360 - 180))
    return rounded(p.select("k", u.alias("u")).select("k", *(F.get("u", F.lit(i)).alias(f"l{i + 1}") for i in range(3))))


@query("P13", duck("products") + """SELECT k, CASE WHEN min_lon IS NULL THEN 'GEOMETRY_UNAVAILABLE' WHEN greatest(abs(min_lat), abs(max_lat)) > 90 OR min_lon < -360 OR max_lon > 720 OR k % 21 = 0 THEN 'INVALID_GEOMETRY'
 WHEN footprint_status = 'AUTHORITATIVE' THEN 'VALIDATED_GEOSPATIAL' ELSE 'APPROXIMATE_GEOGRAPHIC' END AS footprint_class, min_lon IS NOT NULL AND greatest(abs(min_lat), abs(max_lat)) > 85 AS near_pole FROM products""")
def p13_footprint_class(spark, d):
    p = relation(spark, d, "products")
    n = F.when(F.col("k") % 21 == 0, 2).otherwise(4)  # some polygons have two corners
    corners = lambda *c: F.when(F.col("min_lon").isNotNull(), F.slice(F.array(*c), F.lit(1), n))
    lons, lats = corners("min_lon", "max_lon", "max_lon", "min_lon"), corners("min_lat", "min_lat", "max_lat", "max_lat")
    pole = F.col("min_lon").isNotNull() & (F.greatest(F.abs("min_lat"), F.abs("max_lat")) > 85)
    return p.select("k", G.footprint_class(lons, lats, F.col("footprint_status") == "AUTHORITATIVE").alias("footprint_class"), pole.alias("near_pole"))


@query("P4", duck("products") + """SELECT k, round_even((CAST(min_lon IS NOT NULL AS INT) + CAST(coalesce(gsd_m > 0, false) AS INT) + CAST(sun_az IS NOT NULL AND sun_el IS NOT NULL AS INT) + CAST(acquisition_time IS NOT NULL AS INT) + 1) / 5.0e0, 2) AS metadata_quality FROM products""")
def p4_metadata_quality(spark, d):
    c = F.col
    return relation(spark, d, "products").select("k", G.metadata_quality(c("min_lon"), c("gsd_m"), c("sun_az"), c("sun_el"), c("acquisition_time"), c("lat").isNotNull()).alias("metadata_quality"))


@query("J5 J6 J3 M8 M9", _PAIRS + """SELECT a_k, b_k, pair_status, candidate_class, overlap_status, round(overlap_ratio, 6) AS overlap_ratio, round(center_km, 6) AS center_km, round(gsd_ratio, 6) AS gsd_ratio,
round(solar_deg, 6) AS solar_deg, round(seconds, 3) AS seconds FROM laddered WHERE pair_status NOT IN ('rejected', 'insufficient_metadata')""")
def j5_propose_pairs(spark, d):
    found = pairing.proposed(pairing.candidates(relation(spark, d, "scenes"))).where("pair_status not in ('rejected', 'insufficient_metadata')")
    cols = ("overlap_ratio", "center_km", "gsd_ratio", "solar_deg")
    return found.select("a_k", "b_k", "pair_status", "candidate_class", "overlap_status", *(F.round(x, 6).alias(x) for x in cols), F.round("seconds", 3).alias("seconds"))


@query("J2 T4 M8", _PAIRS + """SELECT a_k, b_k, concat(a_product_id, '__', b_product_id) AS pair_id, overlap_status, rejection IS NULL AS is_valid, round(score, 6) AS candidate_score FROM judged
WHERE a_product_id <> b_product_id AND rejection IS NULL""")
def j2_discover_pairs(spark, d):
    ranked = pairing.scored(pairing.overlapping_pairs(relation(spark, d, "scenes"))).where("a_product_id <> b_product_id and is_valid")
    score = F.floor(F.col("candidate_score") * 1e6 + 0.5) / 1e6  # halves by the double, as in the SQL
    return ranked.select("a_k", "b_k", F.concat_ws("__", "a_product_id", "b_product_id").alias("pair_id"), "overlap_status", "is_valid", score.alias("candidate_score"))


@query("T4 T6", _PAIRS + """SELECT a_k, b_k, round(score, 6) AS candidate_score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, a_k, b_k) AS INT) AS rank FROM judged WHERE rejection IS NULL QUALIFY row_number() OVER (ORDER BY round(score, 6) DESC, a_k, b_k) <= 50""")
def t6_best_pairs(spark, d):
    ranked = pairing.scored(pairing.overlapping_pairs(relation(spark, d, "scenes"))).where("is_valid").withColumn("candidate_score", F.round("candidate_score", 6))
    best = ranked.select("a_k", "b_k", "candidate_score").orderBy(F.desc("candidate_score"), "a_k", "b_k").limit(50)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("candidate_score"), "a_k", "b_k")))


@query("G3", _PAIRS + """SELECT (SELECT count(*) FROM scenes) AS products_scanned, count(*) FILTER (WHERE a_product_id <> b_product_id) AS combinations, count(*) FILTER (WHERE rejection IS NULL) AS valid_candidates,
count(*) FILTER (WHERE overlap_status = 'CONFIRMED_OVERLAP') AS confirmed_overlaps FROM judged""")
def g3_discovery_counts(spark, d):
    scenes = relation(spark, d, "scenes")
    return pairing.discovery_counts(scenes, pairing.scored(pairing.overlapping_pairs(scenes)))


@query("J3 U1 U2", _PAIRS.replace("FROM scenes a JOIN scenes b ON a.k < b.k", "FROM scenes a JOIN scenes b ON a.k <> b.k") + """SELECT a_k AS source_k, b_k AS reference_k, pair_status FROM laddered
WHERE coalesce(a_mission, '') NOT IN ('LRO', 'SELENE') AND a_status IN ('validated', 'partial') AND b_mission IN ('LRO', 'SELENE') AND b_status IN ('validated', 'partial') AND pair_status NOT IN ('rejected', 'insufficient_metadata')""")
def j3_benchmark_pairs(spark, d):
    good = relation(spark, d, "scenes").where("status in ('validated', 'partial')")
    found = pairing.proposed(pairing.candidates(good)).where("pair_status not in ('rejected', 'insufficient_metadata')")
    reference = lambda p: F.coalesce(F.col(f"{p}_mission").isin("LRO", "SELENE"), F.lit(False))
    one = found.where(reference("a") != reference("b"))
    pick = lambda want: F.when(reference("a") == F.lit(want), F.col("a_k")).otherwise(F.col("b_k"))
    return one.select(pick(False).alias("source_k"), pick(True).alias("reference_k"), "pair_status")


@query("J4", _PAIRS + """SELECT a_k, b_k, pair_status, a_mission AS mission FROM laddered WHERE a_product_id <> b_product_id AND a_mission = 'LRO' AND b_mission = 'LRO' AND pair_status IN ('confirmed_overlap', 'proximity_candidate')""")
def j4_pair_catalog(spark, d):
    lro = relation(spark, d, "scenes").where("mission = 'LRO'")
    found = pairing.proposed(pairing.candidates(lro)).where("a_product_id <> b_product_id and pair_status in ('confirmed_overlap', 'proximity_candidate')")
    return found.select("a_k", "b_k", "pair_status", F.col("a_mission").alias("mission"))
