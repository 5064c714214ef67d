"""The engine's scalar functions under SQL names, as temporary SQL functions of a session (no Python in them)."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "crater_distance_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 1737.4 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "crater_azimuth_delta": ("a DOUBLE, b DOUBLE", "DOUBLE", "abs(pmod(a - b + 180, 360.0D) - 180)"),
    "crater_gsd_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a > 0 AND b > 0 THEN greatest(a, b) / least(a, b) END"),
    "crater_bic": ("n BIGINT, rmse DOUBLE, k INT", "DOUBLE", "n * ln(rmse * rmse + 1e-6) + k * ln(greatest(n, 1))"),
    "crater_grid_cell": ("x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, grid INT", "INT",
        "CAST(greatest(0, least(grid - 1, floor(y / (height / grid)))) * grid + greatest(0, least(grid - 1, floor(x / (width / grid)))) AS INT)"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
