"""Column functions for projection, raster cells and polygons."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model: mean earth radius in metres, and km per degree of longitude and latitude.
EARTH_R = 6371000.0
DEG2RAD = pi / 180
KM_PER_DEG_LON, KM_PER_DEG_LAT = 111.32, 110.574

RINGS = "array<array<array<struct<x:double,y:double>>>>"


def frame_of(points: DataFrame) -> DataFrame:
    """One row (lon0, lat0): the mean of the points' coordinates, origin of the local frame."""
    return points.agg(F.avg("lon").alias("lon0"), F.avg("lat").alias("lat0"))


def project_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Local equirectangular metres about (lon0, lat0)."""
    return (lon - lon0) * F.lit(DEG2RAD) * F.lit(EARTH_R) * F.cos(lat0 * F.lit(DEG2RAD)), (lat - lat0) * F.lit(DEG2RAD) * F.lit(EARTH_R)


def project(points: DataFrame, frame: DataFrame | None = None) -> DataFrame:
    """``points`` with x_m and y_m. The frame is one row, so it is broadcast whatever the input."""
    frame = frame_of(points) if frame is None else frame
    f = frame.select(F.col("lon0").alias("_lon0"), F.col("lat0").alias("_lat0"))
    x, y = project_xy(F.col("lon"), F.col("lat"), F.col("_lon0"), F.col("_lat0"))
    return points.crossJoin(F.broadcast(f)).withColumn("x_m", x).withColumn("y_m", y).drop("_lon0", "_lat0")


def cell_km2(rx: Column, ry: Column, lat: Column) -> Column:
    """Area of a cell given in degrees, at a latitude."""
    return F.abs(rx * KM_PER_DEG_LON * F.cos(lat * F.lit(DEG2RAD))) * F.abs(ry * KM_PER_DEG_LAT)


def cell_area_km2(is_geographic: Column, rx: Column, ry: Column, lat: Column, to_meter: Column) -> Column:
    """Area of a raster cell: by latitude in degrees, else by the unit's metres."""
    return F.when(is_geographic, cell_km2(rx, ry, lat)).otherwise(F.abs(rx * to_meter) * F.abs(ry * to_meter) / 1e6)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test; an edge counts from its lower end up to, not including, its upper one."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.when(i == 0, n).otherwise(i))
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + crosses(i))
    return F.when(n > 0, total % 2 == 1).otherwise(False)


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the first ring and in none of the others."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(x, y, F.element_at(rings, 1)) & ~F.exists(holes, lambda r: in_ring(x, y, r))


def in_multi_polygon(x: Column, y: Column, polygons: Column) -> Column:
    """Inside any polygon."""
    return F.exists(polygons, lambda rings: in_polygon(x, y, rings))


def ring_points(lon: Column, lat: Column, radius_m: Column, segments: int = 16) -> Column:
    """``segments`` points on a circle of ``radius_m`` metres, as an array of (x, y) in degrees."""
    d_lat = radius_m / EARTH_R / DEG2RAD
    d_lon = d_lat / F.cos(lat * DEG2RAD)
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: F.struct((lon + d_lon * F.cos(k * (2 * pi / segments))).alias("x"), (lat + d_lat * F.sin(k * (2 * pi / segments))).alias("y")))
