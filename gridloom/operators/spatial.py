"""Spatial joins over plain coordinates: points in polygons, segments in cells, zonal sums, nearest points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import geo
from gridloom.operators.near import nearest_points


def points_in_polygons(points: DataFrame, polygons: DataFrame, lon: str, lat: str, ring: str, cell: float = 0.25) -> DataFrame:
    """Inner join of points with the polygons (closed rings of structs lon, lat) that hold them; a point may be in several.

    Equi-join on grid cells: a polygon stands in each cell of its bounding box, a point in one; then ray casting. Rings across
    the 180th meridian, with longitudes that jump there or run on beyond it, also stand 360 degrees to the other side.
    """
    at = lambda c: F.floor(c / cell).cast("int")
    polygons = polygons.withColumn("__r", geo.unwrapped_ring(F.col(ring))).withColumn("__o", F.explode(F.array_compact(F.array(F.lit(0.0), F.when(F.array_max(F.transform("__r", lambda p: p["lon"])) > 180, F.lit(-360.0)), F.when(F.array_min(F.transform("__r", lambda p: p["lon"])) < -180, F.lit(360.0))))))
    polygons = polygons.withColumn("__r", F.transform("__r", lambda p: F.struct((p["lon"] + F.col("__o")).alias("lon"), p["lat"].alias("lat"))))
    xs, ys = F.transform("__r", lambda p: p["lon"]), F.transform("__r", lambda p: p["lat"])
    cells = polygons.withColumn("__cx", F.explode(F.sequence(at(F.array_min(xs)), at(F.array_max(xs))))).withColumn("__cy", F.explode(F.sequence(at(F.array_min(ys)), at(F.array_max(ys)))))
    placed = points.withColumn("__cx", at(F.col(lon))).withColumn("__cy", at(F.col(lat)))
    return placed.join(cells, ["__cx", "__cy"]).where(geo.point_in_ring(F.col(lon), F.col(lat), F.col("__r"))).drop("__cx", "__cy", "__r", "__o")


def zonal(points: DataFrame, zones: DataFrame, lon: str, lat: str, ring: str, zone: str, value: Column) -> DataFrame:
    """Per zone: pixels, valid pixels, sum, mean, min, max of the values inside; zones without pixels have 0 pixels and status no_overlap."""
    inside = points_in_polygons(points.withColumn("__v", value), zones.select(zone, ring), lon, lat, ring)
    got = inside.groupBy(zone).agg(F.count("*").alias("pixels"), F.count("__v").alias("valid_pixels"), F.sum("__v").alias("sum"), F.avg("__v").alias("mean"), F.min("__v").alias("min"), F.max("__v").alias("max"))
    out = zones.select(zone).distinct().join(got, zone, "left").fillna(0, ["pixels", "valid_pixels"])
    return out.withColumn("status", F.when(F.col("pixels") == 0, "no_overlap").when(F.col("valid_pixels") == 0, "no_data").otherwise("ok"))


def clip_to_cells(segments: DataFrame, x0: str, y0: str, x1: str, y1: str, cell: float) -> DataFrame:
    """Each segment cut by a square grid: rows (cx, cy, part), part = share of its length in the cell, parts of no length left out.

    The segment x0 + t dx is inside of a box for t in an interval; in each column of its bounding box only the boxes that the
    segment passes there are tried, so long segments cost their length, not their box.
    """
    lo = lambda a, b: F.floor(F.least(a, b) / cell).cast("int")
    hi = lambda a, b: F.floor(F.greatest(a, b) / cell).cast("int")

    def interval(a: str, b: str, k: str) -> tuple[Column, Column]:
        d = F.col(b) - F.col(a)
        t0, t1 = (F.col(k) * cell - F.col(a)) / F.nullif(d, F.lit(0.0)), ((F.col(k) + 1) * cell - F.col(a)) / F.nullif(d, F.lit(0.0))
        return F.when(d == 0, F.lit(0.0)).otherwise(F.least(t0, t1)), F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(t0, t1))

    s = segments.withColumn("cx", F.explode(F.sequence(lo(F.col(x0), F.col(x1)), hi(F.col(x0), F.col(x1)))))
    (a0, a1), (b0, b1) = interval(x0, x1, "cx"), interval(y0, y1, "cy")
    at = lambda t: F.col(y0) + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (F.col(y1) - F.col(y0))
    slack = 1e-9  # degrees: rounding at a corner
    s = s.withColumn("cy", F.explode(F.sequence(lo(at(a0) - slack, at(a1) - slack), hi(at(a0) + slack, at(a1) + slack))))
    part = F.least(F.lit(1.0), a1, b1) - F.greatest(F.lit(0.0), a0, b0)
    return s.withColumn("part", part).where(F.col("part") > 0)


def nearest(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, query_at: tuple[str, str], point_at: tuple[str, str]) -> DataFrame:
    """(query id, point id, distance_m) of the nearest point of each query, see `near.nearest_points`."""
    return nearest_points(queries, points, query_id=query_id, point_id=point_id, query_at=query_at, point_at=point_at)
