"""Queries of the general data problems: packed fields, points near points, keys that hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.operators import near, packed, skew
from gridloom.runtime import load


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    raw = load(spark, root, "ghs_ucdb_raw").select("raw_id", "gc_ucn_lis_2025")
    return packed.unpack(raw, "gc_ucn_lis_2025", "name_pos", "name_value").select("raw_id", "name_pos", "name_value")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    units = load(spark, root, "local_morphotypes").select("unit_id", "center_lon", "center_lat")
    nodes = load(spark, root, "network_context").select("osmid", "lon", "lat")
    pairs = near.near_pairs(units, nodes, 75.0, query_id="unit_id", point_id="osmid", query_at=("center_lon", "center_lat"))
    return pairs.select("unit_id", "osmid")


SKEWED = ("local_morphology_metrics", "od_detour_samples")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    out = None
    for src in SKEWED:
        rows = load(spark, root, src).select("city_id")
        plan = skew.plan_loads(rows, "city_id")
        counts = skew.per_key(rows, "city_id", [F.count("*").alias("n")], [F.sum("n").alias("n")], plan)
        found = counts.where(F.col("city_id").isNotNull() & (F.col("n") * 20 >= plan.rows)).select(F.lit(src).alias("src"), "city_id")
        out = found if out is None else out.unionByName(found)
    return out


P5_FOUND_SQL = " UNION ALL ".join(
    f"SELECT '{src}' AS src, city_id FROM (SELECT city_id, count(*) AS n, (SELECT count(*) FROM {src}) AS t FROM {src} GROUP BY city_id) WHERE city_id IS NOT NULL AND n * 20 >= t" for src in SKEWED
)


def p5_city_results(spark: SparkSession, root: str) -> DataFrame:
    """Per city, over all its origin-destination samples: rows, routed rows, total and mean straight distance, mean of its region's label length.

    Every sample is joined with its city's row of the metric table, itself a result per city of the largest table.
    """
    od = load(spark, root, "od_detour_samples").select("od_id", "city_id", "straight_distance_m", "route_found")
    metrics = load(spark, root, "local_morphology_metrics").select("city_id", "valid_metric", "edge_count")
    city = skew.per_key(
        metrics, "city_id",
        [F.count("*").alias("n"), F.count_if("valid_metric").alias("v"), F.sum("edge_count").alias("e")],
        [F.sum("n").alias("metric_rows"), F.sum("v").alias("valid_rows"), F.sum("e").alias("edges")],
    ).where(F.col("city_id").isNotNull())
    plan = skew.plan_loads(od, "city_id")
    joined = skew.fragment_replicate_join(od, city, "city_id", "left", plan, ["od_id"])
    return skew.per_key(
        joined, "city_id",
        [F.count("*").alias("n"), F.count_if("route_found").alias("r"), F.sum("straight_distance_m").alias("d"), F.max("metric_rows").alias("m"), F.max("valid_rows").alias("v"), F.max("edges").alias("e")],
        [F.sum("n").alias("od_rows"), F.sum("r").alias("routed_rows"), F.round(F.sum("d") / 1000.0, 3).alias("straight_km"), F.max("m").alias("metric_rows"), F.max("v").alias("valid_rows"), F.round(F.max("e"), 3).alias("edges")],
        plan, ["od_id"],
    )


P5_CITY_SQL = """
WITH m AS (SELECT city_id, count(*) AS metric_rows, count(*) FILTER (WHERE valid_metric) AS valid_rows, round(sum(edge_count), 3) AS edges
           FROM local_morphology_metrics WHERE city_id IS NOT NULL GROUP BY city_id)
SELECT o.city_id, count(*) AS od_rows, count(*) FILTER (WHERE route_found) AS routed_rows, round(sum(straight_distance_m) / 1000.0, 3) AS straight_km,
       max(metric_rows) AS metric_rows, max(valid_rows) AS valid_rows, max(edges) AS edges
FROM od_detour_samples o LEFT JOIN m ON o.city_id = m.city_id GROUP BY o.city_id
"""

P4_FOUND_SQL = """
WITH u AS (SELECT DISTINCT unit_id, center_lon AS x, center_lat AS y FROM local_morphotypes
           WHERE unit_id IS NOT NULL AND center_lon BETWEEN -180 AND 180 AND center_lat BETWEEN -90 AND 90 AND NOT (center_lon = 0 AND center_lat = 0)),
n AS (SELECT DISTINCT osmid, lon AS x, lat AS y FROM network_context
      WHERE osmid IS NOT NULL AND lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND NOT (lon = 0 AND lat = 0))
SELECT DISTINCT unit_id, osmid FROM u JOIN n ON n.y BETWEEN u.y - 0.001 AND u.y + 0.001
WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(n.y - u.y) / 2), 2) + cos(radians(n.y)) * cos(radians(u.y)) * pow(sin(radians(n.x - u.x) / 2), 2)))) <= 75.0
"""

QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p5_city_results": p5_city_results}
SQL = {"p4_found": P4_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p5_city_results": P5_CITY_SQL}
