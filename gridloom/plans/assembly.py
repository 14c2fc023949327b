"""Queries that assemble tables: set filters, folds of joins, descriptions, fills, tidy unions, text summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions import clean, geo
from gridloom.operators import rollup, stats
from gridloom.plans.statistics import FIN, METRICS, _wmean, r6
from gridloom.runtime import load

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH c AS (SELECT city_id FROM local_morphology_metrics WHERE city_id IS NOT NULL INTERSECT SELECT city_id FROM local_morphotypes WHERE city_id IS NOT NULL INTERSECT SELECT city_id FROM od_detour_samples WHERE city_id IS NOT NULL INTERSECT SELECT city_id FROM candidate_city)
SELECT unit_id, network_type, loaded_at, city_id FROM local_morphotypes WHERE city_id IN (SELECT city_id FROM c) AND network_type = 'drive' AND scale = 'hex_1km' AND NOT coalesce(low_confidence_flag, false)
""")
def main_analysis_rows(spark, root):
    """Units of the main analysis, in cities that all four tables know."""
    cities = reduce(DataFrame.intersect, [load(spark, root, t).where(F.col("city_id").isNotNull()).select("city_id").distinct() for t in ("local_morphology_metrics", "local_morphotypes", "od_detour_samples", "candidate_city")])
    mt = load(spark, root, "local_morphotypes").where((F.col("network_type") == "drive") & (F.col("scale") == "hex_1km") & ~clean.safe_bool(F.col("low_confidence_flag")))
    return mt.join(cities, "city_id", "left_semi").select("unit_id", "network_type", "loaded_at", "city_id")


@query("""
WITH a AS (SELECT city_id, count(*) AS metric_rows, count(*) FILTER (WHERE valid_metric) AS valid_rows FROM local_morphology_metrics GROUP BY city_id), b AS (SELECT city_id, count(*) AS units, round(sum(population_sum), 2) AS population FROM local_morphotypes GROUP BY city_id),
d AS (SELECT city_id, count(*) AS od_rows FROM od_detour_samples GROUP BY city_id), e AS (SELECT city_id, count(DISTINCT osmid) AS nodes FROM network_context GROUP BY city_id)
SELECT c.city_id, region, coalesce(metric_rows, 0) AS metric_rows, round(valid_rows::DOUBLE / nullif(metric_rows, 0), 6) AS valid_share, coalesce(units, 0) AS units, population, coalesce(od_rows, 0) AS od_rows, coalesce(nodes, 0) AS nodes,
 concat_ws(';', CASE WHEN metric_rows IS NULL THEN 'metrics' END, CASE WHEN units IS NULL THEN 'units' END, CASE WHEN od_rows IS NULL THEN 'od' END, CASE WHEN nodes IS NULL THEN 'nodes' END) AS missing_inputs
FROM candidate_city c LEFT JOIN a USING (city_id) LEFT JOIN b USING (city_id) LEFT JOIN d USING (city_id) LEFT JOIN e USING (city_id)
""")
def quality_base(spark, root):
    """Fold of left joins of per-city aggregates, with what is missing."""
    by = lambda t, *aggs: load(spark, root, t).groupBy("city_id").agg(*aggs)
    parts = [
        by("local_morphology_metrics", F.count("*").alias("metric_rows"), F.count_if("valid_metric").alias("valid_rows")),
        by("local_morphotypes", F.count("*").alias("units"), F.round(F.sum("population_sum"), 2).alias("population")),
        by("od_detour_samples", F.count("*").alias("od_rows")), by("network_context", F.count_distinct("osmid").alias("nodes")),
    ]
    j = reduce(lambda a, b: a.join(b, "city_id", "left"), parts, load(spark, root, "candidate_city").select("city_id", "region"))
    c = F.col
    return j.select(
        "city_id", "region", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("metric_rows", "units", "od_rows", "nodes")], "population", F.round(clean.safe_divide(c("valid_rows").cast("double"), c("metric_rows")), 6).alias("valid_share"),
        clean.reasons(metrics=c("metric_rows").isNull(), units=c("units").isNull(), od=c("od_rows").isNull(), nodes=c("nodes").isNull()).alias("missing_inputs"),
    )


@query(" UNION ALL ".join(f"SELECT '{m}' AS feature, count({FIN(m)}) AS n, round(avg({FIN(m)}), 6) AS mean, round(stddev_pop({FIN(m)}), 6) AS std, count({FIN(m)}) FILTER (WHERE sample_group = 'main') AS n_main, round(avg({FIN(m)}) FILTER (WHERE sample_group = 'main'), 6) AS mean_main FROM local_morphology_metrics" for m in METRICS))
def description_stats(spark, root):
    """Description of each feature over all rows and over the main sample, in one pass."""
    main = F.col("sample_group") == "main"
    m = load(spark, root, "local_morphology_metrics")
    cells = []
    for c in METRICS:
        x = clean.finite(F.col(c))
        xm = F.when(main, x)
        cells.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.count(xm).alias("n_main"), F.round(F.avg(xm), 6).alias("mean_main")))
    return m.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*")


@query("""
WITH r AS (SELECT city_id, sum(population_sum) / nullif(sum(CASE WHEN population_sum IS NOT NULL THEN unit_area_km2 END), 0) AS per_km2 FROM local_morphotypes WHERE population_sum > 0 GROUP BY city_id)
SELECT unit_id, network_type, loaded_at, round(coalesce(nullif(population_sum, 0), unit_area_km2 * per_km2), 4) AS population, CASE WHEN coalesce(population_sum, 0) = 0 THEN 'area_proxy' ELSE 'measured' END AS basis FROM local_morphotypes t LEFT JOIN r ON t.city_id IS NOT DISTINCT FROM r.city_id
""")
def area_proxy_fill(spark, root):
    """Missing or zero population filled by area and the city's density."""
    mt = load(spark, root, "local_morphotypes")
    r = mt.where(F.col("population_sum") > 0).groupBy(F.col("city_id").alias("c")).agg(clean.safe_divide(F.sum("population_sum"), F.sum("unit_area_km2")).alias("per_km2"))
    j = mt.join(r, mt["city_id"].eqNullSafe(r["c"]), "left")
    return j.select("unit_id", "network_type", "loaded_at", F.round(F.coalesce(F.nullif(F.col("population_sum"), F.lit(0.0)), F.col("unit_area_km2") * F.col("per_km2")), 4).alias("population"), F.when(F.coalesce("population_sum", F.lit(0.0)) == 0, "area_proxy").otherwise("measured").alias("basis"))


@query("""
SELECT 'tiers' AS section, quality_tier AS item, count(*) AS n, NULL::DOUBLE AS mean FROM local_morphotypes GROUP BY quality_tier UNION ALL SELECT 'types', morphotype, count(*), round(avg(type_confidence), 6) FROM local_morphotypes GROUP BY morphotype
UNION ALL SELECT 'failures', failure_reason, count(*), NULL FROM od_detour_samples WHERE failure_reason IS NOT NULL GROUP BY failure_reason
""")
def tidy_sections(spark, root):
    mt, od = load(spark, root, "local_morphotypes"), load(spark, root, "od_detour_samples")
    parts = [
        mt.groupBy(F.col("quality_tier").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("tiers")),
        mt.groupBy(F.col("morphotype").alias("item")).agg(F.count("*").alias("n"), F.round(F.avg("type_confidence"), 6).alias("mean")).withColumn("section", F.lit("types")),
        od.where(F.col("failure_reason").isNotNull()).groupBy(F.col("failure_reason").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("failures")),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("section", "item", "n", "mean")


@query(f"""
SELECT 'type' AS model, origin_morphotype AS level, NULL::VARCHAR AS other, count(*) AS n, round({_wmean('detour_ratio', 'od_pair_weight_raw')}, 6) AS mean FROM od_detour_samples WHERE origin_morphotype IS NOT NULL GROUP BY origin_morphotype
UNION ALL SELECT 'type_scale', origin_morphotype, scale, count(*), round({_wmean('detour_ratio', 'od_pair_weight_raw')}, 6) FROM od_detour_samples WHERE origin_morphotype IS NOT NULL AND scale IS NOT NULL GROUP BY origin_morphotype, scale
""")
def marginal_means(spark, root):
    od = load(spark, root, "od_detour_samples").where(F.col("origin_morphotype").isNotNull())
    aggs = [F.count("*").alias("n"), F.round(stats.weighted_mean(F.col("detour_ratio"), F.col("od_pair_weight_raw")), 6).alias("mean")]
    a = od.groupBy(F.col("origin_morphotype").alias("level")).agg(*aggs).withColumn("model", F.lit("type")).withColumn("other", F.lit(None).cast("string"))
    b = od.where(F.col("scale").isNotNull()).groupBy(F.col("origin_morphotype").alias("level"), F.col("scale").alias("other")).agg(*aggs).withColumn("model", F.lit("type_scale"))
    return a.select("model", "level", "other", "n", "mean").unionByName(b.select("model", "level", "other", "n", "mean"))


@query("""
WITH t AS (SELECT city_id, morphotype, count(*) AS n FROM local_morphotypes WHERE city_id IS NOT NULL AND morphotype IS NOT NULL GROUP BY ALL),
s AS (SELECT city_id, morphotype, round(n::DOUBLE / sum(n) OVER (PARTITION BY city_id) - (sum(n) OVER (PARTITION BY morphotype))::DOUBLE / sum(n) OVER (), 9) AS dev FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY city_id ORDER BY dev DESC, morphotype) AS i FROM s WHERE dev >= 0.1) SELECT city_id, string_agg(morphotype, ' > ' ORDER BY i) AS sentence FROM r WHERE i <= 3 GROUP BY city_id
""")
def signature_sentence(spark, root):
    """The up to three types that a city has clearly more of than all cities together, largest excess first."""
    t = load(spark, root, "local_morphotypes").where(F.col("city_id").isNotNull() & F.col("morphotype").isNotNull()).groupBy("city_id", "morphotype").agg(F.count("*").alias("n"))
    # the overall shares are one row per type, joined back, so no window spans all rows
    overall = t.groupBy(F.col("morphotype").alias("m")).agg(F.sum("n").alias("all_n"))
    total = t.agg(F.sum("n").alias("of"))
    j = t.join(overall, F.col("morphotype") == F.col("m")).crossJoin(F.broadcast(total))  # one row
    dev = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("city_id")) - F.col("all_n") / F.col("of"), 9)
    top = rollup.top_k(j.withColumn("dev", dev).where(F.col("dev") >= 0.1), ["city_id"], [F.col("dev").desc(), F.col("morphotype")], 3, "i")
    return top.groupBy("city_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "morphotype"))), lambda x: x["morphotype"]), " > ").alias("sentence"))


@query("""
SELECT osmid, network_type, built_at, CASE WHEN lon IS NULL OR isnan(lon) OR lat IS NULL OR isnan(lat) THEN 'missing' WHEN isinf(lon) OR isinf(lat) THEN 'not_finite' WHEN abs(lon) > 180 OR abs(lat) > 90 THEN 'off_globe' WHEN lon = 0 AND lat = 0 THEN 'placeholder' ELSE 'ok' END AS place FROM network_context
""")
def place_flags(spark, root):
    c = F.col
    miss = lambda x: x.isNull() | F.isnan(x)
    inf = lambda x: F.abs(x) == float("inf")
    flag = clean.choose((miss(c("lon")) | miss(c("lat")), "missing"), (inf(c("lon")) | inf(c("lat")), "not_finite"), ((F.abs("lon") > 180) | (F.abs("lat") > 90), "off_globe"), ((c("lon") == 0) & (c("lat") == 0), "placeholder"), otherwise="ok")
    return load(spark, root, "network_context").select("osmid", "network_type", "built_at", flag.alias("place"))


@query("""
WITH a AS (SELECT unit_id, network_type, loaded_at, center_lon, center_lat, sqrt(unit_area_km2) / 2 AS h FROM local_morphotypes WHERE center_lon BETWEEN -180 AND 180 AND center_lat BETWEEN -90 AND 90)
SELECT unit_id, network_type, loaded_at, greatest(0, floor((center_lon - h / 111.32 + 180) / 0.01))::INT AS first_col, greatest(0, least(36000, ceil((center_lon + h / 111.32 + 180) / 0.01))::INT - greatest(0, floor((center_lon - h / 111.32 + 180) / 0.01))::INT) AS cols FROM a
""")
def raster_windows(spark, root):
    """Pixel columns of a global 0.01 degree raster that each unit touches."""
    mt = load(spark, root, "local_morphotypes").where(F.col("center_lon").between(-180, 180) & F.col("center_lat").between(-90, 90))
    h = F.sqrt("unit_area_km2") / 2 / 111.32
    first, n = geo.pixel_window(F.col("center_lon") - h, F.col("center_lon") + h, -180.0, 0.01, 36000)
    return mt.select("unit_id", "network_type", "loaded_at", first.alias("first_col"), n.alias("cols"))


@query("""
WITH a AS (SELECT city_id, count(*) AS n, avg(detour_ratio) AS m, sum(detour_ratio * od_pair_weight_raw) / nullif(sum(CASE WHEN detour_ratio IS NOT NULL THEN od_pair_weight_raw END), 0) AS w FROM od_detour_samples GROUP BY city_id)
SELECT city_id, n, round(m, 6) AS plain, round(w, 6) AS weighted, sign(m - 1) = sign(w - 1) AS same_sign FROM a WHERE m IS NOT NULL AND w IS NOT NULL
""")
def weighted_vs_unweighted(spark, root):
    d, w = F.col("detour_ratio"), F.col("od_pair_weight_raw")
    a = load(spark, root, "od_detour_samples").groupBy("city_id").agg(F.count("*").alias("n"), F.avg(d).alias("m"), clean.safe_divide(F.sum(d * w), F.sum(F.when(d.isNotNull(), w))).alias("w"))
    return a.where(F.col("m").isNotNull() & F.col("w").isNotNull()).select("city_id", "n", r6("m", "plain"), r6("w", "weighted"), (F.signum(F.col("m") - 1) == F.signum(F.col("w") - 1)).alias("same_sign"))
