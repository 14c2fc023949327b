"""Queries of cluster descriptions, package checks, harvests of warnings and logs of anomalies, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gridloom.functions import clean
from gridloom.operators import model, ranks, rollup, signature, stats
from gridloom.plans.statistics import FIN, METRICS, W, r6
from gridloom.runtime import load

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_Z = [f"{m}_z" for m in METRICS]


@query(f"""
WITH c AS (SELECT morphotype, {', '.join(f"avg({FIN(z)}) AS {z}" for z in _Z)} FROM local_morphotypes WHERE morphotype IS NOT NULL GROUP BY morphotype),
l AS ({' UNION ALL '.join(f"SELECT morphotype, '{z}' AS feature, {z} AS centre FROM c" for z in _Z)}), t AS (SELECT morphotype, sum(abs(centre)) AS total FROM l GROUP BY morphotype)
SELECT l.morphotype, feature, round(centre, 6) + 0.0 AS centre, round(abs(centre) / nullif(total, 0), 6) AS contribution, row_number() OVER (PARTITION BY l.morphotype ORDER BY abs(centre) DESC NULLS LAST, feature) AS feature_rank FROM l JOIN t USING (morphotype)
""")
def cluster_centres(spark, root):
    """Centre of each type in every standardised feature, the feature's share of the centre and its rank by size."""
    u = load(spark, root, "local_morphotypes").where(F.col("morphotype").isNotNull())
    wide = u.groupBy("morphotype").agg(*[F.avg(clean.finite(F.col(z))).alias(z) for z in _Z])
    long = wide.unpivot(["morphotype"], _Z, "feature", "centre")
    total = long.groupBy("morphotype").agg(F.sum(F.abs("centre")).alias("total"))
    ranked = signature.rank_features(long.join(total, "morphotype"), ["morphotype"], "centre", "feature", "feature_rank")  # 17 rows a type
    return ranked.select("morphotype", "feature", r6("centre", "centre"), F.round(clean.safe_divide(F.abs("centre"), F.col("total")), 6).alias("contribution"), F.col("feature_rank").cast("long").alias("feature_rank"))


@query(f"""
WITH c AS (SELECT morphotype, avg({FIN(_Z[0])}) AS d, count(*) AS units FROM local_morphotypes WHERE morphotype IS NOT NULL GROUP BY morphotype)
SELECT morphotype, units, 'T' || lpad(row_number() OVER (ORDER BY d DESC NULLS LAST, morphotype)::VARCHAR, 2, '0') AS relabelled FROM c
""")
def cluster_relabel(spark, root):
    """Types numbered anew by the order of a descriptor, densest first."""
    c = load(spark, root, "local_morphotypes").where(F.col("morphotype").isNotNull()).groupBy("morphotype").agg(F.avg(clean.finite(F.col(_Z[0]))).alias("d"), F.count("*").alias("units"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("d"), "morphotype"))  # one row a type
    return c.select("morphotype", "units", F.concat(F.lit("T"), F.lpad(place.cast("string"), 2, "0")).alias("relabelled"))


@query("SELECT coalesce(max(morphotype) FILTER (WHERE morphotype = 'MT01'), min(morphotype)) AS reference FROM local_morphotypes")
def reference_level(spark, root):
    """The level that contrasts refer to: the preferred one if it occurs, else the first."""
    ref = model.choose_reference(load(spark, root, "local_morphotypes"), "morphotype", "MT01")
    return spark.range(1).select(F.lit(ref).cast("string").alias("reference"))


_SCALES = ("full_city", "core_5km", "hex_2km", "hex_1km")


@query("SELECT city_id, " + ", ".join(f"count(DISTINCT CASE WHEN scale = '{s}' THEN unit_id END) AS {s}_units, count(*) FILTER (WHERE scale = '{s}' AND coalesce(valid_metric, false)) AS {s}_valid, round(avg(CASE WHEN scale = '{s}' THEN {FIN('valid_area_ratio')} END), 6) AS {s}_area_ratio" for s in _SCALES) + " FROM local_morphology_metrics GROUP BY city_id")
def spatial_qc(spark, root):
    """Per city and scale, wide: units, valid rows, mean share of valid area. Units are counted once before the city's counts are added up."""
    m = load(spark, root, "local_morphology_metrics")
    per = m.groupBy("city_id", "scale", "unit_id").agg(F.count_if("valid_metric").alias("v"), F.sum(clean.finite(F.col("valid_area_ratio"))).alias("a"), F.count(clean.finite(F.col("valid_area_ratio"))).alias("n"))
    at = lambda s, c: F.when(F.col("scale") == s, c)
    return per.groupBy("city_id").agg(*[x for s in _SCALES for x in (
        F.count(at(s, F.col("unit_id"))).alias(f"{s}_units"), F.coalesce(F.sum(at(s, F.col("v"))), F.lit(0)).alias(f"{s}_valid"),
        F.round(clean.safe_divide(F.sum(at(s, F.col("a"))), F.sum(at(s, F.col("n"))).cast("double")), 6).alias(f"{s}_area_ratio"),
    )])


_ANOMALIES = {
    "missing_city": ("error", "city_id IS NULL", "unit_id"), "value_not_finite": ("warning", "NOT isfinite(segment_length_median) OR NOT isfinite(edge_circuity_mean)", "unit_id"),
    "low_area_ratio": ("info", "valid_area_ratio < 0.5", "unit_id"), "no_edges": ("warning", "edge_count = 0", "unit_id"),
}


@query(" UNION ALL ".join(f"SELECT network_type, scale, '{n}' AS anomaly_type, '{sev}' AS severity, count(*) AS affected_count, min({x}) AS sample_value FROM local_morphology_metrics WHERE {w} GROUP BY network_type, scale" for n, (sev, w, x) in _ANOMALIES.items()))
def anomaly_log(spark, root):
    """Anomalies per network and scale with the number of rows and one of them, all kinds in one pass."""
    m = load(spark, root, "local_morphology_metrics")
    far = lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    cond = {"missing_city": F.col("city_id").isNull(), "value_not_finite": far("segment_length_median") | far("edge_circuity_mean"), "low_area_ratio": F.col("valid_area_ratio") < 0.5, "no_edges": F.col("edge_count") == 0}
    tags = F.array_compact(F.array(*[F.when(cond[n], F.struct(F.lit(n).alias("t"), F.lit(sev).alias("s"))) for n, (sev, _, _) in _ANOMALIES.items()]))
    hit = m.select("network_type", "scale", "unit_id", F.explode(tags).alias("a"))
    return hit.groupBy("network_type", "scale", F.col("a.t").alias("anomaly_type"), F.col("a.s").alias("severity")).agg(F.count("*").alias("affected_count"), F.min("unit_id").alias("sample_value"))


_TABLES = {"local_morphotypes": ("unit_id", "network_type"), "od_detour_samples": ("od_id",), "network_context": ("osmid", "network_type"), "local_morphology_metrics": ("unit_id", "network_type", "scale", "run_id")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", 'unique_key' AS \"check\", coalesce(sum(n - 1), 0)::BIGINT AS value, 0::BIGINT AS expected, CASE WHEN coalesce(sum(n - 1), 0) = 0 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT count(*) AS n FROM {t} GROUP BY {', '.join(k)}) UNION ALL SELECT '{t}', 'known_city', count(DISTINCT city_id), count(DISTINCT city_id) FILTER (WHERE city_id IN (SELECT city_id FROM candidate_city)), CASE WHEN count(DISTINCT city_id) = count(DISTINCT city_id) FILTER (WHERE city_id IN (SELECT city_id FROM candidate_city)) THEN 'pass' ELSE 'fail' END FROM {t}" for t, k in _TABLES.items()))
def package_checks(spark, root):
    """Checks of the delivered tables: repeated keys, and cities that the list of cities has."""
    parts = []
    known = load(spark, root, "candidate_city").select("city_id").distinct().withColumn("known", F.lit(True))
    for t, k in _TABLES.items():
        df = load(spark, root, t)
        extra = df.groupBy(*k).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value")).select(F.lit(t).alias("table"), F.lit("unique_key").alias("check"), "value", F.lit(0).cast("long").alias("expected"))
        cities = df.select("city_id").where(F.col("city_id").isNotNull()).distinct().join(known, "city_id", "left").agg(F.count("*").alias("value"), F.count("known").alias("expected")).select(F.lit(t).alias("table"), F.lit("known_city").alias("check"), "value", "expected")
        parts += [extra, cities]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("value") == F.col("expected"), "pass").otherwise("fail"))


@query("""
WITH w AS (SELECT 'local_morphotypes' AS source, anomaly_reason AS warning, city_id FROM local_morphotypes UNION ALL SELECT 'od_detour_samples', failure_reason, city_id FROM od_detour_samples
 UNION ALL SELECT 'local_morphology_metrics', validity_note, city_id FROM local_morphology_metrics WHERE NOT coalesce(valid_metric, false))
SELECT source, trim(warning) AS warning, count(*) AS rows, count(DISTINCT city_id) AS cities FROM w WHERE trim(warning) <> '' GROUP BY source, trim(warning)
""")
def warning_harvest(spark, root):
    """Warnings of all upstream tables in one list, with rows and cities. Cities are told apart before they are counted."""
    one = lambda t, c, ok=None: (load(spark, root, t) if ok is None else load(spark, root, t).where(ok)).select(F.lit(t).alias("source"), F.trim(c).alias("warning"), "city_id")
    w = one("local_morphotypes", "anomaly_reason").unionByName(one("od_detour_samples", "failure_reason")).unionByName(one("local_morphology_metrics", "validity_note", ~F.coalesce("valid_metric", F.lit(False))))
    return w.where(F.col("warning") != "").groupBy("source", "warning", "city_id").agg(F.count("*").alias("n")).groupBy("source", "warning").agg(F.sum("n").alias("rows"), F.count("city_id").alias("cities"))


@query("""
WITH m AS (SELECT city_id, count(DISTINCT run_id) AS runs, count(*) FILTER (WHERE coalesce(valid_metric, false)) AS valid FROM local_morphology_metrics GROUP BY city_id)
SELECT c.city_id, coalesce(runs, 0) AS runs, CASE WHEN runs IS NULL THEN 'not_started' WHEN valid = 0 THEN 'failed' WHEN runs < 4 THEN 'partial' ELSE 'already_complete' END AS state FROM candidate_city c LEFT JOIN m ON c.city_id = m.city_id
""")
def build_status(spark, root):
    """State of each city's build by the runs that were delivered: what is complete, partial, failed or to be started."""
    m = load(spark, root, "local_morphology_metrics").groupBy("city_id", "run_id").agg(F.count_if("valid_metric").alias("v")).groupBy("city_id").agg(F.count("run_id").alias("runs"), F.sum("v").alias("valid"))
    state = F.when(F.col("runs").isNull(), "not_started").when(F.col("valid") == 0, "failed").when(F.col("runs") < 4, "partial").otherwise("already_complete")
    return load(spark, root, "candidate_city").select("city_id").join(m, "city_id", "left").select("city_id", F.coalesce("runs", F.lit(0)).alias("runs"), state.alias("state"))


@query(f"""
WITH g AS (SELECT city_id, network_type, {FIN('betweenness_gini')} AS x, {W('population_sum')} AS w FROM local_morphotypes), s AS (SELECT * FROM g WHERE x IS NOT NULL),
r AS (SELECT city_id, network_type, x, w, sum(x * w) OVER (PARTITION BY city_id, network_type ORDER BY x, w ROWS UNBOUNDED PRECEDING) AS b FROM s),
q AS (SELECT city_id, network_type, CASE WHEN sum(w) <= 0 THEN NULL WHEN sum(x * w) <= 0 THEN 0 ELSE 1 - sum(w * (2 * b - x * w)) / (sum(w) * sum(x * w)) END AS gini FROM r GROUP BY ALL),
a AS (SELECT city_id, network_type, count(*) AS units, sum({W('population_sum')}) AS p, sum(CASE WHEN NOT coalesce(valid_metric, false) THEN {W('population_sum')} ELSE 0 END) AS none, max(metric_missing_count) AS most_missing FROM local_morphotypes GROUP BY ALL)
SELECT a.city_id, a.network_type, units, round(gini, 6) AS gini, round(none / nullif(p, 0), 6) AS none_share, most_missing FROM a LEFT JOIN q ON a.city_id IS NOT DISTINCT FROM q.city_id AND a.network_type IS NOT DISTINCT FROM q.network_type
""")
def inequality_bundle(spark, root):
    """Per city and network: weighted Gini, share of the population without a valid value, most missing metrics."""
    u, keys = load(spark, root, "local_morphotypes"), ["city_id", "network_type"]
    p = stats.positive(F.col("population_sum"))
    a = u.groupBy(*keys).agg(F.count("*").alias("units"), F.sum(p).alias("p"), F.sum(F.when(F.coalesce("valid_metric", F.lit(False)), 0.0).otherwise(p)).alias("none"), F.max("metric_missing_count").alias("most_missing"))
    g = stats.weighted_gini(u, keys, "betweenness_gini", "population_sum")
    return ranks.null_safe(a, g, keys, "left").select(*keys, "units", F.round("gini", 6).alias("gini"), F.round(clean.safe_divide(F.col("none"), F.col("p")), 6).alias("none_share"), "most_missing")


@query("""
WITH u AS (SELECT city_id, unit_id, center_lat AS y, center_lon AS x FROM local_morphotypes WHERE city_id IS NOT NULL AND isfinite(center_lat) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY network_type, loaded_at) = 1)
SELECT city_id, unit_id, row_number() OVER (PARTITION BY city_id ORDER BY y, unit_id) AS number FROM u
""")
def unit_sequence(spark, root):
    """Units of a city numbered from south to north, without a sort of whole large cities."""
    u = rollup.keep_first(load(spark, root, "local_morphotypes").where(F.col("city_id").isNotNull() & clean.finite(F.col("center_lat")).isNotNull()), ["unit_id"], [F.col("network_type"), F.col("loaded_at")])
    return ranks.running(u.select("city_id", "unit_id", "center_lat"), ["city_id"], "center_lat", {"number": F.lit(1)}, ["unit_id"]).select("city_id", "unit_id", "number")


_ENDS = ("origin_center_lon", "origin_center_lat", "destination_center_lon", "destination_center_lat")


@query("SELECT od_id, loaded_at, " + ", ".join(f"CASE WHEN isfinite({' + '.join(_ENDS)}) THEN {c} END AS {c}" for c in _ENDS) + ", round(coalesce(drive_route_length_m, straight_distance_m * 1.3), 3) AS length_m FROM od_detour_samples")
def edge_geometry(spark, root):
    """Lines of edges rebuilt from their ends, null where an end is no place, and a length for edges that lack one."""
    known = clean.finite(sum((F.col(c) for c in _ENDS), F.lit(0.0))).isNotNull()
    length = F.round(F.coalesce("drive_route_length_m", F.col("straight_distance_m") * 1.3), 3).alias("length_m")
    return load(spark, root, "od_detour_samples").select("od_id", "loaded_at", *[F.when(known, F.col(c)).alias(c) for c in _ENDS], length)


@query(f"""
WITH x AS (SELECT city_id, network_type, scale, {FIN('average_node_degree')} AS x FROM local_morphology_metrics),
s AS (SELECT city_id, network_type, scale, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, quantile_cont(x, 0.9) - quantile_cont(x, 0.1) AS span, avg(x) AS m FROM x GROUP BY ALL),
g AS (SELECT city_id, scale, max(m) FILTER (WHERE network_type = 'walk') - max(m) FILTER (WHERE network_type = 'drive') AS gap FROM s GROUP BY ALL)
SELECT s.city_id, network_type, s.scale, round(iqr, 6) + 0.0 AS iqr, round(span, 6) + 0.0 AS span, round(gap, 6) + 0.0 AS walk_drive_gap FROM s LEFT JOIN g ON s.city_id IS NOT DISTINCT FROM g.city_id AND s.scale IS NOT DISTINCT FROM g.scale
""")
def signature_spread(spark, root):
    """Spread of a metric within each city, network and scale, and the gap between the networks."""
    m, keys = load(spark, root, "local_morphology_metrics"), ["city_id", "network_type", "scale"]
    q = ranks.quantiles(m, keys, {"q": F.col("average_node_degree")}, [0.1, 0.25, 0.75, 0.9])
    s = ranks.null_safe(m.groupBy(*keys).agg(F.avg(clean.finite(F.col("average_node_degree"))).alias("m")), q, keys, "left")
    of = lambda n: F.max(F.when(F.col("network_type") == n, F.col("m")))
    gap = s.groupBy("city_id", "scale").agg((of("walk") - of("drive")).alias("gap"))
    out = ranks.null_safe(s, gap, ["city_id", "scale"], "left")
    return out.select(*keys, r6(F.col("q")[2] - F.col("q")[1], "iqr"), r6(F.col("q")[3] - F.col("q")[0], "span"), r6("gap", "walk_drive_gap"))
