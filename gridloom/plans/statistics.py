"""Queries of weighted statistics, signatures, scores and rollups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridloom.functions import clean, geo
from gridloom.operators import ranks, rollup, score, signature, stats
from gridloom.runtime import load

METRICS = (
    "edge_density_km_per_km2", "node_density_per_km2", "intersection_density_per_km2", "average_node_degree", "four_way_share", "dead_end_share", "segment_length_mean", "segment_length_median", "segment_length_p90",
    "edge_circuity_mean", "edge_circuity_median", "orientation_entropy", "orientation_order", "component_count", "giant_component_edge_share", "betweenness_gini", "road_hierarchy_entropy",
)
TYPES = tuple(f"MT{i:02d}" for i in range(1, 11))
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    """Rounded for comparison; -0.0 becomes 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name)


FIN = "(CASE WHEN isfinite({0}) THEN {0} END)".format
W = "greatest(coalesce(CASE WHEN isfinite({0}) THEN {0} END, 0), 0)".format


def _wmean(x: str, w: str) -> str:
    fx, fw = FIN(x), f"CASE WHEN {FIN(x)} IS NOT NULL THEN {W(w)} END"
    return f"CASE WHEN sum({fw}) > 0 THEN sum(({fw}) * {fx}) / nullif(sum({fw}), 0) ELSE avg({fx}) END"


def _signature_sql(keys: str, table: str, metrics=METRICS) -> str:
    parts = []
    for m in metrics:
        x = f"CASE WHEN coalesce(valid_metric, false) THEN {FIN(m)} END"
        w = f"CASE WHEN ({x}) IS NOT NULL THEN {W('population_weight')} END"
        mean = f"CASE WHEN sum({w}) > 0 THEN sum(({w}) * ({x})) / nullif(sum({w}), 0) ELSE avg({x}) END"
        var = f"CASE WHEN sum({w}) > 0 THEN greatest(0, sum(({w}) * ({x}) * ({x})) / nullif(sum({w}), 0) - pow(sum(({w}) * ({x})) / nullif(sum({w}), 0), 2)) ELSE var_pop({x}) END"
        stats_ = {"mean": mean, "std": f"sqrt({var})", **{f"q{int(q * 100)}": f"quantile_cont({x}, {q})" for q in (.1, .25, .5, .75, .9)}, "n_valid": f"count({x})::DOUBLE", "valid_share": f"count({x})::DOUBLE / count(*)"}
        parts += [f"SELECT {keys}, '{m}' AS metric, '{s}' AS statistic, round({v}, 9) AS value FROM {table} GROUP BY {keys}" for s, v in stats_.items()]
    return " UNION ALL ".join(parts)


KEYS3 = ["city_id", "network_type", "scale"]


def _signature(spark: SparkSession, root: str) -> DataFrame:
    return signature.local_signature(load(spark, root, "local_morphology_metrics"), KEYS3, list(METRICS), F.col("valid_metric"), "population_weight")


@query(_signature_sql("city_id, network_type, scale", "local_morphology_metrics"))
def scale_signature_long(spark, root):
    return _signature(spark, root).select(*KEYS3, "metric", "statistic", F.round("value", 9).alias("value"))


_SPINE = "SELECT c.city_id, n.network_type, s.scale FROM candidate_city c, (SELECT DISTINCT network_type FROM local_morphology_metrics) n, (SELECT DISTINCT scale FROM local_morphology_metrics) s"
_VALID = ", ".join(f"count(CASE WHEN coalesce(valid_metric, false) THEN {FIN(m)} END) AS {m}" for m in METRICS)
_LONG = " UNION ALL ".join(f"SELECT city_id, network_type, scale, '{m}' AS metric, coalesce({m}, 0)::BIGINT AS n_valid FROM j" for m in METRICS)


@query(f"WITH spine AS ({_SPINE}), sig AS (SELECT city_id, network_type, scale, {_VALID} FROM local_morphology_metrics GROUP BY city_id, network_type, scale), j AS (SELECT * FROM spine LEFT JOIN sig USING (city_id, network_type, scale)) {_LONG}")
def signature_completeness(spark, root):
    """Every key of the spine and every metric, with or without rows."""
    m = load(spark, root, "local_morphology_metrics")
    spine = signature.with_codes(signature.with_codes(load(spark, root, "candidate_city").select("city_id"), m, "network_type"), m, "scale")
    sig = signature.local_signature(m, KEYS3, list(METRICS), F.col("valid_metric"), "population_weight", spine)
    return sig.where(F.col("statistic") == "n_valid").select(*KEYS3, "metric", F.col("value").cast("long").alias("n_valid"))


@query(" UNION ALL ".join(f"SELECT unit_id, network_type, run_id, '{m}' AS metric, round(CASE WHEN coalesce(valid_metric, false) AND isfinite({m}) THEN {m} END, 6) AS value FROM local_morphology_metrics WHERE scale IN ('full_city', 'core_5km')" for m in METRICS))
def city_signature_long(spark, root):
    rows = load(spark, root, "local_morphology_metrics").where(F.col("scale").isin("full_city", "core_5km"))
    return signature.city_signature(rows, ["unit_id", "network_type", "run_id"], list(METRICS), F.col("valid_metric")).withColumn("value", F.round("value", 6))


def _z_sql() -> str:
    x = {m: FIN(m) for m in METRICS}
    fit = ", ".join(f"count({v}) AS n_{m}, avg({v}) AS m_{m}, stddev_pop({v}) AS s_{m}" for m, v in x.items())
    out = ", ".join(f"round(CASE WHEN n_{m} >= 2 AND s_{m} > 0 THEN ({v} - m_{m}) / s_{m} END, 6) + 0.0 AS {m}_z, CASE WHEN coalesce(n_{m}, 0) < 2 THEN 'too_few_fit_values' WHEN NOT (s_{m} > 0) THEN 'zero_std' WHEN {v} IS NULL THEN 'missing_value' ELSE 'ok' END AS {m}_status" for m, v in x.items())
    return f"WITH f AS (SELECT network_type, scale, {fit} FROM local_morphology_metrics WHERE sample_group = 'main' GROUP BY ALL) SELECT unit_id, t.network_type, t.scale, run_id, loaded_at, {out} FROM local_morphology_metrics t LEFT JOIN f ON t.network_type = f.network_type AND t.scale = f.scale"


@query(_z_sql())
def signature_z_core_fit(spark, root):
    cols = list(METRICS)
    z = signature.standardize(load(spark, root, "local_morphology_metrics"), ["network_type", "scale"], cols, F.col("sample_group") == "main")
    return z.select("unit_id", "network_type", "scale", "run_id", "loaded_at", *[x for c in cols for x in (r6(f"{c}_z", f"{c}_z"), F.col(f"{c}_status"))])


SCALES = ("full_city", "core_5km", "hex_2km", "hex_1km")


@query("SELECT city_id, network_type, " + ", ".join(f"round(max(CASE WHEN scale = '{s}' THEN v END), 6) AS {s}" for s in SCALES) + " FROM (SELECT city_id, network_type, scale, avg(CASE WHEN isfinite(average_node_degree) THEN average_node_degree END) AS v FROM local_morphology_metrics GROUP BY ALL) GROUP BY city_id, network_type")
def signature_matrix_pivot(spark, root):
    means = load(spark, root, "local_morphology_metrics").groupBy(*KEYS3).agg(F.avg(clean.finite(F.col("average_node_degree"))).alias("v"))
    return signature.pivot(means, ["city_id", "network_type"], "scale", list(SCALES), "v").select("city_id", "network_type", *[F.round(s, 6).alias(s) for s in SCALES])


@query("""
WITH m AS (SELECT city_id, network_type, scale, avg(CASE WHEN isfinite(average_node_degree) THEN average_node_degree END) AS v FROM local_morphology_metrics GROUP BY ALL),
p AS (SELECT city_id, network_type, max(CASE WHEN scale='full_city' THEN v END) f, max(CASE WHEN scale='core_5km' THEN v END) c, max(CASE WHEN scale='hex_2km' THEN v END) h2, max(CASE WHEN scale='hex_1km' THEN v END) h1,
  CASE WHEN count(v) >= 3 THEN stddev_pop(v) / nullif(abs(avg(v)), 0) END AS cv FROM m GROUP BY ALL)
SELECT city_id, network_type, round(c - f, 6) + 0.0 AS core_minus_full, round(h1 - h2, 6) + 0.0 AS fine_minus_coarse, round(h1 / nullif(f, 0), 6) AS local_to_full, round(cv, 6) AS scale_cv, round(1 / (1 + cv), 6) AS scale_stability FROM p
""")
def scale_transfer_features(spark, root):
    means = load(spark, root, "local_morphology_metrics").groupBy(*KEYS3).agg(F.avg(clean.finite(F.col("average_node_degree"))).alias("v"))
    out = signature.transfer(means, ["city_id", "network_type"], "scale", "v")
    return out.select("city_id", "network_type", r6("core_minus_full", "core_minus_full"), r6("fine_minus_coarse", "fine_minus_coarse"), *[F.round(c, 6).alias(c) for c in ("local_to_full", "scale_cv", "scale_stability")])


@query(f"""
SELECT city_id, count(*) AS n, round({_wmean('detour_ratio', 'origin_population_weight_raw')}, 6) AS wmean, round({_wmean('detour_ratio', 'od_pair_weight_raw * 0')}, 6) AS wmean_no_weight,
 round({_wmean('straight_distance_m', 'origin_type_confidence - 50')}, 6) AS wmean_negative FROM od_detour_samples GROUP BY city_id
""")
def weighted_mean_variants(spark, root):
    od = load(spark, root, "od_detour_samples")
    return od.groupBy("city_id").agg(
        F.count("*").alias("n"), F.round(stats.weighted_mean(F.col("detour_ratio"), F.col("origin_population_weight_raw")), 6).alias("wmean"),
        F.round(stats.weighted_mean(F.col("detour_ratio"), F.col("od_pair_weight_raw") * 0), 6).alias("wmean_no_weight"),
        F.round(stats.weighted_mean(F.col("straight_distance_m"), F.col("origin_type_confidence") - 50), 6).alias("wmean_negative"),
    )


def _wq_sql(keys: str, x: str, w: str, table: str, probs: dict[str, float]) -> str:
    out = ", ".join(f"round(coalesce(max(CASE WHEN p <= {q} AND np > {q} THEN x + (nx - x) * ({q} - p) / (np - p) END), CASE WHEN min(p) > {q} THEN min(x) ELSE max(x) END), 6) AS {n}" for n, q in probs.items())
    return f"""WITH a AS (SELECT {keys}, {FIN(x)} AS x, coalesce({FIN(w)}, 0) AS w0 FROM {table}), b AS (SELECT * FROM a WHERE x IS NOT NULL AND w0 >= 0),
    c AS (SELECT {keys}, x, CASE WHEN sum(w0) OVER (PARTITION BY {keys}) > 0 THEN w0 ELSE 1.0 END AS w FROM b),
    d AS (SELECT {keys}, x, (sum(w) OVER (PARTITION BY {keys} ORDER BY x, w ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY {keys}) AS p, row_number() OVER (PARTITION BY {keys} ORDER BY x, w) AS i FROM c),
    e AS (SELECT *, lead(x) OVER (PARTITION BY {keys} ORDER BY i) AS nx, lead(p) OVER (PARTITION BY {keys} ORDER BY i) AS np FROM d)
    SELECT {keys}, {out} FROM e GROUP BY {keys}"""


PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query(_wq_sql("city_id, scale", "detour_ratio", "origin_population_weight_raw", "od_detour_samples", PROBS))
def weighted_quantile_midpoint(spark, root):
    out = stats.weighted_quantiles(load(spark, root, "od_detour_samples"), ["city_id", "scale"], "detour_ratio", "origin_population_weight_raw", PROBS)
    return out.select("city_id", "scale", *[F.round(p, 6).alias(p) for p in PROBS])


@query("""
WITH a AS (SELECT city_id, segment_length_mean AS x FROM local_morphology_metrics WHERE isfinite(segment_length_mean)), b AS (SELECT city_id, x - least(0, min(x) OVER (PARTITION BY city_id)) AS x FROM a),
c AS (SELECT city_id, x, row_number() OVER (PARTITION BY city_id ORDER BY x) AS i FROM b)
SELECT city_id, round(CASE WHEN count(*) > 1 AND sum(x) > 0 THEN 2 * sum(i * x) / nullif(count(*) * sum(x), 0) - (count(*) + 1)::DOUBLE / count(*) ELSE 0 END, 6) AS gini FROM c GROUP BY city_id
""")
def gini_unweighted(spark, root):
    return stats.gini(load(spark, root, "local_morphology_metrics"), ["city_id"], "segment_length_mean").select("city_id", F.round("gini", 6).alias("gini"))


@query(f"""
WITH a AS (SELECT city_id, straight_distance_m AS x, {W('origin_population_sum')} AS w FROM od_detour_samples WHERE isfinite(straight_distance_m)),
b AS (SELECT city_id, x, w, sum(w) OVER (PARTITION BY city_id ORDER BY x, w ROWS UNBOUNDED PRECEDING) / nullif(sum(w) OVER (PARTITION BY city_id), 0) AS cw, sum(x * w) OVER (PARTITION BY city_id ORDER BY x, w ROWS UNBOUNDED PRECEDING) / nullif(sum(x * w) OVER (PARTITION BY city_id), 0) AS cx,
 row_number() OVER (PARTITION BY city_id ORDER BY x, w) AS i FROM a),
c AS (SELECT *, coalesce(lag(cw) OVER (PARTITION BY city_id ORDER BY i), 0) AS lw, coalesce(lag(cx) OVER (PARTITION BY city_id ORDER BY i), 0) AS lx FROM b)
SELECT city_id, round(CASE WHEN sum(w) <= 0 THEN NULL WHEN sum(x * w) <= 0 THEN 0 ELSE 1 - sum((cw - lw) * (cx + lx)) END, 6) AS gini FROM c GROUP BY city_id
""")
def gini_weighted_lorenz(spark, root):
    return stats.weighted_gini(load(spark, root, "od_detour_samples"), ["city_id"], "straight_distance_m", "origin_population_sum").select("city_id", F.round("gini", 6).alias("gini"))


@query(f"""
WITH t AS (SELECT city_id, morphotype, sum({W('population_sum')}) AS t FROM local_morphotypes WHERE morphotype IS NOT NULL GROUP BY ALL HAVING sum({W('population_sum')}) > 0), p AS (SELECT city_id, t / sum(t) OVER (PARTITION BY city_id) AS p FROM t)
SELECT city_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) + 0.0 AS evenness, count(*) AS classes FROM p GROUP BY city_id
""")
def class_entropy(spark, root):
    out = stats.entropy(load(spark, root, "local_morphotypes"), ["city_id"], "morphotype", F.col("population_sum"))
    return out.select("city_id", r6("entropy", "entropy"), r6("evenness", "evenness"), "classes")


@query("""
WITH s AS (SELECT unit_id, run_id, network_type, scale, loaded_at, unnest([four_way_share, dead_end_share, built_share]) AS v FROM local_morphology_metrics), p AS (SELECT *, CASE WHEN isfinite(v) AND v > 0 THEN v END AS q FROM s)
SELECT unit_id, run_id, network_type, scale, loaded_at, round(CASE WHEN sum(q) > 0 THEN ln(sum(q)) - sum(q * ln(q)) / sum(q) ELSE 0 END, 6) + 0.0 AS h FROM p GROUP BY ALL
""")
def row_share_entropy(spark, root):
    m = load(spark, root, "local_morphology_metrics")
    return m.select("unit_id", "run_id", "network_type", "scale", "loaded_at", r6(stats.row_entropy(F.col("four_way_share"), F.col("dead_end_share"), F.col("built_share")), "h"))


@query("""
WITH b AS (SELECT city_id, straight_distance_m AS w, destination_center_lon - origin_center_lon AS dx, destination_center_lat - origin_center_lat AS dy FROM od_detour_samples),
c AS (SELECT city_id, w, CASE WHEN dx IS NULL OR dy IS NULL OR (dx = 0 AND dy = 0) THEN -1 ELSE least(floor((CASE WHEN degrees(atan2(dx, dy)) < 0 THEN degrees(atan2(dx, dy)) + 180 ELSE degrees(atan2(dx, dy)) END % 180) / 5.0), 35) END AS bin FROM b),
t AS (SELECT city_id, bin, sum(CASE WHEN isfinite(w) AND w > 0 THEN w ELSE 0 END) AS t FROM c WHERE bin >= 0 GROUP BY ALL HAVING sum(CASE WHEN isfinite(w) AND w > 0 THEN w ELSE 0 END) > 0), p AS (SELECT city_id, t / sum(t) OVER (PARTITION BY city_id) AS p FROM t)
SELECT city_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy, round(1 + sum(p * ln(p)) / ln(36), 6) + 0.0 AS orientation_order FROM p GROUP BY city_id
""")
def orientation_entropy(spark, root):
    od = load(spark, root, "od_detour_samples")
    bins = od.withColumn("bin", geo.orientation_bin(F.col("destination_center_lon") - F.col("origin_center_lon"), F.col("destination_center_lat") - F.col("origin_center_lat"))).where(F.col("bin") >= 0)
    out = stats.entropy(bins, ["city_id"], "bin", F.col("straight_distance_m"))
    return out.select("city_id", r6("entropy", "entropy"), r6(1 - F.col("entropy") / F.log(F.lit(36.0)), "orientation_order"))


@query("""
WITH c AS (SELECT city_id, origin_unit_id, count(*) AS n FROM od_detour_samples GROUP BY ALL)
SELECT city_id, count(*) AS components, round(max(n)::DOUBLE / sum(n), 6) AS giant_share FROM c GROUP BY city_id
""")
def component_share(spark, root):
    od = load(spark, root, "od_detour_samples").groupBy("city_id", "origin_unit_id").agg(F.count("*").alias("n"))
    return od.groupBy("city_id").agg(F.count("*").alias("components"), F.round(F.max("n") / F.sum("n"), 6).alias("giant_share"))


@query(f"""
WITH q AS ({_wq_sql('city_id, morphotype', 'segment_length_mean', 'population_sum', 'local_morphotypes', PROBS)}),
a AS (SELECT city_id, morphotype, count(*) AS units, round({_wmean("(CASE WHEN low_confidence_flag THEN 1.0 ELSE 0.0 END)", 'population_sum')}, 6) AS flagged_share FROM local_morphotypes GROUP BY ALL)
SELECT a.city_id, a.morphotype, units, flagged_share, p10, p50, p90 FROM a LEFT JOIN q ON a.city_id IS NOT DISTINCT FROM q.city_id AND a.morphotype IS NOT DISTINCT FROM q.morphotype
""")
def access_group_bundle(spark, root):
    mt, keys = load(spark, root, "local_morphotypes"), ["city_id", "morphotype"]
    a = mt.groupBy(*keys).agg(F.count("*").alias("units"), F.round(stats.weighted_mean(F.when(F.col("low_confidence_flag"), 1.0).otherwise(0.0), F.col("population_sum")), 6).alias("flagged_share"))
    q = stats.weighted_quantiles(mt, keys, "segment_length_mean", "population_sum", PROBS).select(*[F.col(k).alias(f"q_{k}") for k in keys], *[F.round(p, 6).alias(p) for p in PROBS])
    return a.join(q, [F.col(k).eqNullSafe(F.col(f"q_{k}")) for k in keys], "left").select(*keys, "units", "flagged_share", *PROBS)


@query(f"""
WITH w AS ({_wq_sql('city_id', 'detour_ratio', 'od_pair_weight_raw', 'od_detour_samples', dict(p50=0.5, p90=0.9))}), r AS (SELECT city_id, failure_reason, count(*) AS n FROM od_detour_samples WHERE failure_reason IS NOT NULL GROUP BY ALL), j AS (SELECT city_id, string_agg(failure_reason || ':' || n, ';' ORDER BY failure_reason) AS failure_reasons FROM r GROUP BY city_id),
a AS (SELECT city_id, count(*) AS pairs, count(*) FILTER (WHERE route_found) AS routed, round(avg({FIN('detour_ratio')}), 9) AS mean_detour, round(quantile_cont({FIN('detour_ratio')}, 0.5), 9) AS p50, round(quantile_cont({FIN('detour_ratio')}, 0.9), 9) AS p90,
 array_to_string(list_sort(list(DISTINCT origin_analysis_scope) FILTER (WHERE origin_analysis_scope IS NOT NULL)), ';') AS scopes FROM od_detour_samples GROUP BY city_id)
SELECT a.*, coalesce(failure_reasons, '') AS failure_reasons, w.p50 AS weighted_p50, w.p90 AS weighted_p90 FROM a LEFT JOIN j ON a.city_id IS NOT DISTINCT FROM j.city_id LEFT JOIN w ON a.city_id IS NOT DISTINCT FROM w.city_id
""")
def od_group_metrics(spark, root):
    od = load(spark, root, "od_detour_samples")
    d = clean.finite(F.col("detour_ratio"))
    # failure reasons are counted per reason before they are gathered, so the lists are as short as the code list
    by = od.groupBy("city_id", "failure_reason").agg(F.count("*").alias("n"))
    reasons = by.groupBy("city_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("failure_reason").isNotNull(), F.concat_ws(":", "failure_reason", F.col("n").cast("string"))))), ";").alias("failure_reasons"))
    a = od.groupBy("city_id").agg(F.count("*").alias("pairs"), F.count_if("route_found").alias("routed"), F.round(F.avg(d), 9).alias("mean_detour"), F.array_join(F.array_sort(F.collect_set("origin_analysis_scope")), ";").alias("scopes"))
    q = ranks.quantiles(od, ["city_id"], {"q": d}, [0.5, 0.9]).select("city_id", F.round(F.col("q")[0], 9).alias("p50"), F.round(F.col("q")[1], 9).alias("p90"))
    w = stats.weighted_quantiles(od, ["city_id"], "detour_ratio", "od_pair_weight_raw", {"p50": 0.5, "p90": 0.9}).select("city_id", F.round("p50", 6).alias("weighted_p50"), F.round("p90", 6).alias("weighted_p90"))
    out = a
    for part in (q, w, reasons):
        out = ranks.null_safe(out, part, ["city_id"], "left")
    return out.withColumn("failure_reasons", F.coalesce("failure_reasons", F.lit("")))


_LEVELS = {"city": ["city_id"], "city_type": ["city_id", "morphotype"], "type": ["morphotype"]}


@query(" UNION ALL ".join(f"SELECT '{n}' AS group_level, {'city_id' if 'city_id' in k else 'NULL::VARCHAR AS city_id'}, {'morphotype' if 'morphotype' in k else 'NULL::VARCHAR AS morphotype'}, count(*) AS units, round(sum({FIN('population_sum')}), 3) AS population FROM local_morphotypes WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} GROUP BY {', '.join(k)}" for n, k in _LEVELS.items()))
def grouping_levels(spark, root):
    return rollup.grouping_levels(load(spark, root, "local_morphotypes"), _LEVELS, [F.count("*").alias("units"), F.round(F.sum(clean.finite(F.col("population_sum"))), 3).alias("population")])


@query("""
SELECT coalesce(r_name, 'ALL') AS r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)
""")
def rollup_with_all(spark, root):
    c = load(spark, root, "customer").join(load(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(load(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rollup.with_total(c, "r_name", [F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")])


_COMP = "SELECT city_id, morphotype, count(*) AS n, sum(coalesce(population_sum, 0)) AS weight FROM local_morphotypes WHERE city_id IS NOT NULL AND morphotype IS NOT NULL GROUP BY ALL"


@query(f"WITH t AS ({_COMP}) SELECT city_id, morphotype, n, round(weight, 3) AS weight, round(n::DOUBLE / sum(n) OVER (PARTITION BY city_id), 6) AS count_share, round(coalesce(weight / nullif(sum(weight) OVER (PARTITION BY city_id), 0), 0), 6) AS weight_share FROM t")
def composition_shares(spark, root):
    c = rollup.composition(load(spark, root, "local_morphotypes"), "city_id", "morphotype", F.col("population_sum"))
    return c.select("city_id", "morphotype", "n", F.round("weight", 3).alias("weight"), F.round("count_share", 6).alias("count_share"), F.round("weight_share", 6).alias("weight_share"))


@query(f"WITH t AS ({_COMP}), s AS (SELECT city_id, morphotype, n::DOUBLE / sum(n) OVER (PARTITION BY city_id) AS s FROM t) SELECT city_id, morphotype AS dominant, round(s, 6) AS dominant_share FROM s QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY s DESC, morphotype) = 1")
def dominant_type(spark, root):
    c = rollup.composition(load(spark, root, "local_morphotypes"), "city_id", "morphotype", F.col("population_sum"))
    return rollup.dominant(c, ["city_id"], "morphotype", "count_share").select("city_id", "dominant", F.round("dominant_share", 6).alias("dominant_share"))


@query("""
WITH t AS (SELECT city_id, scale, morphotype, count(*)::DOUBLE AS n FROM local_morphotypes WHERE city_id IS NOT NULL AND morphotype IS NOT NULL GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY city_id, scale) AS s FROM t),
p AS (SELECT city_id, morphotype, sum(CASE WHEN scale = 'hex_1km' THEN s ELSE 0 END) AS a, sum(CASE WHEN scale = 'hex_2km' THEN s ELSE 0 END) AS b FROM s GROUP BY ALL)
SELECT city_id, round(CASE WHEN sum(a) > 0 AND sum(b) > 0 THEN 1 - sum(abs(a - b)) / 2 END, 6) + 0.0 AS similarity FROM p GROUP BY city_id
""")
def variation_similarity(spark, root):
    mt = load(spark, root, "local_morphotypes")
    shares = {s: rollup.composition(mt.where(F.col("scale") == s), "city_id", "morphotype", F.lit(1.0)) for s in ("hex_1km", "hex_2km")}
    return rollup.variation_similarity(shares["hex_1km"], shares["hex_2km"], ["city_id"], "morphotype", "count_share").select("city_id", r6("similarity", "similarity"))


@query("""
WITH q AS (SELECT quantile_cont(ln(1 + greatest(o_totalprice, 0)), 0.05) a, quantile_cont(ln(1 + greatest(o_totalprice, 0)), 0.95) b, quantile_cont(o_custkey::DOUBLE, 0.05) c, quantile_cont(o_custkey::DOUBLE, 0.95) d FROM orders)
SELECT o_orderkey, round(least(greatest((ln(1 + greatest(o_totalprice, 0)) - a) / (b - a) * 100, 0), 100), 6) AS price_score, round(100 - least(greatest((o_custkey - c) / (d - c) * 100, 0), 100), 6) AS early_score FROM orders, q
""")
def robust_scores(spark, root):
    o = load(spark, root, "orders")
    return score.robust_scores(o, {"price_score": ("o_totalprice", True, False), "early_score": ("o_custkey", False, True)}).select("o_orderkey", F.round("price_score", 6).alias("price_score"), F.round("early_score", 6).alias("early_score"))


def _bounded(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END"


@query(f"""
SELECT unit_id, network_type, loaded_at,
 round((coalesce(quality_score * 0.5, 0) + coalesce(type_confidence * 0.3, 0) + coalesce(local_metric_validity_score * 0.2, 0)) / nullif(CASE WHEN quality_score IS NULL THEN 0 ELSE 0.5 END + CASE WHEN type_confidence IS NULL THEN 0 ELSE 0.3 END + CASE WHEN local_metric_validity_score IS NULL THEN 0 ELSE 0.2 END, 0), 6) AS weighted,
 round(least(greatest(exp(0.5 * ln({_bounded('coalesce(cluster_probability, 0)', 0, 1)} + 1e-6) + 0.25 * ln({_bounded('coalesce(quality_weight, 0)', 0, 1)} + 1e-6) + 0.25 * ln({_bounded('coalesce(valid_area_ratio, 0.5)', 0, 1)} + 1e-6)), 0), 1), 6) AS confidence,
 CASE WHEN quality_score IS NULL THEN 'unknown' WHEN quality_score <= 50 THEN 'low' WHEN quality_score >= 80 THEN 'high' ELSE 'medium' END AS band,
 CASE WHEN built_share > 0 THEN round({_bounded('100 * (1 - abs(ln(CASE WHEN built_share > 0 THEN built_share END)) / ln(3))', 0, 100)}, 6) END AS closeness
FROM local_morphotypes
""")
def row_scores(spark, root):
    mt, c = load(spark, root, "local_morphotypes"), F.col
    return mt.select(
        "unit_id", "network_type", "loaded_at", F.round(clean.weighted_average((c("quality_score"), 0.5), (c("type_confidence"), 0.3), (c("local_metric_validity_score"), 0.2)), 6).alias("weighted"),
        F.round(clean.geometric_confidence((c("cluster_probability"), 0.5, 0.0), (c("quality_weight"), 0.25, 0.0), (c("valid_area_ratio"), 0.25, 0.5)), 6).alias("confidence"),
        clean.band(c("quality_score"), 50, 80).alias("band"), F.round(clean.closeness(c("built_share")), 6).alias("closeness"),
    )


@query("""
WITH t AS (SELECT *, CASE WHEN quality_score < 50 THEN 'excluded' WHEN quality_score < 70 OR valid_area_ratio IS NULL OR valid_area_ratio < 0.75 THEN 'sensitivity' ELSE 'core' END AS tier FROM local_morphotypes)
SELECT unit_id, network_type, loaded_at, tier, round_even(CASE tier WHEN 'core' THEN 1.0 WHEN 'sensitivity' THEN CASE WHEN quality_score IS NOT NULL THEN least(greatest(0.60 + (quality_score - 50.0) / 20.0 * 0.30, 0.60), 0.90) END ELSE CASE WHEN quality_score IS NOT NULL THEN least(greatest(0.25 + quality_score / 50.0 * 0.25, 0.25), 0.50) END END::DOUBLE, 4) AS weight,
 concat_ws(';', CASE WHEN quality_score < 70 THEN 'low_quality' END, CASE WHEN low_confidence_flag THEN 'low_confidence' END, CASE WHEN ambiguous_cluster_flag THEN 'ambiguous' END, CASE WHEN valid_area_ratio < 0.5 THEN 'small_part' END) AS reasons FROM t
""")
def quality_tiers(spark, root):
    c = F.col
    mt = load(spark, root, "local_morphotypes").withColumn("tier", clean.choose((c("quality_score") < 50, "excluded"), ((c("quality_score") < 70) | c("valid_area_ratio").isNull() | (c("valid_area_ratio") < 0.75), "sensitivity"), otherwise="core"))
    return mt.select("unit_id", "network_type", "loaded_at", "tier", clean.piecewise_weight(c("quality_score"), c("tier")).alias("weight"), clean.reasons(low_quality=c("quality_score") < 70, low_confidence=c("low_confidence_flag"), ambiguous=c("ambiguous_cluster_flag"), small_part=c("valid_area_ratio") < 0.5).alias("reasons"))


@query("""
WITH q AS (SELECT network_type, scale, quantile_cont(edge_density_km_per_km2, 0.995) AS cut FROM local_morphology_metrics WHERE valid_metric AND isfinite(edge_density_km_per_km2) GROUP BY ALL),
f AS (SELECT m.*, coalesce(isfinite(edge_density_km_per_km2) AND edge_density_km_per_km2 > cut, false) AS dense FROM local_morphology_metrics m LEFT JOIN q ON m.network_type = q.network_type AND m.scale = q.scale)
SELECT unit_id, network_type, scale, run_id, loaded_at, dense, round(least(greatest(100.0 - (CASE WHEN NOT coalesce(valid_metric, false) THEN 45 ELSE 0 END) - (CASE WHEN coalesce(edge_count < 3, false) THEN 15 ELSE 0 END) - (CASE WHEN coalesce(node_count < 2, false) THEN 15 ELSE 0 END) - (CASE WHEN dense THEN 20 ELSE 0 END) - (CASE WHEN coalesce(isfinite(edge_circuity_mean) AND NOT edge_circuity_mean BETWEEN 1 AND 3, false) THEN 15 ELSE 0 END), 0), 100), 2)::DOUBLE AS validity FROM f
""")
def local_flags_penalty(spark, root):
    c = F.col
    m = score.above_group_quantile(load(spark, root, "local_morphology_metrics"), ["network_type", "scale"], "edge_density_km_per_km2", 0.995, c("valid_metric"), "dense")
    return m.select("unit_id", "network_type", "scale", "run_id", "loaded_at", "dense", clean.penalty((~clean.safe_bool(c("valid_metric")), 45), (c("edge_count") < 3, 15), (c("node_count") < 2, 15), (c("dense"), 20), (~clean.finite(c("edge_circuity_mean")).between(1, 3), 15)).alias("validity"))


# Rules over the samples: condition and evidence, in words that both engines read.
_RULES = {
    "long_detour": ("detour_ratio > 2", None), "no_route": ("NOT route_found", "failure_reason"), "low_confidence": ("origin_low_confidence_flag AND destination_low_confidence_flag", "origin_unit_id"),
    "short_pair": ("straight_distance_m < 100", "destination_unit_id"), "same_unit": ("origin_unit_id = destination_unit_id", "origin_unit_id"), "missing_city": ("city_id IS NULL", "origin_unit_id"),
    "missing_type": ("origin_morphotype IS NULL OR destination_morphotype IS NULL", "origin_unit_id"), "mixed_scope": ("origin_analysis_scope <> destination_analysis_scope", "origin_analysis_scope"),
    "doubtful_origin": ("origin_type_confidence < 50", "origin_unit_id"), "detour_above_p95": ("above", "origin_unit_id"),
}


@query(f"""
WITH p AS (SELECT city_id, quantile_cont({FIN('detour_ratio')}, 0.95) AS p95 FROM od_detour_samples WHERE route_found GROUP BY city_id),
s AS (SELECT o.*, coalesce({FIN('detour_ratio')} > p95, false) AS above FROM od_detour_samples o LEFT JOIN p ON o.city_id IS NOT DISTINCT FROM p.city_id)
{' UNION ALL '.join(f"SELECT od_id, '{n}' AS rule, {'CAST(detour_ratio AS VARCHAR)' if e is None else e} AS evidence FROM s WHERE {w}" for n, (w, e) in _RULES.items())}
""")
def review_list(spark, root):
    """Ten kinds of samples to look at, with evidence; one threshold is the 95 % rank of the sample's city. One pass after it."""
    od = score.above_group_quantile(load(spark, root, "od_detour_samples"), ["city_id"], "detour_ratio", 0.95, F.col("route_found"), "above")
    return score.review_list(od, "od_id", {n: (F.expr(w), F.col(e or "detour_ratio")) for n, (w, e) in _RULES.items()})


@query(f"SELECT osmid, network_type, city_id, {FIN('lon')} AS lon, {FIN('lat')} AS lat FROM (SELECT osmid, network_type, city_id, lon, lat, row_number() OVER (PARTITION BY osmid, network_type ORDER BY built_at DESC NULLS LAST, city_id, lon, lat) AS rn FROM network_context) WHERE rn = 1")
def dedupe_latest(spark, root):
    n = load(spark, root, "network_context")
    return rollup.keep_first(n, ["osmid", "network_type"], [F.col("built_at").desc_nulls_last(), F.col("city_id").asc_nulls_last(), F.col("lon").asc_nulls_last(), F.col("lat").asc_nulls_last()]).select("osmid", "network_type", "city_id", clean.finite(F.col("lon")).alias("lon"), clean.finite(F.col("lat")).alias("lat"))


@query("""
WITH n AS (SELECT *, round_even(lon / 0.0003, 0)::BIGINT AS cx, round_even(lat / 0.0003, 0)::BIGINT AS cy FROM network_context WHERE isfinite(lon) AND isfinite(lat) AND abs(lon) <= 180 AND abs(lat) <= 90)
SELECT city_id, cx, cy, osmid, network_type FROM n QUALIFY row_number() OVER (PARTITION BY city_id, cx, cy ORDER BY network_type, osmid, built_at) = 1
""")
def dedupe_priority_grid(spark, root):
    n = load(spark, root, "network_context").where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).withColumn("cx", clean.grid_cell(F.col("lon"), 0.0003)).withColumn("cy", clean.grid_cell(F.col("lat"), 0.0003))
    return rollup.keep_first(n, ["city_id", "cx", "cy"], [F.col("network_type"), F.col("osmid"), F.col("built_at")]).select("city_id", "cx", "cy", "osmid", "network_type")


@query("""
WITH d AS (SELECT city_name_en, country, count(*) AS n, string_agg(city_id, ';' ORDER BY city_id) AS ids FROM candidate_city GROUP BY ALL HAVING count(*) > 1) SELECT c.city_id, ids AS shared_with FROM candidate_city c JOIN d USING (city_name_en, country)
""")
def shared_key_duplicates(spark, root):
    c = load(spark, root, "candidate_city")
    d = c.groupBy("city_name_en", "country").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("city_id")), ";").alias("shared_with")).where(F.col("n") > 1)
    return c.join(d, ["city_name_en", "country"]).select("city_id", "shared_with")


@query("SELECT c_nationkey, c_custkey, rn AS rank, round(c_acctbal, 2) AS c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def topk_per_type(spark, root):
    return rollup.top_k(load(spark, root, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_name"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"), F.round("c_acctbal", 2).alias("c_acctbal"))


@query("""
WITH f AS (SELECT c_mktsegment, c_nationkey, string_agg(c_custkey::VARCHAR, ', ' ORDER BY c_custkey::VARCHAR) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 3 GROUP BY ALL)
SELECT c_mktsegment, c_nationkey, count(*) AS n, count(DISTINCT c_custkey) AS ids, any_value(examples) AS examples FROM customer JOIN f USING (c_mktsegment, c_nationkey) GROUP BY c_mktsegment, c_nationkey
""")
def stratum_examples(spark, root):
    return rollup.strata(load(spark, root, "customer"), ["c_mktsegment", "c_nationkey"], "c_custkey", 3)


_DRAW = "(('0x' || substr(sha256('{0}|' || {1}), 1, 13))::BIGINT / 4503599627370496.0)".format


@query(f"SELECT city_id, network_type, scale, unit_id FROM local_morphotypes QUALIFY row_number() OVER (PARTITION BY city_id, network_type, scale ORDER BY {_DRAW(42, 'unit_id')}, unit_id) <= 20")
def balanced_sample(spark, root):
    m = load(spark, root, "local_morphotypes")
    return rollup.balanced_sample(m, ["city_id", "network_type", "scale"], "unit_id", 20, 42).select("city_id", "network_type", "scale", "unit_id")


_SAMPLED = f"""
WITH u AS (SELECT city_id, unit_id, population_sum AS w, center_lon AS x, center_lat AS y FROM local_morphotypes WHERE city_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY network_type, loaded_at) = 1), p AS (SELECT * FROM u WHERE w > 0),
o AS (SELECT city_id, unit_id AS origin FROM p QUALIFY row_number() OVER (PARTITION BY city_id ORDER BY -ln(greatest({_DRAW(7, 'unit_id')}, 1e-300)) / w, unit_id) <= 20),
t AS (SELECT city_id, unit_id, sum(w) OVER k / sum(w) OVER (PARTITION BY city_id) AS hi, (sum(w) OVER k - w) / sum(w) OVER (PARTITION BY city_id) AS lo, row_number() OVER k AS i, count(*) OVER (PARTITION BY city_id) AS n FROM p WINDOW k AS (PARTITION BY city_id ORDER BY {_DRAW(8, 'unit_id')}, unit_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT o.city_id, origin, draw, attempt, {_DRAW(7, "origin || '|' || draw || '|' || attempt")} AS r FROM o, range(1, 9) a(draw), range(1, 5) b(attempt)),
c AS (SELECT d.city_id, origin, draw, attempt, unit_id FROM d JOIN t ON d.city_id = t.city_id AND r >= lo AND (r < hi OR i = n)),
g AS (SELECT c.*, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))) AS m FROM c JOIN u a ON a.unit_id = c.origin JOIN u b ON b.unit_id = c.unit_id)
SELECT city_id, origin, draw, unit_id FROM g WHERE NOT isnan(m) AND m >= 500 QUALIFY row_number() OVER (PARTITION BY origin, draw ORDER BY attempt) = 1
"""


@query(_SAMPLED)
def weighted_od_sample(spark, root):
    """Origins without replacement and destinations with replacement, both by population; a destination nearer than 500 m is drawn anew, up to four times."""
    units = rollup.keep_first(load(spark, root, "local_morphotypes").where(F.col("city_id").isNotNull()), ["unit_id"], [F.col("network_type"), F.col("loaded_at")])
    origins = rollup.weighted_sample(units, ["city_id"], "unit_id", "population_sum", 20, 7).withColumnRenamed("unit_id", "origin")
    drawn = rollup.sample_with_replacement(origins, units, "city_id", "origin", "unit_id", "population_sum", 8, 7, attempts=4)
    at = lambda p, k: units.select(F.col("unit_id").alias(k), F.col("center_lon").alias(f"{p}x"), F.col("center_lat").alias(f"{p}y"))
    far = drawn.join(at("o", "origin"), "origin").join(at("d", "unit_id"), "unit_id").withColumn("m", geo.haversine_m(F.col("ox"), F.col("oy"), F.col("dx"), F.col("dy"))).where(~F.isnan("m") & (F.col("m") >= 500))
    return rollup.keep_first(far, ["origin", "draw"], [F.col("attempt")]).select("city_id", "origin", F.col("draw").cast("long").alias("draw"), "unit_id")


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, max(CASE WHEN y = 1996 THEN n END) AS n1996, max(CASE WHEN y = 2000 THEN n END) AS n2000, max(y)::INT AS last_year, round(ln((1.0 + max(CASE WHEN y = 2000 THEN n END)) / (1.0 + max(CASE WHEN y = 1996 THEN n END))), 6) + 0.0 AS growth, round(1 / (1 + CASE WHEN count(*) >= 3 THEN stddev_pop(n) / avg(n) END), 6) AS stability FROM y GROUP BY o_custkey
""")
def history_year_metrics(spark, root):
    y = load(spark, root, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    at = lambda year: F.max(F.when(F.col("y") == year, F.col("n")))
    cv = F.when(F.count("*") >= 3, F.stddev_pop("n") / F.avg("n"))
    return y.groupBy("o_custkey").agg(at(1996).alias("n1996"), at(2000).alias("n2000"), F.max("y").alias("last_year"), r6(clean.growth(at(2000), at(1996)), "growth"), F.round(clean.stability(cv), 6).alias("stability"))


_SUMMARY = ", ".join(f"round({_wmean(m, 'population_weight')}, 6) AS {m}_wmean, round(avg({FIN(m)}), 6) AS {m}_mean, round(quantile_cont({FIN(m)}, 0.5), 6) AS {m}_median, round(quantile_cont({FIN(m)}, 0.1), 6) AS {m}_p10, round(quantile_cont({FIN(m)}, 0.9), 6) AS {m}_p90" for m in METRICS)


@query(f"SELECT network_type, scale, count(*) AS n, {_SUMMARY} FROM local_morphology_metrics GROUP BY network_type, scale")
def weighted_summary(spark, root):
    s = stats.summary(load(spark, root, "local_morphology_metrics"), ["network_type", "scale"], list(METRICS), "population_weight")
    return s.select("network_type", "scale", "n", *[F.round(c, 6).alias(c) for c in s.columns if c not in ("network_type", "scale", "n")])


@query(" UNION ALL ".join(f"SELECT '{m}' AS \"column\", count({FIN(m)}) AS n, round(avg({FIN(m)}), 6) AS mean, round(quantile_cont({FIN(m)}, 0.5), 6) AS median, round(quantile_cont({FIN(m)}, 0.9), 6) AS p90, round(max({FIN(m)}), 6) AS max FROM local_morphology_metrics" for m in METRICS))
def distribution_summary(spark, root):
    return stats.distribution(load(spark, root, "local_morphology_metrics"), list(METRICS)).select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "p90", "max")])


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY unit_id, network_type ORDER BY loaded_at, city_id) AS rn FROM local_morphotypes)
SELECT unit_id, network_type, round(CASE WHEN sum(population_sum) OVER (PARTITION BY city_id, scale) > 0 THEN coalesce(population_sum / sum(population_sum) OVER (PARTITION BY city_id, scale), NULL) ELSE 1.0 / count(*) OVER (PARTITION BY city_id, scale) END, 9) AS share FROM a WHERE rn = 1
""")
def share_normalize(spark, root):
    u = rollup.keep_first(load(spark, root, "local_morphotypes"), ["unit_id", "network_type"], [F.col("loaded_at"), F.col("city_id")])
    return stats.share(u, ["city_id", "scale"], "population_sum", "share").select("unit_id", "network_type", F.round("share", 9).alias("share"))


@query("""
WITH g AS (SELECT city_id, origin_morphotype, avg(detour_ratio) AS m, count(detour_ratio) AS n FROM od_detour_samples GROUP BY ALL), p AS (SELECT city_id, avg(detour_ratio) AS pm FROM od_detour_samples GROUP BY city_id)
SELECT g.city_id, origin_morphotype, n, round(m - pm, 6) + 0.0 AS effect FROM g JOIN p ON g.city_id IS NOT DISTINCT FROM p.city_id
""")
def validation_effects(spark, root):
    """Group mean minus its city's mean; both from one partial aggregation of the samples."""
    g = load(spark, root, "od_detour_samples").groupBy("city_id", "origin_morphotype").agg(F.sum("detour_ratio").alias("s"), F.count("detour_ratio").alias("n"))
    w = Window.partitionBy("city_id")
    return g.select("city_id", "origin_morphotype", "n", r6(F.try_divide(F.col("s"), F.col("n")) - F.try_divide(F.sum("s").over(w), F.sum("n").over(w)), "effect"))


_SCEN = {"all": "TRUE", "exclude_low_flag": "NOT origin_low_confidence_flag", "confidence_60": "origin_type_confidence >= 60", "confidence_70": "origin_type_confidence >= 70"}


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT '{n}' AS scenario, origin_morphotype, count(*) AS n, avg(detour_ratio) AS m FROM od_detour_samples WHERE {w} GROUP BY origin_morphotype" for n, w in _SCEN.items()) + ") SELECT s.scenario, s.origin_morphotype, s.n, round(s.m, 6) AS mean_detour, round(s.m - b.m, 6) + 0.0 AS delta FROM s JOIN s b ON b.scenario = 'all' AND b.origin_morphotype IS NOT DISTINCT FROM s.origin_morphotype")
def sensitivity_scenarios(spark, root):
    """Scenario means and their difference from all rows, in one pass: a row counts in each scenario that it meets."""
    od = load(spark, root, "od_detour_samples")
    tags = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in _SCEN.items()]))
    s = od.select("origin_morphotype", "detour_ratio", F.explode(tags).alias("scenario")).groupBy("scenario", "origin_morphotype").agg(F.count("*").alias("n"), F.avg("detour_ratio").alias("m"))
    base = F.max(F.when(F.col("scenario") == "all", F.col("m"))).over(Window.partitionBy("origin_morphotype"))
    return s.select("scenario", "origin_morphotype", "n", F.round("m", 6).alias("mean_detour"), r6(F.col("m") - base, "delta"))
