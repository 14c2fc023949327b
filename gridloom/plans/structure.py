"""Queries of text, linkage, spatial, graph, model and contract operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.functions import clean, geo, text
from gridloom.operators import graph, linkage, model, rollup, spatial, stats
from gridloom.plans.statistics import METRICS, _wq_sql, r6
from gridloom.runtime import load, materialize

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# text

_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(replace(replace({0}, 'ø', 'o'), 'Ø', 'O'))), '&', ' and ', 'g'), '\\[[^\\]]*\\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))".format


@query(f"SELECT id_uc_g0, {_CLEAN('gc_ucn_mai_2025')} AS name, array_to_string(list_sort(list_filter(string_split({_CLEAN('gc_ucn_mai_2025')}, ' '), lambda x: x <> '')), ' ') AS tokens, trim(regexp_replace(lower(gc_cnt_unn_2025), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM ghs_ucdb")
def text_normalize(spark, root):
    n = text.clean_text(F.col("gc_ucn_mai_2025"))
    return load(spark, root, "ghs_ucdb").select("id_uc_g0", n.alias("name"), text.token_sort_key(n).alias("tokens"), clean.slug(F.col("gc_cnt_unn_2025")).alias("slug"))


@query("""
WITH p AS (SELECT raw_id, unnest(string_split(gc_ucn_lis_2025, ';')) AS n FROM ghs_ucdb_raw),
v AS (SELECT raw_id, trim(n, ' ') AS v FROM p UNION SELECT raw_id, trim(regexp_replace(n, '[\\[(][^\\])]*[\\])]', '', 'g'), ' ') FROM p UNION SELECT raw_id, trim(unnest(regexp_extract_all(n, '[\\[(]([^\\])]*)[\\])]', 1)), ' ') FROM p)
SELECT raw_id, v AS variant FROM v WHERE v <> ''
""")
def name_variants(spark, root):
    raw = load(spark, root, "ghs_ucdb_raw")
    return raw.select("raw_id", F.explode(text.name_variants(F.col("gc_ucn_lis_2025"))).alias("variant"))


# Tags of units stand for tags of ways: kind, access, own key, area, direction.
_TAGGED = {"highway": "local_quality_flag", "access": "analysis_scope", "foot": "quality_tier", "area": "CASE WHEN edge_unit THEN 'yes' END", "oneway": "CASE WHEN low_confidence_flag THEN 'yes' ELSE 'no' END", "junction": "anomaly_reason"}
_DRIVE = text.WayRules(excluded=("excluded",), refused=("sensitivity",))
_WALK = text.WayRules(excluded=(), refused=("sensitivity", "retained_excluded"), own="foot", granted=("a", "b"))


@query(f"""
WITH w AS (SELECT unit_id, network_type, loaded_at, {', '.join(f"nullif(lower(trim({v})), '') AS {k}" for k, v in _TAGGED.items())} FROM local_morphotypes)
SELECT unit_id, network_type, loaded_at, highway AS kind, highway IS NOT NULL AND highway <> 'excluded' AND coalesce(area, '') <> 'yes' AND coalesce(access, '') <> 'sensitivity' AS drive,
 highway IS NOT NULL AND coalesce(area, '') <> 'yes' AND NOT (coalesce(foot, '') IN ('no', 'private') OR (coalesce(access, '') IN ('sensitivity', 'retained_excluded') AND coalesce(foot, '') NOT IN ('a', 'b'))) AS walk,
 CASE WHEN oneway IN ('-1', 'reverse') THEN 'backward' WHEN oneway IN ('yes', 'true', '1') OR junction = 'roundabout' THEN 'forward' ELSE 'both' END AS direction FROM w
""")
def way_rules(spark, root):
    """Admission to two networks by parametric tag rules, and direction."""
    tags = F.create_map(*[x for k, v in _TAGGED.items() for x in (F.lit(k), F.expr(v))])
    w = load(spark, root, "local_morphotypes").select("unit_id", "network_type", "loaded_at", tags.alias("t"))
    t = F.col("t")
    return w.select("unit_id", "network_type", "loaded_at", text.first_value(t["highway"]).alias("kind"), text.way_allowed(t, _DRIVE).alias("drive"), text.way_allowed(t, _WALK).alias("walk"), text.way_direction(t["oneway"], t["junction"], "drive").alias("direction"))


_WORDS = {"network": ("http", "socket", "curl"), "storage": ("cache", "buffer", "disk"), "test": ("assert", "unittest"), "licence": ("license", "copyright", "warranty")}


@query("WITH d AS (SELECT doc_id, lower(text) AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS category FROM d WHERE " + " OR ".join(f"contains(t, '{w}')" for w in ws) for n, ws in _WORDS.items()))
def facility_categories(spark, root):
    return load(spark, root, "documents").select("doc_id", F.explode(text.categories_in(F.col("text"), _WORDS)).alias("category"))


@query("""
WITH p AS (SELECT unit_id, network_type, loaded_at, lower(trim(quality_tier)) AS v, lower(trim(local_quality_flag)) AS flag, lower(trim(analysis_scope)) AS scope FROM local_morphotypes),
c AS (SELECT *, CASE WHEN v IN ('a', 'b') THEN ['best'] WHEN v = 'c' THEN ['fair'] END AS own, [CASE WHEN flag = 'excluded' THEN 'doubtful' END, CASE WHEN scope IS NOT NULL AND scope NOT IN ('', 'no') THEN 'placed' END] AS other FROM p)
SELECT unit_id, network_type, loaded_at, array_to_string(coalesce(own, list_filter(other, lambda x: x IS NOT NULL)), ';') AS categories FROM c
""")
def tag_categories(spark, root):
    """Categories of a primary tag by rules, else of the other tags."""
    rules = {"best": {"tier": ("a", "b")}, "fair": {"tier": ("c",)}, "doubtful": {"flag": ("excluded",)}, "placed": {"scope": None}}
    u = load(spark, root, "local_morphotypes")
    tags = F.create_map(F.lit("flag"), F.coalesce("local_quality_flag", F.lit("")), F.lit("scope"), F.coalesce("analysis_scope", F.lit("")))
    return u.select("unit_id", "network_type", "loaded_at", F.array_join(text.categories_of(F.lit("tier"), F.coalesce("quality_tier", F.lit("")), tags, rules), ";").alias("categories"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS flat, 'k=' || json_extract_string(props, '$.k') AS tag FROM events")
def json_tags(spark, root):
    m = F.from_json("props", "map<string,string>")
    return load(spark, root, "events").select("event_id", text.flatten_json(F.col("props")).alias("flat"), text.primary_tag(m, ("missing", "k")).alias("tag"))


@query(None)
def fuzzy_linkage(spark, root):
    return linkage.match_in_blocks(load(spark, root, "candidate_city"), load(spark, root, "ghs_ucdb"), "city_id", "city_name_en", "country", "id_uc_g0", "gc_ucn_mai_2025", "gc_cnt_gad_2025", "gc_pop_tot_2025")


# spatial


@query("""
SELECT od_id, loaded_at, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(destination_center_lat - origin_center_lat) / 2), 2) + cos(radians(origin_center_lat)) * cos(radians(destination_center_lat)) * pow(sin(radians(destination_center_lon - origin_center_lon) / 2), 2)))), 3) AS great_circle_m,
 round(greatest(1, drive_route_length_m / CASE WHEN straight_distance_m > 0.01 THEN straight_distance_m END), 6) AS circuity FROM od_detour_samples WHERE isfinite(origin_center_lon + origin_center_lat + destination_center_lon + destination_center_lat) AND drive_route_length_m IS NOT NULL
""")
def haversine_pairs(spark, root):
    c = F.col
    od = load(spark, root, "od_detour_samples").where(clean.finite(c("origin_center_lon") + c("origin_center_lat") + c("destination_center_lon") + c("destination_center_lat")).isNotNull() & c("drive_route_length_m").isNotNull())
    return od.select("od_id", "loaded_at", F.round(geo.haversine_m(c("origin_center_lon"), c("origin_center_lat"), c("destination_center_lon"), c("destination_center_lat")), 3).alias("great_circle_m"), F.round(geo.circuity(c("drive_route_length_m"), c("straight_distance_m")), 6).alias("circuity"))


_PLACE = "{0} BETWEEN -180 AND 180 AND {1} BETWEEN -90 AND 90 AND NOT ({0} = 0 AND {1} = 0)".format


@query(f"""
WITH u AS (SELECT DISTINCT unit_id, center_lon AS x, center_lat AS y FROM local_morphotypes WHERE {_PLACE('center_lon', 'center_lat')}), n AS (SELECT DISTINCT osmid, lon, lat FROM network_context WHERE {_PLACE('lon', 'lat')}),
d AS (SELECT unit_id, osmid, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(y)) * cos(radians(lat)) * pow(sin(radians(lon - x) / 2), 2)))) AS d FROM u, n)
SELECT unit_id, round(min(d), 2) AS distance_m FROM d GROUP BY unit_id
""")
def nearest_node(spark, root):
    got = spatial.nearest(load(spark, root, "local_morphotypes"), load(spark, root, "network_context"), "unit_id", "osmid", ("center_lon", "center_lat"), ("lon", "lat"))
    return got.select("unit_id", F.round("distance_m", 2).alias("distance_m"))


_HEX = """
WITH p AS (SELECT osmid, network_type, built_at, lon * 111320.0 * greatest(0.05, cos(radians(lat))) AS x, lat * 110540.0 AS y FROM network_context WHERE lon BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90),
r AS (SELECT *, 1500.0 / sqrt(3.0) AS dy, floor(y / (1500.0 / sqrt(3.0))) AS r0 FROM p),
s AS (SELECT *, ((r0 % 2 + 2) % 2) * 500 AS s0, (((r0 + 1) % 2 + 2) % 2) * 500 AS s1 FROM r), c AS (SELECT *, floor((x - s0) / 1000 + 0.5) AS c0, floor((x - s1) / 1000 + 0.5) AS c1 FROM s),
d AS (SELECT *, pow(x - (c0 * 1000 + s0), 2) + pow(y - r0 * dy, 2) AS d0, pow(x - (c1 * 1000 + s1), 2) + pow(y - (r0 + 1) * dy, 2) AS d1 FROM c)
SELECT CASE WHEN d0 <= d1 THEN r0 ELSE r0 + 1 END::BIGINT AS hex_row, CASE WHEN d0 <= d1 THEN c0 ELSE c1 END::BIGINT AS hex_col, count(*) AS nodes FROM d GROUP BY ALL
"""


@query(_HEX)
def hex_bins(spark, root):
    n = load(spark, root, "network_context").where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))
    row, col = geo.hex_cell(*geo.local_xy(F.col("lon"), F.col("lat"), F.col("lat")), 1000.0)
    return n.groupBy(row.alias("hex_row"), col.alias("hex_col")).agg(F.count("*").alias("nodes"))


def _diamonds(spark, root) -> DataFrame:
    at = lambda dx, dy: F.struct((F.col("center_lon") + dx).alias("lon"), (F.col("center_lat") + dy).alias("lat"))
    return load(spark, root, "candidate_city").select("city_id", F.array(at(0.2, 0.0), at(0.0, 0.2), at(-0.2, 0.0), at(0.0, -0.2), at(0.2, 0.0)).alias("ring"))


@query("SELECT c.city_id AS zone_id, n.osmid, n.network_type, n.built_at FROM network_context n JOIN candidate_city c ON least(abs(n.lon - c.center_lon), 360 - abs(n.lon - c.center_lon)) + abs(n.lat - c.center_lat) < 0.2 WHERE n.lon BETWEEN -180 AND 180 AND n.lat BETWEEN -90 AND 90")
def point_in_polygon(spark, root):
    n = load(spark, root, "network_context").where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).select("osmid", "network_type", "built_at", "lon", "lat")
    return spatial.points_in_polygons(n, _diamonds(spark, root), "lon", "lat", "ring").select(F.col("city_id").alias("zone_id"), "osmid", "network_type", "built_at")


@query("""
WITH p AS (SELECT c.city_id, n.x_scale FROM network_context n JOIN candidate_city c ON least(abs(n.lon - c.center_lon), 360 - abs(n.lon - c.center_lon)) + abs(n.lat - c.center_lat) < 0.2 WHERE n.lon BETWEEN -180 AND 180 AND n.lat BETWEEN -90 AND 90)
SELECT c.city_id, count(p.city_id) AS pixels, round(sum(x_scale), 2) AS total, round(avg(x_scale), 4) AS mean, CASE WHEN count(p.city_id) = 0 THEN 'no_overlap' WHEN count(x_scale) = 0 THEN 'no_data' ELSE 'ok' END AS status FROM (SELECT DISTINCT city_id FROM candidate_city) c LEFT JOIN p ON c.city_id = p.city_id GROUP BY c.city_id
""")
def zonal_stats(spark, root):
    n = load(spark, root, "network_context").where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).select("lon", "lat", "x_scale")
    z = spatial.zonal(n, _diamonds(spark, root), "lon", "lat", "ring", "city_id", F.col("x_scale"))
    return z.select("city_id", "pixels", F.round("sum", 2).alias("total"), F.round("mean", 4).alias("mean"), "status")


@query("""
WITH s AS (SELECT origin_center_lon AS x0, origin_center_lat AS y0, destination_center_lon - 360 * round((destination_center_lon - origin_center_lon) / 360) AS x1, destination_center_lat AS y1, straight_distance_m AS len FROM od_detour_samples WHERE abs(origin_center_lon) <= 180 AND abs(origin_center_lat) <= 90 AND abs(destination_center_lon) <= 180 AND abs(destination_center_lat) <= 90 AND straight_distance_m IS NOT NULL),
a AS (SELECT *, unnest(range(floor(least(x0, x1) / 0.05)::BIGINT, floor(greatest(x0, x1) / 0.05)::BIGINT + 1)) AS cx FROM s), b AS (SELECT *, unnest(range(floor(least(y0, y1) / 0.05)::BIGINT, floor(greatest(y0, y1) / 0.05)::BIGINT + 1)) AS cy FROM a),
t AS (SELECT *, CASE WHEN x1 = x0 THEN 0 ELSE least((cx * 0.05 - x0) / nullif(x1 - x0, 0), ((cx + 1) * 0.05 - x0) / nullif(x1 - x0, 0)) END AS a0, CASE WHEN x1 = x0 THEN 1 ELSE greatest((cx * 0.05 - x0) / nullif(x1 - x0, 0), ((cx + 1) * 0.05 - x0) / nullif(x1 - x0, 0)) END AS a1,
 CASE WHEN y1 = y0 THEN 0 ELSE least((cy * 0.05 - y0) / nullif(y1 - y0, 0), ((cy + 1) * 0.05 - y0) / nullif(y1 - y0, 0)) END AS b0, CASE WHEN y1 = y0 THEN 1 ELSE greatest((cy * 0.05 - y0) / nullif(y1 - y0, 0), ((cy + 1) * 0.05 - y0) / nullif(y1 - y0, 0)) END AS b1 FROM b),
p AS (SELECT cx, cy, len, least(1, a1, b1) - greatest(0, a0, b0) AS part FROM t)
SELECT CASE WHEN cx >= 3600 THEN cx - 7200 WHEN cx < -3600 THEN cx + 7200 ELSE cx END::BIGINT AS cx, cy::BIGINT AS cy, round(sum(part * len), 2) AS length_m FROM p WHERE part > 1e-9 GROUP BY ALL
""")
def edge_clip_lengths(spark, root):
    """Length of the samples' lines in each cell; a line across the 180th meridian goes the short way."""
    c = F.col
    od = load(spark, root, "od_detour_samples").where(c("origin_center_lon").between(-180, 180) & c("destination_center_lon").between(-180, 180) & c("origin_center_lat").between(-90, 90) & c("destination_center_lat").between(-90, 90) & c("straight_distance_m").isNotNull())
    od = od.select(c("origin_center_lon").alias("x0"), c("origin_center_lat").alias("y0"), geo.unwrapped(c("destination_center_lon"), c("origin_center_lon")).alias("x1"), c("destination_center_lat").alias("y1"), "straight_distance_m")
    s = spatial.clip_to_cells(od, "x0", "y0", "x1", "y1", 0.05).where(c("part") > 1e-9)
    cx = F.when(c("cx") >= 3600, c("cx") - 7200).when(c("cx") < -3600, c("cx") + 7200).otherwise(c("cx"))
    return s.groupBy(cx.cast("long").alias("cx"), c("cy").cast("long").alias("cy")).agg(F.round(F.sum(c("part") * c("straight_distance_m")), 2).alias("length_m"))


# graphs


def _edges(spark, root) -> DataFrame:
    return load(spark, root, "od_detour_samples").select(F.col("origin_unit_id").alias("u"), F.col("destination_unit_id").alias("v"), F.coalesce("drive_route_length_m", F.col("straight_distance_m") * 1.3).alias("length"))


_E = "SELECT origin_unit_id AS u, destination_unit_id AS v, coalesce(drive_route_length_m, straight_distance_m * 1.3) AS length FROM od_detour_samples"
_UND = f"SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS length FROM ({_E}) WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v AND length > 0 AND NOT isnan(length) GROUP BY ALL"


@query("SELECT l_orderkey AS way, l_partkey AS u, nxt AS v FROM (SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS nxt FROM lineitem) WHERE nxt IS NOT NULL")
def build_segments(spark, root):
    return graph.segments(load(spark, root, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey").select(F.col("l_orderkey").alias("way"), "u", "v")


@query(f"SELECT u, v, round(length, 3) AS length FROM ({_UND})")
def edge_dedupe_undirected(spark, root):
    return graph.undirected(_edges(spark, root), "length").select("u", "v", F.round("length", 3).alias("length"))


@query(f"WITH e AS ({_E}), b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v) SELECT u AS node, count(*) AS degree FROM b GROUP BY u")
def unique_neighbor_degree(spark, root):
    return graph.degree(_edges(spark, root))


_CC = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT u, v FROM ({_E}) WHERE u <> v), b AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
r(node, root) AS (SELECT u, u FROM b UNION SELECT b.v, r.root FROM r JOIN b ON r.node = b.u WHERE r.root < b.v),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node)
"""


@query(_CC + "SELECT node, component FROM c")
def connected_components(spark, root):
    return graph.components(_edges(spark, root))


@query(_CC + f", top AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT u, v, round(length, 3) AS length FROM ({_E}) s JOIN c ON s.u = c.node JOIN top USING (component)")
def largest_component(spark, root):
    return graph.largest_component(_edges(spark, root)).select("u", "v", F.round("length", 3).alias("length"))


_BOTH = f"SELECT u, v, length AS w FROM ({_UND}) UNION ALL SELECT v, u, length FROM ({_UND})"
_SP = """WITH RECURSIVE e AS MATERIALIZED ({edges}), s AS ({sources}), r(source, node, d) AS (SELECT source, node, 0.0::DOUBLE FROM s UNION SELECT r.source, e.v, r.d + e.w FROM r JOIN e ON r.node = e.u WHERE r.d + e.w <= {cut})"""
_MT = "SELECT 'MT01' AS source, unit_id AS node FROM local_morphotypes WHERE morphotype = 'MT01'"


@query(_SP.format(edges=_BOTH, sources=_MT + " GROUP BY ALL", cut=4000) + " SELECT node, round(min(d), 3) AS distance, true AS reached, round(greatest(0, 1 - min(d) / 4000), 6) AS score FROM r GROUP BY node")
def multi_source_bounded_sp(spark, root):
    """Network distance of each unit to the nearest unit of type MT01, up to 4 km."""
    e = graph.both_ways(graph.undirected(_edges(spark, root), "length"))
    src = load(spark, root, "local_morphotypes").where(F.col("morphotype") == "MT01").select(F.lit("MT01").alias("source"), F.col("unit_id").alias("node"))
    d = graph.shortest(e, src, "length", 4000.0)
    flag, score = graph.within(F.col("distance"), 4000.0)
    return d.select("node", F.round("distance", 3).alias("distance"), flag.alias("reached"), F.round(score, 6).alias("score"))


@query(None)  # a recursive query over all routes takes too long on whole tables; tested against Dijkstra on a small graph
def od_routing(spark, root):
    """Routes of all samples, however long, over the samples as directed edges."""
    od = load(spark, root, "od_detour_samples")
    pairs = od.select("od_id", F.col("origin_unit_id").alias("o"), F.col("destination_unit_id").alias("t"), F.col("straight_distance_m").alias("s")).distinct()
    wanted = pairs.where(F.col("o") != F.col("t")).select(F.col("o").alias("source"), F.col("t").alias("node"))
    paths = graph.shortest(_edges(spark, root), wanted.select("source", F.col("source").alias("node")), "length", targets=wanted)
    got = graph.route_pairs(pairs, paths, "o", "t", "s")
    return got.select("od_id", "o", "t", F.round("route_length_m", 3).alias("route_length_m"), F.round("detour_ratio", 6).alias("detour_ratio"), "route_found", "failure_reason")


_CHAINS = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT u || chr(31) || v AS e, u, v, length FROM ({_UND})), ends AS MATERIALIZED (SELECT e, u AS node, length FROM e UNION ALL SELECT e, v, length FROM e),
deg AS MATERIALIZED (SELECT node, count(*) AS k, min(e) AS a, max(e) AS b FROM ends GROUP BY node), l AS MATERIALIZED (SELECT a, b FROM deg WHERE k = 2 UNION SELECT b, a FROM deg WHERE k = 2),
r(e, root) AS (SELECT a, a FROM l UNION SELECT l.b, r.root FROM r JOIN l ON r.e = l.a WHERE r.root < l.b), c AS (SELECT e, min(root) AS root FROM r GROUP BY e),
g AS MATERIALIZED (SELECT e.e, coalesce(c.root, e.e) AS root, length FROM e LEFT JOIN c USING (e)), t AS (SELECT root, sum(length) AS length, count(*) AS parts FROM g GROUP BY root),
o AS (SELECT root, coalesce(min(CASE WHEN k <> 2 THEN node END), min(node)) AS u, coalesce(max(CASE WHEN k <> 2 THEN node END), min(node)) AS v FROM ends JOIN g USING (e) JOIN deg USING (node) GROUP BY root)
SELECT u, v, round(length, 3) AS length, parts FROM o JOIN t USING (root)
"""


@query(_CHAINS)
def contract_chains(spark, root):
    return graph.contract_chains(_edges(spark, root), "length").select("u", "v", F.round("length", 3).alias("length"), "parts")


@query(None)
def sampled_betweenness(spark, root):
    return graph.betweenness(_edges(spark, root))


# models


@query("""
WITH r AS (SELECT detour_ratio AS y, origin_type_confidence AS x, coalesce(od_pair_weight_raw, 0) AS w, city_id AS g FROM od_detour_samples WHERE isfinite(detour_ratio) AND isfinite(origin_type_confidence) AND isfinite(od_pair_weight_raw) AND od_pair_weight_raw > 0 AND city_id IS NOT NULL),
s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * x * x) AS sxx, sum(w * y) AS sy, sum(w * x * y) AS sxy FROM r),
b AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (sw * sxx - sx * sx) AS b0, sw * sxx - sx * sx AS det FROM s),
g AS (SELECT g, sum(w * (y - b0 - b1 * x)) AS u0, sum(w * x * (y - b0 - b1 * x)) AS u1 FROM r, b GROUP BY g), m AS (SELECT count(*) AS k, sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM g),
c AS (SELECT *, k / (k - 1.0) * (n - 1.0) / (n - 2.0) AS f FROM b, m)
SELECT 'Intercept' AS term, round(b0, 6) AS coef, round(sqrt((sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det) * f), 6) AS std_err, n AS nobs, k AS clusters FROM c
UNION ALL SELECT 'origin_type_confidence', round(b1, 6) + 0.0, round(sqrt((sx * sx * m00 - 2 * sx * sw * m01 + sw * sw * m11) / (det * det) * f), 6), n, k FROM c
""")
def wls_cluster_robust(spark, root):
    od = load(spark, root, "od_detour_samples").where(F.col("city_id").isNotNull())
    fit = model.wls(od, F.col("detour_ratio"), {"Intercept": F.lit(1.0), "origin_type_confidence": F.col("origin_type_confidence")}, F.col("od_pair_weight_raw"), "city_id")
    return fit.select("term", r6("coef", "coef"), F.round("std_err", 6).alias("std_err"), "nobs", "clusters")


_HC3 = """
WITH r AS (SELECT detour_ratio AS y, origin_type_confidence AS x, od_pair_weight_raw AS w FROM od_detour_samples WHERE isfinite(detour_ratio) AND isfinite(origin_type_confidence) AND isfinite(od_pair_weight_raw) AND od_pair_weight_raw > 0),
m AS (SELECT sum(w * x) / sum(w) AS mx FROM r), q AS (SELECT y, x - mx AS x, w FROM r, m), s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x * x) AS sxx, sum(w * y) / sum(w) AS a, sum(w * x * y) / sum(w * x * x) AS b FROM q),
u AS (SELECT x, n, sxx, b, pow(w * (y - a - b * x) / (1 - w * (1 / sw + x * x / sxx)), 2) AS u FROM q, s)
SELECT 'origin_type_confidence' AS term, round(max(b), 6) + 0.0 AS coef, round(sqrt(sum(u * x * x)) / max(sxx), 6) AS std_err, max(n) AS nobs, 'HC3' AS cov_type FROM u
"""


@query(_HC3)
def wls_hc3(spark, root):
    """A weighted fit without clusters: errors that allow for unequal variance and leverage."""
    fit = model.wls(load(spark, root, "od_detour_samples"), F.col("detour_ratio"), {"Intercept": F.lit(1.0), "origin_type_confidence": F.col("origin_type_confidence")}, F.col("od_pair_weight_raw"))
    return fit.where(F.col("term") != "Intercept").select("term", r6("coef", "coef"), F.round("std_err", 6).alias("std_err"), "nobs", "cov_type")


_ABSORBED = """
WITH r AS (SELECT detour_ratio AS y, origin_type_confidence AS x, od_pair_weight_raw AS w, city_id AS g FROM od_detour_samples WHERE isfinite(detour_ratio) AND isfinite(origin_type_confidence) AND isfinite(od_pair_weight_raw) AND od_pair_weight_raw > 0 AND city_id IS NOT NULL),
m AS (SELECT g, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM r GROUP BY g), q AS (SELECT y - my AS y, x - mx AS x, w, g FROM r JOIN m USING (g)), s AS (SELECT count(*) AS n, sum(w * x * x) AS sxx, sum(w * x * y) / sum(w * x * x) AS b FROM q),
c AS (SELECT g, sum(w * x * (y - b * x)) AS u FROM q, s GROUP BY g), k AS (SELECT count(*) AS k, sum(u * u) AS m FROM c)
SELECT 'origin_type_confidence' AS term, round(b, 6) + 0.0 AS coef, round(sqrt(m / (sxx * sxx) * k / (k - 1.0) * (n - 1.0) / (n - 1 - k)), 6) AS std_err, n AS nobs, k AS clusters, n - 1 - k AS df_resid FROM s, k
"""


@query(_ABSORBED)
def wls_absorbed(spark, root):
    """City effects taken out of a weighted fit, counted in its degrees of freedom, with errors by city."""
    od = load(spark, root, "od_detour_samples").where(F.col("city_id").isNotNull())
    fit = model.wls(od, F.col("detour_ratio"), {"origin_type_confidence": F.col("origin_type_confidence")}, F.col("od_pair_weight_raw"), "city_id", absorb="city_id")
    return fit.select("term", r6("coef", "coef"), F.round("std_err", 6).alias("std_err"), "nobs", "clusters", "df_resid")


LEVELS = [f"MT{i:02d}" for i in range(2, 11)]


@query(None)  # nine dummies: tested against explicit dummies of types and cities
def model_by_type(spark, root):
    """Detour by origin type with city effects absorbed, weighted and unweighted on the same rows."""
    od = load(spark, root, "od_detour_samples").where(F.col("city_id").isNotNull() & F.col("origin_morphotype").isNotNull() & clean.finite(F.col("detour_ratio")).isNotNull() & (F.col("od_pair_weight_raw") > 0))
    fit = lambda w, n: model.wls(od, F.col("detour_ratio"), model.dummies("origin_morphotype", LEVELS), w, "city_id", n, "city_id", [F.col("od_id"), F.col("loaded_at")])
    return model.compare_fits(fit(F.col("od_pair_weight_raw"), "weighted"), fit(None, "plain")).withColumn("level", text.term_level(F.col("term"))).withColumn("kind", text.term_kind(F.col("term")))


_TABLE_A = f"""
WITH a AS (SELECT city_id, origin_morphotype AS morphotype, count(*) AS pairs, sum(od_pair_weight_raw) AS weight, sum(CASE WHEN route_found THEN od_pair_weight_raw END) AS routed_weight,
  sum(CASE WHEN isfinite(detour_ratio) THEN od_pair_weight_raw * detour_ratio END) / nullif(sum(CASE WHEN isfinite(detour_ratio) THEN od_pair_weight_raw END), 0) AS detour, avg(origin_type_confidence) AS confidence
  FROM od_detour_samples WHERE city_id IS NOT NULL AND origin_morphotype IS NOT NULL GROUP BY ALL),
q AS ({_wq_sql("city_id, origin_morphotype", "detour_ratio", "od_pair_weight_raw", "od_detour_samples", dict(p50=0.5, p90=0.9))}),
c AS (SELECT city_id, ln(sum(CASE WHEN population_sum > 0 THEN population_sum END)) AS log_population, avg(quality_score) AS quality_score FROM local_morphotypes WHERE city_id IS NOT NULL GROUP BY city_id)
SELECT a.city_id, a.morphotype, pairs, round(weight, 6) AS weight, round(detour, 6) AS detour, round(ln(greatest(detour, 1e-9)), 6) AS log_detour, p50, p90, round(routed_weight / nullif(weight, 0), 6) AS routed_share, round(log_population, 6) AS log_population, round(quality_score, 6) AS quality_score,
 pairs >= 30 AS pairs_ge_30, pairs >= 100 AS pairs_ge_100, round(confidence, 6) AS confidence FROM a LEFT JOIN q ON a.city_id = q.city_id AND a.morphotype = q.origin_morphotype LEFT JOIN c ON a.city_id = c.city_id
"""


def _table_a(spark, root) -> DataFrame:
    c = F.col
    keys = ["city_id", "origin_morphotype"]
    od = load(spark, root, "od_detour_samples").where(c("city_id").isNotNull() & c("origin_morphotype").isNotNull())
    known = F.when(clean.finite(c("detour_ratio")).isNotNull(), c("od_pair_weight_raw"))
    a = od.groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum("od_pair_weight_raw").alias("weight"), F.sum(F.when(c("route_found"), c("od_pair_weight_raw"))).alias("routed_weight"), clean.safe_divide(F.sum(known * clean.finite(c("detour_ratio"))), F.sum(known)).alias("detour"), F.avg("origin_type_confidence").alias("confidence"))
    q = stats.weighted_quantiles(od, keys, "detour_ratio", "od_pair_weight_raw", {"p50": 0.5, "p90": 0.9})
    controls = load(spark, root, "local_morphotypes").where(c("city_id").isNotNull()).groupBy("city_id").agg(F.log(F.sum(F.when(c("population_sum") > 0, c("population_sum")))).alias("log_population"), F.avg("quality_score").alias("quality_score"))
    out = a.join(q, keys, "left").join(controls, "city_id", "left")
    return out.withColumnRenamed("origin_morphotype", "morphotype").withColumn("routed_share", clean.safe_divide(c("routed_weight"), c("weight"))).withColumn("log_detour", F.log(F.greatest(c("detour"), F.lit(1e-9))))


@query(_TABLE_A)
def city_type_model_table(spark, root):
    """One row per city and type: outcomes, weights, controls of the city and thresholds of sample size."""
    t = _table_a(spark, root)
    n = ("weight", "detour", "log_detour", "p50", "p90", "routed_share", "log_population", "quality_score", "confidence")
    return t.select("city_id", "morphotype", "pairs", *[r6(x, x) for x in n], (F.col("pairs") >= 30).alias("pairs_ge_30"), (F.col("pairs") >= 100).alias("pairs_ge_100"))


_OUTCOMES = ("log_detour", "detour", "p50", "p90", "routed_share")


def _suite(spark, root) -> DataFrame:


    t, c = materialize(_table_a(spark, root), "table_a"), F.col
    scenarios = {"main": F.lit(True), "high_confidence": c("confidence") >= 70, "pairs_ge_30": c("pairs") >= 30, "pairs_ge_100": c("pairs") >= 100, "unweighted": c("weight") > 0}
    fits = [model.Fit(f"A_{o}", s, o, c(o), None if s == "unweighted" else c("weight"), cond) for s, cond in scenarios.items() for o in _OUTCOMES]
    return model.least_squares(t, fits, model.dummies("morphotype", LEVELS), "city_id", "city_id", [c("city_id"), c("morphotype")])


@query(None)  # refits in every scenario: tested against explicit dummies
def model_suite(spark, root):
    """Five outcomes by type with city effects, refitted in five scenarios; failures are rows."""
    return _suite(spark, root).select("model", "scenario", "outcome", "term", "coef", "std_err", "t", "p", "ci_low", "ci_high", "nobs", "clusters", "df_resid", "cov_type", "status")


@query(None)
def controlled_interaction_fit(spark, root):
    """Degree of units by type and network with their interaction, controls of quality and confidence, errors by city."""
    u = load(spark, root, "local_morphotypes").where(F.col("city_id").isNotNull() & F.col("morphotype").isNotNull())
    kinds, nets = model.dummies("morphotype", LEVELS), model.dummies("network_type", ["walk"])
    terms = {"Intercept": F.lit(1.0), **kinds, **nets, **model.interactions(kinds, nets), "quality_score": F.col("quality_score"), "type_confidence": F.col("type_confidence")}
    fit = model.wls(u, F.col("average_node_degree"), terms, F.col("population_sum"), "city_id", "B_interaction", ids=[F.col("unit_id"), F.col("network_type"), F.col("loaded_at")])
    return fit.select("term", "coef", "std_err", "p", "nobs", "clusters", "cov_type", "status")


FEATURES = ["edge_density_km_per_km2_z", "average_node_degree_z", "four_way_share_z", "dead_end_share_z", "segment_length_mean_z", "orientation_order_z"]
ALL_FEATURES = [f"{m}_z" for m in METRICS]
_F = "(CASE WHEN isfinite({0}) THEN {0} END)".format


@query(" UNION ALL ".join(f"SELECT '{f}' AS feature, count({_F(f)}) AS n, round(stddev_pop({_F(f)}), 6) AS std, CASE WHEN count({_F(f)}) = 0 THEN 'all_missing' WHEN min({_F(f)}) = max({_F(f)}) THEN 'constant' ELSE 'ok' END AS status FROM local_morphotypes" for f in FEATURES))
def feature_qc(spark, root):
    return model.feature_qc(load(spark, root, "local_morphotypes"), FEATURES).select("feature", "n", F.round("std", 6).alias("std"), "status")


_Q = ", ".join(f"quantile_cont({_F(f)}, [0.005, 0.5, 0.995]) AS q_{f}" for f in ALL_FEATURES)


@query(f"WITH q AS (SELECT {_Q} FROM local_morphotypes WHERE sample_group = 'main') SELECT unit_id, network_type, loaded_at, " + ", ".join(f"round(CASE WHEN {_F(f)} IS NULL THEN q_{f}[2] ELSE least(greatest({f}, q_{f}[1]), q_{f}[3]) END, 6) + 0.0 AS {f}" for f in ALL_FEATURES) + " FROM local_morphotypes, q")
def impute_clip(spark, root):
    m = model.impute_clip(load(spark, root, "local_morphotypes"), ALL_FEATURES, F.col("sample_group") == "main")
    return m.select("unit_id", "network_type", "loaded_at", *[r6(f, f) for f in ALL_FEATURES])


def _reduced(spark, root) -> DataFrame:
    rows = model.impute_clip(load(spark, root, "local_morphotypes").select("unit_id", "network_type", "sample_group", "loaded_at", *ALL_FEATURES), ALL_FEATURES, F.col("sample_group") == "main")
    return model.pca(rows, ALL_FEATURES, 0.85, 3, 8)[0]


@query(None)
def pca_projection(spark, root):
    out = _reduced(spark, root)
    return out.select("unit_id", "network_type", "loaded_at", *[c for c in out.columns if c.startswith("pc")])


@query(None)
def gmm_typology(spark, root):
    """Mixture with the number of clusters by BIC, all units assigned with probability, margin, scope and reasons for doubt."""
    out = _reduced(spark, root)
    pcs = [c for c in out.columns if c.startswith("pc")]
    main = out.where(F.col("sample_group") == "main")
    k = model.choose_k(model.mixture_grid(main, pcs, list(range(4, 11)), seeds=[1, 2, 3])[0])
    fit = model.mixture_grid(main, pcs, [k], seeds=[1, 2, 3, 4, 5])[1][k]
    told = model.assignment_flags(model.assign(out, fit, pcs), F.col("sample_group") == "main")
    return told.select("unit_id", "network_type", "loaded_at", "cluster", "probability", "margin", "scope", "reason")


# contracts


@query("WITH d AS (SELECT unit_id, network_type, count(*) AS n FROM local_morphotypes GROUP BY ALL HAVING count(*) > 1) SELECT 'unit_network' AS \"check\", CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status, count(*) AS duplicate_keys, coalesce(sum(n - 1), 0)::BIGINT AS extra_rows FROM d")
def unique_key_check(spark, root):
    return rollup.unique_check(load(spark, root, "local_morphotypes"), ["unit_id", "network_type"], "unit_network")


_NODE = ("city_id", "network_type", "osmid", "lon", "lat", "x_scale", "y_scale", "source_path", "built_at")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL{' OR isnan(' + c + ')' if c in ('lon', 'lat', 'x_scale', 'y_scale') else ''}) AS nulls, count(*) AS \"rows\" FROM network_context" for c in _NODE))
def null_report(spark, root):
    return rollup.null_report(load(spark, root, "network_context"), list(_NODE))


@query("WITH e AS (SELECT DISTINCT city_id FROM candidate_city), a AS (SELECT DISTINCT city_id FROM local_morphotypes WHERE city_id IS NOT NULL) SELECT coalesce(e.city_id, a.city_id) AS city_id, CASE WHEN a.city_id IS NULL THEN 'missing' WHEN e.city_id IS NULL THEN 'extra' ELSE 'both' END AS state FROM e FULL JOIN a ON e.city_id = a.city_id")
def coverage_sets(spark, root):
    return rollup.coverage(load(spark, root, "candidate_city"), load(spark, root, "local_morphotypes").where(F.col("city_id").isNotNull()), "city_id")


_RUNS = ((1, 2), (2, 3), (3, 4))
_OF_RUN = "(SELECT city_id, count(*) AS n FROM local_morphology_metrics WHERE run_id = {0} AND city_id IS NOT NULL GROUP BY city_id)".format


@query(" UNION ALL ".join(f"SELECT '{x}-{y}' AS runs, coalesce(a.city_id, b.city_id) AS city_id, CASE WHEN b.city_id IS NULL THEN 'added' WHEN a.city_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM {_OF_RUN(x)} b FULL JOIN {_OF_RUN(y)} a ON a.city_id = b.city_id WHERE a.n IS DISTINCT FROM b.n" for x, y in _RUNS))
def manifest_diff(spark, root):
    """What each run has more, less or changed against the one before."""
    counts = materialize(load(spark, root, "local_morphology_metrics").where(F.col("city_id").isNotNull()).groupBy("run_id", "city_id").agg(F.count("*").alias("n")), "runs")
    per = lambda run: counts.where(F.col("run_id") == run).select("city_id", "n")
    steps = [rollup.changed(per(x), per(y), "city_id", "n").withColumn("runs", F.lit(f"{x}-{y}")) for x, y in _RUNS]
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


@query("""
SELECT 'repeated_entries' AS "check", CASE WHEN count(*) - count(DISTINCT entry_id) = 0 THEN 'pass' ELSE 'fail' END AS status, (count(*) - count(DISTINCT entry_id))::DOUBLE AS value, 0.0::DOUBLE AS expected FROM city_master
UNION ALL SELECT 'shares', CASE WHEN round(sum(target_share), 6) = 1 THEN 'pass' ELSE 'fail' END, round(sum(target_share), 6), 1.0 FROM source_weight
""")
def check_rows(spark, root):
    return rollup.checks({"repeated_entries": (load(spark, root, "city_master"), F.count("*") - F.count_distinct("entry_id"), 0), "shares": (load(spark, root, "source_weight"), F.round(F.sum("target_share"), 6), 1)})


@query("SELECT c.city_id, c.city_name_en, t.morphotype, t.unit_id, t.network_type, t.loaded_at FROM local_morphotypes t JOIN candidate_city c ON t.city_id = c.city_id")
def validated_join(spark, root):
    t = load(spark, root, "local_morphotypes").select("city_id", "morphotype", "unit_id", "network_type", "loaded_at").where(F.col("city_id").isNotNull())
    return rollup.join_validated(t, load(spark, root, "candidate_city").select("city_id", "city_name_en"), ["city_id"], "inner").select("city_id", "city_name_en", "morphotype", "unit_id", "network_type", "loaded_at")
