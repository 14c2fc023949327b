"""The whole job of queries that once did part of it, against brute force on small tables."""

import heapq
import math
import random
from pathlib import Path

import pytest

from gridloom import plans
from gridloom.operators import linkage, model


def table(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")


def test_od_routing_has_no_cutoff(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for i in range(90):
        o, t, s = rng.randrange(25), rng.randrange(25), float(rng.randint(500, 9000))
        rows.append((i, f"n{o}", f"n{t}", s, None if i % 9 == 0 else s * rng.uniform(1, 2)))
    rows += [(90, "x", "y", 4000.0, -1.0), (91, None, "y", 1.0, 1.0), (92, "x", "z", 5000.0, float("nan")), (93, "n1", "x", None, None)]
    table(spark, tmp_path, "od_detour_samples", rows, "od_id long, origin_unit_id string, destination_unit_id string, straight_distance_m double, drive_route_length_m double")
    adj = {}
    for _, o, t, s, d in rows:
        w = d if d is not None else None if s is None else s * 1.3
        if w is not None and w > 0:
            adj.setdefault(o, []).append((t, w))

    def dijkstra(s):
        dist, heap = {}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in dist:
                continue
            dist[x] = d
            for y, w in adj.get(x, []):
                heapq.heappush(heap, (d + w, y))
        return dist

    want = {}
    for i, o, t, s, _ in rows:
        d = None if o is None or o == t else dijkstra(o).get(t)
        want[i] = (d and round(d, 3), d is not None, "same_node" if o == t else "no_path" if d is None else None)
    got = {r.od_id: (r.route_length_m, r.route_found, r.failure_reason) for r in plans.queries()["od_routing"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[i][1:] == want[i][1:] and (want[i][0] is None or math.isclose(got[i][0], want[i][0], abs_tol=2e-3)) for i in want)
    assert max(d for d, *_ in got.values() if d) > 3000


def test_name_variants_of_every_list(spark, tmp_path):
    rows = [(1, "Ash; Elm (Old Elm)"), (2, "Oak|Fir; Yew [Yews|Yewton]"), (3, None), (4, "|"), (5, " ; ;")]
    table(spark, tmp_path, "ghs_ucdb_raw", rows, "raw_id long, gc_ucn_lis_2025 string")
    got = sorted(map(tuple, plans.queries()["name_variants"](spark, str(tmp_path)).collect()))
    assert got == sorted([(1, "Ash"), (1, "Elm (Old Elm)"), (1, "Elm"), (1, "Old Elm"), (2, "Oak|Fir"), (2, "Yew [Yews|Yewton]"), (2, "Yew"), (2, "Yews|Yewton"), (4, "|")])


def test_edges_across_the_180th_meridian(spark, tmp_path):
    rows = [(179.96, 10.01, -179.94, 10.01, 1000.0), (-179.99, 0.02, 179.99, 0.02, 200.0), (5.01, 0.01, 7.01, 3.01, 4000.0), (1.0, 1.0, 1.01, 1.01, None), (200.0, 1.0, 1.0, 1.0, 5.0)]
    table(spark, tmp_path, "od_detour_samples", rows, "origin_center_lon double, origin_center_lat double, destination_center_lon double, destination_center_lat double, straight_distance_m double")
    got = {(r.cx, r.cy): r.length_m for r in plans.queries()["edge_clip_lengths"](spark, str(tmp_path)).collect()}
    assert got[3599, 200] == 400 and got[-3600, 200] == 500 and got[-3599, 200] == 100 and got[3599, 0] == 100 and got[-3600, 0] == 100
    assert abs(sum(got.values()) - 5200) < 1 and all(-3600 <= x < 3600 for x, _ in got)


def test_zones_across_the_180th_meridian(spark, tmp_path):
    table(spark, tmp_path, "candidate_city", [("a", 179.9, 1.0), ("b", -179.95, 1.0), ("c", 20.0, 1.0)], "city_id string, center_lon double, center_lat double")
    nodes = [(1, "drive", None, 179.85, 1.0, 2.0), (2, "drive", None, -179.95, 1.01, 3.0), (3, "walk", None, 20.05, 1.0, 4.0), (4, "walk", None, -179.5, 1.0, 5.0)]
    table(spark, tmp_path, "network_context", nodes, "osmid long, network_type string, built_at date, lon double, lat double, x_scale double")
    inside = plans.queries()["point_in_polygon"](spark, str(tmp_path)).collect()
    assert sorted((r.zone_id, r.osmid) for r in inside) == [("a", 1), ("a", 2), ("b", 2), ("c", 3)]
    assert {r.city_id: (r.pixels, r.total) for r in plans.queries()["zonal_stats"](spark, str(tmp_path)).collect()} == {"a": (2, 5.0), "b": (1, 3.0), "c": (1, 4.0)}


def test_betweenness_draws_sources_in_every_component(spark, tmp_path):
    rows = [(f"{c}{i}", f"{c}{i + 1}") for c in "abcdefghij" for i in range(4)] + [("z0", f"z{i}") for i in range(1, 80)]
    table(spark, tmp_path, "od_detour_samples", [(*r, 1.0, 1.0) for r in rows], "origin_unit_id string, destination_unit_id string, straight_distance_m double, drive_route_length_m double")
    got = {r.node: r.betweenness for r in plans.queries()["sampled_betweenness"](spark, str(tmp_path)).collect()}
    for c in "abcdefghij":  # all five nodes are sources: ordered pairs through the node, over 5
        assert [round(got[f"{c}{i}"] * 5, 9) for i in range(5)] == [0, 6, 8, 6, 0]
    assert len(got) == 130 and round(got["z0"] * 64, 6) in (63 * 78, 64 * 78)


def test_linkage_scores_the_whole_block(spark):
    c = spark.createDataFrame([(1, "Amsterdam", "X"), (2, "Berton", "X"), (3, "Qqqq", "X")], "c int, n string, k string")
    r = spark.createDataFrame([(10, "Emsterdam", "X", 5.0), (11, "Burtan Hill", "X", 1.0), (12, "Corton", "X", 2.0), (13, "Hamsterdam", "Y", 9.0)], "r int, n string, k string, size double")
    got = {x.c: x for x in linkage.match_in_blocks(c, r, "c", "n", "k", "r", "n", "k", "size").collect()}
    assert (got[1].r, got[1].method, got[1].score) == (10, "low_confidence", 88.9)
    assert (got[2].r, got[2].method) == (None, "unmatched") and all(x.alternatives.count(";") == 2 for x in got.values())


@pytest.mark.parametrize("name", ["scale_signature_long", "city_signature_long", "signature_completeness", "description_stats", "distribution_summary", "signature_z_core_fit", "impute_clip"])
def test_all_17_metrics(spark, name):
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    column = next((c for c in ("metric", "column", "feature") if c in df.columns), None)
    assert (df.select(column).distinct().count() if column else sum(c.endswith("_z") for c in df.columns)) == 17


def test_typology_searches_the_whole_grid(spark, monkeypatch):
    real, seen = model.mixture_grid, []

    def small(df, features, ks, seeds=(1,), min_share=0.01, max_iter=30):
        seen.append((len(features), list(ks), len(seeds), max_iter))
        return real(df, features, [ks[0]], [1], min_share, 1)

    monkeypatch.setattr(model, "mixture_grid", small)
    plans.queries()["gmm_typology"](spark, "/root/testdata/sf0.001")
    assert [x[1:] for x in seen] == [([4, 5, 6, 7, 8, 9, 10], 3, 30), ([4], 5, 30)] and all(3 <= x[0] <= 8 for x in seen)


def test_readme_names_what_is_not_built():
    missing = (Path(__file__).resolve().parents[1] / "README.md").read_text().partition("Not built:")[2]
    assert all(x in missing for x in ("SRC5", "SRC8", "SRC17", "SRC21", "F28", "F29", "Q7", "Q13", "Q15"))
