import numpy as np
import pandas as pd
import pytest

from gridloom.operators.near import Cells, VantageTree, arc, near_pairs, nearest_points, unit_vectors


def haversine(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6_371_008.8 * np.arcsin(np.sqrt(a))


def test_tree_equals_brute_force():
    rng = np.random.default_rng(3)
    p = unit_vectors(rng.normal(10, 0.01, 3000), rng.normal(50, 0.01, 3000))
    p = np.vstack((p, p[:200], np.repeat(p[:1], 300, axis=0)))
    q = unit_vectors(rng.normal(10, 0.01, 200), rng.normal(50, 0.01, 200))
    i, j = VantageTree(p).within(q, 150.0)
    d = arc(q[:, None], p[None]) <= 150.0
    assert len(i) == d.sum() and set(zip(i.tolist(), j.tolist())) == set(zip(*map(lambda x: x.tolist(), np.nonzero(d))))


@pytest.mark.parametrize("per_cell", [20, 100_000])
def test_pairs_equal_brute_force(spark, per_cell):
    rng = np.random.default_rng(5)
    lon = np.concatenate((rng.normal(180, 0.002, 150), rng.normal(20, 0.002, 400), [0.0, 0.0, np.nan, 500.0]))
    lon = np.where(lon > 180, np.where(lon > 400, lon, lon - 360), lon)
    lat = np.concatenate((rng.normal(-10, 0.002, 150), rng.normal(89.9, 0.002, 400), [0.0, 0.0, 1.0, 1.0]))
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lon, lat))]
    units = [(f"u{i}", a + 0.0003, b - 0.0002) for i, a, b in pts[::3]] + [("twice", pts[0][1], pts[0][2]), ("twice", pts[0][1], pts[0][2]), (None, pts[1][1], pts[1][2]), ("nowhere", None, 1.0), ("zero", 0.0, 0.0)]
    q = spark.createDataFrame(units, "unit string, lon double, lat double").withColumnRenamed("lon", "x").withColumnRenamed("lat", "y")
    s = spark.createDataFrame(pts + [(0, *pts[0][1:])], "node long, lon double, lat double")
    got = {(r.unit, r.node) for r in near_pairs(q, s, 75.0, query_id="unit", point_id="node", query_at=("x", "y"), per_cell=per_cell).collect()}
    ok = lambda a, b: a is not None and b is not None and np.isfinite(a) and np.isfinite(b) and abs(a) <= 180 and abs(b) <= 90 and not (a == 0 and b == 0)
    want = {(u, i) for u, a, b in units if u and ok(a, b) for i, c, d in pts if ok(c, d) and haversine(a, b, c, d) <= 75}
    assert got == want and len(want) > 100


def test_empty_tables(spark):
    e = spark.createDataFrame([], "unit string, lon double, lat double")
    s = spark.createDataFrame([(1, 1.0, 1.0)], "node long, lon double, lat double")
    assert near_pairs(e, s, 75.0, query_id="unit", point_id="node").count() == 0
    assert near_pairs(s.withColumnRenamed("node", "unit"), s.where("node < 0"), 75.0, query_id="unit", point_id="node").count() == 0


def test_a_crowded_place_is_split_until_its_cells_are_small(spark):
    """500,000 of 500,050 points within a hundred metres."""
    rng = np.random.default_rng(11)
    p = pd.DataFrame({"node": np.arange(500_050), "lon": np.concatenate((rng.normal(7, 3e-4, 500_000), rng.uniform(-180, 180, 50))), "lat": np.concatenate((rng.normal(48, 3e-4, 500_000), rng.uniform(-80, 80, 50)))})
    s = spark.createDataFrame(p)
    cells = Cells(s.select(s.lon.alias("slon"), s.lat.alias("slat")), 4000, 8, 17)
    sizes = [r["count"] for r in cells.indexed.groupBy("cell").count().collect()]
    assert sum(sizes) == 500_050 and max(sizes) <= 16_000 and len(cells.levels) > 1
    u = pd.DataFrame({"unit": np.arange(60), "lon": np.concatenate((p["lon"][:40] + 1e-6, p["lon"][-20:] + 0.01)), "lat": np.concatenate((p["lat"][:40], p["lat"][-20:]))})
    d = arc(unit_vectors(u["lon"].to_numpy(), u["lat"].to_numpy())[:, None], unit_vectors(p["lon"].to_numpy(), p["lat"].to_numpy())[None])
    q = spark.createDataFrame(u)
    got = near_pairs(q, s, 5.0, query_id="unit", point_id="node", max_pivots=8).toPandas()
    assert set(zip(got["unit"], got["node"])) == set(zip(*np.nonzero(d <= 5.0)))
    best = nearest_points(q, s, query_id="unit", point_id="node", max_pivots=8).toPandas().set_index("unit")
    assert (best["node"].sort_index().to_numpy() == d.argmin(axis=1)).all() and np.allclose(best["distance_m"].sort_index(), d.min(axis=1))


def test_nearest_ties_nulls_and_empty_tables(spark):
    q = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", None, 1.0), (None, 1.0, 1.0), ("c", 0.0, 0.0), ("d", 179.9999, 0.0)], "unit string, lon double, lat double")
    s = spark.createDataFrame([(5, 1.0, 1.001), (4, 1.0, 1.001), (9, 1.0, 0.999), (7, -179.9999, 0.0), (1, None, None)], "node long, lon double, lat double")
    got = {r.unit: r.node for r in nearest_points(q, s, query_id="unit", point_id="node").collect()}
    assert got["d"] == 7 and got["a"] in (4, 9) and set(got) == {"a", "d"}
    assert nearest_points(q, s.where("node < 0"), query_id="unit", point_id="node").count() == 0
    assert nearest_points(q.where("unit = 'z'"), s, query_id="unit", point_id="node").count() == 0
