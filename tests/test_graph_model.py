import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import graph, linkage, model, spatial


def edges(spark, n=60, m=70, seed=4):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 9))) for _ in range(m)] + [(5, 5, 1.0), (None, 3, 1.0)]
    return rows, spark.createDataFrame(rows, "u int, v int, length double")


def test_components(spark):
    rows, e = edges(spark)
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v, _ in rows:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(e, spark.createDataFrame([(999,)], "n int")).collect()}
    assert got == {x: find(x) for x in parent} | {999: 999}


def test_long_path_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)], "u int, v int")
    assert {r.component for r in graph.components(e).collect()} == {0}


def test_shortest_paths(spark):
    rows, e = edges(spark)
    adj = {}
    for u, v, w in rows:
        if u is not None:
            adj.setdefault(u, []).append((v, w))

    def dijkstra(s):
        dist, heap = {}, [(0.0, s)]
        while heap:
            d, x = heapq.heappop(heap)
            if x in dist or d > 15:
                continue
            dist[x] = d
            for y, w in adj.get(x, []):
                heapq.heappush(heap, (d + w, y))
        return dist

    src = spark.createDataFrame([(s, s) for s in (1, 2, 3)], "source int, node int")
    got = {(r.source, r.node): r.distance for r in graph.shortest(e, src, "length", 15.0).collect()}
    assert got == {(s, n): d for s in (1, 2, 3) for n, d in dijkstra(s).items()}


def test_betweenness_of_a_path_and_of_all_sources(spark):
    rows, e = edges(spark, 20, 30)
    nodes = sorted({x for u, v, _ in rows if u is not None and u != v for x in (u, v)})
    adj = {n: set() for n in nodes}
    for u, v, _ in rows:
        if u is not None and u != v:
            adj[u].add(v), adj[v].add(u)
    b = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, pred, sigma, dist, queue = [], {n: [] for n in nodes}, dict.fromkeys(nodes, 0.0), {s: 0}, [s]
        sigma[s] = 1.0
        for x in queue:
            order.append(x)
            for y in adj[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
                    pred[y].append(x)
        dep = dict.fromkeys(nodes, 0.0)
        for y in reversed(order):
            for x in pred[y]:
                dep[x] += sigma[x] / sigma[y] * (1 + dep[y])
            if y != s:
                b[y] += dep[y]
    got = {r.node: r.betweenness * len(nodes) for r in graph.betweenness(e.where("u is not null"), len(nodes)).collect()}
    assert all(abs(got[n] - b[n]) < 1e-9 for n in nodes)


def test_chains(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 3.0), ("d", "x", 1.0), ("d", "y", 1.0)], "u string, v string, length double")
    got = {(r.u, r.v): (r.length, r.parts) for r in graph.contract_chains(e, "length").collect()}
    assert got == {("a", "d"): (6.0, 3), ("d", "x"): (1.0, 1), ("d", "y"): (1.0, 1)}


def test_wls_and_failures(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=300), rng.integers(0, 12, 300)
    y, w = 2 + 3 * x + rng.normal(size=300), rng.uniform(0.5, 2, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(y, x, w, g)] + [(None, 1.0, 1.0, 1)], "y double, x double, w double, g int")
    fit = {r.term: r for r in model.wls(df, F.col("y"), {"Intercept": F.lit(1.0), "x": F.col("x")}, F.col("w"), "g").collect()}
    z = np.column_stack((np.ones(300), x))
    inv = np.linalg.inv(z.T @ (z * w[:, None]))
    beta = inv @ z.T @ (w * y)
    s = np.array([(z * (w * (y - z @ beta))[:, None])[g == k].sum(0) for k in range(12)])
    cov = inv @ (s.T @ s) @ inv * 12 / 11 * 299 / 298
    assert np.allclose([fit["Intercept"].coef, fit["x"].coef], beta) and np.allclose([fit["Intercept"].std_err, fit["x"].std_err], np.sqrt(np.diag(cov)))
    assert model.wls(df.limit(2), F.col("y"), {"x": F.col("x")}).first().status == "too_few_rows"
    assert model.wls(df, F.col("y"), {"x": F.col("x"), "x2": F.col("x") * 2}).first().status == "singular_design"


def test_absorbed_levels_equal_explicit_dummies(spark):
    rng = np.random.default_rng(5)
    n, levels = 400, 9
    f, x1 = rng.integers(0, levels, n), rng.normal(1000, 1, n)
    x2, w = (rng.random(n) < 0.4).astype(float), rng.uniform(0.5, 2, n)
    y = 5 + 0.5 * x1 - 2 * x2 + f + rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, t[:-1]), int(t[-1])) for i, t in enumerate(zip(y, x1, x2, w, f))], "id int, y double, x1 double, x2 double, w double, f int")
    terms = {"x1": F.col("x1"), "x2": F.col("x2")}
    z = np.column_stack((x1 - 1000, x2, *[(f == k).astype(float) for k in range(levels)]))
    inv = np.linalg.inv(z.T @ (z * w[:, None]))
    beta = inv @ z.T @ (w * y)
    e = y - z @ beta
    s = np.array([(z * (w * e)[:, None])[f == k].sum(0) for k in range(levels)])
    cov = inv @ (s.T @ s) @ inv * levels / (levels - 1) * (n - 1) / (n - 2 - levels)
    got = model.wls(df, F.col("y"), terms, F.col("w"), "f", absorb="f", ids=[F.col("id")]).collect()
    assert np.allclose([r.coef for r in got], beta[:2]) and np.allclose([r.std_err for r in got], np.sqrt(np.diag(cov))[:2]) and got[0].absorbed == levels and got[0].df_resid == n - 2 - levels
    lever = w * np.einsum("ij,jk,ik->i", z, inv, z)
    u = (w * e / (1 - lever)) ** 2
    hc3 = inv @ (z.T @ (z * u[:, None])) @ inv
    alone = model.wls(df, F.col("y"), terms, F.col("w"), absorb="f").collect()
    assert alone[0].cov_type == "HC3" and np.allclose([r.std_err for r in alone], np.sqrt(np.diag(hc3))[:2])
    both = model.compare_fits(model.wls(df, F.col("y"), terms, F.col("w"), "f", absorb="f", ids=[F.col("id")]), model.wls(df, F.col("y"), terms, None, "f", absorb="f", ids=[F.col("id")])).collect()
    assert all(r.same_rows for r in both)
    many = model.least_squares(df, [model.Fit("m", "all", "y", F.col("y"), F.col("w")), model.Fit("m", "half", "y", F.col("y"), None, F.col("id") < 200), model.Fit("m", "none", "y", F.col("y"), None, F.col("id") < 0)], terms, "f", "f")
    assert {(r.scenario, r.status) for r in many.collect()} == {("all", "ok"), ("half", "ok"), ("none", "too_few_rows")}


def test_student_t():
    assert abs(model.p_value(2.228, 10) - 0.05) < 1e-4 and abs(model.t_quantile(30) - 2.0423) < 1e-3 and abs(model.p_value(12.706, 1) - 0.05) < 1e-4


def test_pca_and_mixture(spark):
    rng = np.random.default_rng(3)
    pts = np.vstack((rng.normal(0, 1, (150, 4)), rng.normal(8, 1, (100, 4))))
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "a double, b double, c double, d double")
    out, share = model.pca(df, list("abcd"), 0.85, 2, 3)
    c = pts - pts.mean(0)
    want = np.linalg.eigvalsh(c.T @ c / len(pts))[::-1]
    assert np.allclose(share, (want / want.sum())[: len(share)]) and abs(out.agg(F.avg("pc1")).first()[0]) < 1e-9
    rows, models = model.mixture_grid(df, ["a", "b"], [2, 3], max_iter=20)
    assert model.choose_k(rows) in (2, 3)
    got = model.assign(df, models[2], ["a", "b"])
    assert {r.cluster: r.n for r in got.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {"MT01": 150, "MT02": 100}
    assert model.cluster_scores(got, list("abcd"), "cluster").first().calinski_harabasz > 100
    assert len(set(model.ward(pts[::5], 2))) == 2
    assert model.silhouette(got, list("abcd"), "cluster") > 0.8 and model.silhouette(got.where("cluster = 'MT01'"), list("abcd"), "cluster") is None
    flags = model.assignment_flags(got, F.col("a") < 4).groupBy("scope", "reason").count().collect()
    assert {(r.scope, r.reason) for r in flags} == {("main_fit", ""), ("projected", "projected")}
    assert model.choose_k([(3, 0, 0, 5.0, 0.2, True), (2, 0, 0, 5.0, 0.2, True)]) == 2 and model.choose_k([(3, 0, 0, 5.0, 0.2, True), (2, 0, 0, 5.0, 0.2, True)], {3: 0.9}) == 3


def test_nearest_grows_its_radius(spark):
    q = spark.createDataFrame([("a", 0.5, 0.5), ("b", 100.0, 60.0), ("c", None, 1.0)], "q string, x double, y double")
    p = spark.createDataFrame([(1, 0.5001, 0.5), (2, -80.0, -60.0), (3, 0.5001, 0.5)], "p long, lon double, lat double")
    got = {r.q: r.p for r in spatial.nearest(q, p, "q", "p", ("x", "y"), ("lon", "lat")).collect()}
    assert got == {"a": 1, "b": 1}


def test_linkage_methods(spark):
    c = spark.createDataFrame([(1, "São Port", "X"), (2, "Port East", "X"), (3, "Lakevile", "X"), (4, "Nowhere", "X"), (5, None, None)], "c int, n string, k string")
    r = spark.createDataFrame([(10, "Sao Port", "X", 5.0), (11, "East Port", "X", 1.0), (12, "Lakeville", "X", 2.0), (13, "Sao Port", "Y", 9.0)], "r int, n string, k string, size double")
    got = {x.c: (x.r, x.method) for x in linkage.match_in_blocks(c, r, "c", "n", "k", "r", "n", "k", "size").collect()}
    assert got == {1: (10, "exact"), 2: (11, "tokens"), 3: (12, "fuzzy"), 4: (None, "unmatched"), 5: (None, "unmatched")}


def test_reasons_of_missing_routes(spark):
    pairs = spark.createDataFrame([(1, "a", "b", 2.0), (2, "a", "a", 0.0), (3, "a", "c", 5.0), (4, "a", "z", 1.0), (5, None, "a", 1.0)], "i int, o string, t string, s double")
    paths = spark.createDataFrame([("a", "b", 3.0)], "source string, node string, distance double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "node string")
    got = {r.i: (r.route_found, r.detour_ratio, r.failure_reason) for r in graph.route_pairs(pairs, paths, "o", "t", "s", nodes).collect()}
    assert got == {1: (True, 1.5, None), 2: (False, None, "same_node"), 3: (False, None, "no_path"), 4: (False, None, "node_not_found"), 5: (False, None, "node_not_found")}
