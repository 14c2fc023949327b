import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from gridloom.operators import ranks, stats


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(g, None if i % 97 == 0 else float(v), float(w)) for g, n in (("hot", 4000), ("a", 60), (None, 900), ("one", 1)) for i, (v, w) in enumerate(zip(np.where(rng.random(n) < 0.3, 0.0, rng.normal(0, 10.0 ** rng.integers(-4, 5, n), n)), rng.integers(0, 5, n)))]
    rows += [("hot", float("nan"), 1.0), ("hot", float("inf"), 1.0), ("void", None, 1.0)]
    return spark.createDataFrame(rows, "g string, x double, w double").withColumn("y", F.col("x") * 2 + 1)


def test_buckets_keep_the_order(spark):
    v = [-1e300, -5.0, -1.0000001, -1.0, -5e-324, 0.0, 5e-324, 1e-3, 0.0010001, 2.0, 1e308]
    got = [r.b for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").select("i", ranks.bucket(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) > 8


def test_quantiles_of_large_groups_are_exact(frame):
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    whole = {r.g: r for r in ranks.quantiles(frame, ["g"], {"x": F.col("x"), "y": F.col("y")}, probs).collect()}
    split = {r.g: r for r in ranks.quantiles(frame, ["g"], {"x": F.col("x"), "y": F.col("y")}, probs, small=100).collect()}
    assert whole.keys() == split.keys() == {"hot", "a", None, "one", "void"}
    for g in whole:
        for c in ("x", "y"):
            assert (whole[g][c] is None and split[g][c] is None) or np.allclose(whole[g][c], split[g][c], rtol=1e-12)
    one, = ranks.quantiles(frame, [], {"x": F.col("x")}, probs, small=10).collect()
    assert np.allclose(one.x, ranks.quantiles(frame, [], {"x": F.col("x")}, probs).first().x, rtol=1e-12)
    empty = frame.where("g = 'none'")
    assert ranks.quantiles(empty, [], {"x": F.col("x")}, probs, small=10).first().x is None and ranks.quantiles(empty, ["g"], {"x": F.col("x")}, probs, small=10).count() == 0


def test_running_sums_of_large_groups_are_whole(frame):
    rows = frame.where("abs(x) < 1e300").groupBy("g", "x", "w").agg(F.count("*").alias("k"))
    got = ranks.running(rows, ["g"], "x", {"s": F.col("w") * F.col("k"), "n": F.col("k")}, ["w"], small=100)
    order = Window.partitionBy("g").orderBy("x", "w").rowsBetween(Window.unboundedPreceding, 0)
    both = got.select("*", F.sum(F.col("w") * F.col("k")).over(order).alias("s2"), F.sum("k").over(order).alias("n2"))
    assert both.where("abs(s - s2) > 1e-6 or n <> n2").isEmpty() and got.count() == rows.count()


def test_weighted_statistics_do_not_depend_on_the_split(frame, monkeypatch):
    def run():
        q = {r.g: (r.a, r.b) for r in stats.weighted_quantiles(frame, ["g"], "x", "w", {"a": 0.25, "b": 0.9}).collect()}
        return q, {r.g: r.gini for r in stats.gini(frame, ["g"], "x").collect()}, {r.g: r.gini for r in stats.weighted_gini(frame.withColumn("x", F.abs("x")), ["g"], "x", "w").collect()}

    whole = run()
    monkeypatch.setattr(ranks.running, "__defaults__", (None, 100))
    for a, b in zip(whole, run()):
        assert a.keys() == b.keys() and all(np.allclose(np.array(a[g], dtype=float), np.array(b[g], dtype=float), rtol=1e-9, equal_nan=True) for g in a)
