import numpy as np
from pyspark.sql import functions as F

from gridloom.functions import clean, geo, text
from gridloom.operators import rollup, score, signature, stats


def frame(spark, rows, schema="g string, x double, w double"):
    return spark.createDataFrame(rows, schema)


def test_weighted_quantiles_against_interpolation(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=200).round(1), rng.integers(0, 4, 200).astype(float)
    rows = [("a", float(a), float(b)) for a, b in zip(x, w)] + [("zero", 1.0, 0.0), ("zero", 3.0, 0.0), ("none", None, 1.0), ("one", 5.0, 2.0), ("neg", 1.0, -1.0), ("neg", 2.0, 1.0)]
    got = {r.g: r for r in stats.weighted_quantiles(frame(spark, rows), ["g"], "x", "w", {"q1": 0.1, "q5": 0.5}).collect()}
    o = np.lexsort((w, x))
    p = (np.cumsum(w[o]) - w[o] / 2) / w.sum()
    assert np.isclose(got["a"].q5, np.interp(0.5, p, x[o])) and np.isclose(got["a"].q1, np.interp(0.1, p, x[o]))
    assert got["zero"].q5 == 2.0 and got["one"].q5 == 5.0 and got["neg"].q5 == 2.0 and "none" not in got


def test_ginis(spark):
    rows = [("a", v, 1.0) for v in (1.0, 2.0, 3.0, 10.0)] + [("same", 2.0, 1.0)] * 3 + [("one", 4.0, 1.0)] + [("neg", v, 1.0) for v in (-1.0, 0.0, 4.0)]
    df = frame(spark, rows)
    g = {r.g: r.gini for r in stats.gini(df, ["g"], "x").collect()}
    x = np.array([1, 2, 3, 10.0])
    assert np.isclose(g["a"], np.abs(x[:, None] - x).sum() / (2 * len(x) ** 2 * x.mean())) and abs(g["same"]) < 1e-12 and g["one"] == 0
    w = {r.g: r.gini for r in stats.weighted_gini(df, ["g"], "x", "w").collect()}
    assert np.isclose(w["a"], g["a"]) and abs(w["same"]) < 1e-12


def test_moments_fall_back_to_plain(spark):
    df = frame(spark, [("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 1.0, 0.0), ("b", 3.0, None), ("c", float("nan"), 1.0)])
    m = stats.weighted_moments(F.col("x"), F.col("w"))
    got = {r.g: r for r in df.groupBy("g").agg(*[c.alias(n) for n, c in m.items()]).collect()}
    assert got["a"].mean == 2.5 and got["a"].weighted and np.isclose(got["a"].std, np.sqrt(0.75))
    assert got["b"].mean == 2.0 and not got["b"].weighted and got["b"].std == 1.0
    assert got["c"].mean is None


def test_signature_covers_the_spine(spark):
    df = frame(spark, [("a", 1.0, 1.0), ("a", float("inf"), 1.0)])
    spine = spark.createDataFrame([("a",), ("b",)], "g string")
    got = {(r.g, r.statistic): r.value for r in signature.local_signature(df, ["g"], ["x"], F.lit(True), "w", spine).collect()}
    assert got["a", "n_valid"] == 1 and got["a", "valid_share"] == 0.5 and got["b", "n_valid"] == 0 and got["b", "mean"] is None


def test_standardize_statuses(spark):
    df = frame(spark, [("a", 1.0, 1.0), ("a", 3.0, 1.0), ("a", 9.0, 0.0), ("b", 2.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 1.0)])
    got = [(r.g, r.x_z, r.x_status) for r in signature.standardize(df, ["g"], ["x"], F.col("w") > 0).collect()]
    assert ("a", 7.0, "ok") in got and ("b", None, "too_few_fit_values") in got and ("c", None, "zero_std") in got


def test_expressions(spark):
    r = spark.range(1).select(
        clean.clip(F.lit(None).cast("double"), 0, 1).alias("a"), clean.safe_divide(F.lit(1.0), F.lit(0.0)).alias("b"), clean.reasons(x=F.lit(True), y=F.lit(None).cast("boolean"), z=F.lit(True)).alias("c"),
        clean.finite(F.lit("nan")).alias("d"), clean.weighted_average((F.lit(None).cast("double"), 1.0), (F.lit(4.0), 2.0)).alias("e"), geo.orientation_bin(F.lit(0.0), F.lit(0.0)).alias("f"), geo.orientation_bin(F.lit(-1.0), F.lit(0.0)).alias("g"),
        text.clean_text(F.lit("Ünter & [x] Øst!")).alias("h"), text.term_level(F.lit("C(t)[T.MT03]")).alias("i"), clean.grid_cell(F.lit(2.5), 1.0).alias("j"), clean.best_axis({"p": F.lit(0.1), "q": F.lit(0.5)}, 0.25).alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == (None, None, "x;z", None, 4.0, -1, 18, "unter and ost", "MT03", 2, "q")


def test_wkb_points(spark):
    import struct

    rows = [(struct.pack("<BIdd", 1, 1, *p),) for p in ((12.5, -7.25), (-179.9, 0.1), (0.0, 5.0))] + [(b"\x00",), (None,)]
    lon, lat = geo.wkb_point(F.col("g"))
    got = [(r.x, r.y) for r in spark.createDataFrame(rows, "g binary").select(lon.alias("x"), lat.alias("y")).collect()]
    assert got == [(12.5, -7.25), (-179.9, 0.1), (0.0, 5.0), (None, None), (None, None)]


def test_robust_score_without_spread(spark):
    df = frame(spark, [("a", 5.0, 1.0), ("a", 5.0, 1.0), ("a", None, 1.0)])
    assert [r.s for r in score.robust_scores(df, {"s": ("x", False, False)}).collect()] == [100.0, 100.0, None]


def test_samples_and_guards(spark):
    df = spark.createDataFrame([(f"g{i % 2}", i, float(i % 5)) for i in range(200)], "g string, id int, w double")
    one = rollup.balanced_sample(df, ["g"], "id", 10, 1)
    assert one.count() == 20 and sorted(one.collect()) == sorted(rollup.balanced_sample(df.repartition(7), ["g"], "id", 10, 1).collect())
    drawn = rollup.sample_with_replacement(df.limit(50).withColumnRenamed("id", "o"), df, "g", "o", "id", "w", 200, 3)
    assert drawn.count() == 50 * 200
    freq = {r.w: r.n for r in drawn.join(df.select("id", "w"), "id").groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert 0.0 not in freq and abs(freq[4.0] / freq[2.0] - 2) < 0.2
    try:
        rollup.join_validated(df, df, ["g"]).count()
        raise AssertionError("no failure")
    except Exception as e:
        assert "repeats a key" in str(e)
