from gridloom.llm import mixing


def test_rates():
    sizes = [("a", 1000, 0.5, 1), ("b", 100, 0.3, 4), ("c", 0, 0.1, 5), ("d", 50, 0.1, 2)]
    r = mixing.plan(sizes)
    t = {s: n * r[s] for s, n, *_ in sizes}
    total = sum(t.values())
    assert r["c"] == 0 and all(r[s] <= m + 1e-12 for s, _, _, m in sizes)
    assert all(abs(t[s] / total - w / 0.9) < 1e-9 for s, _, w, _ in sizes if s != "c")
    assert max(r[s] / m for s, _, _, m in sizes) > 1 - 1e-9  # no larger mix would do
    big = mixing.plan(sizes, 10_000)
    assert big == {"a": 1.0, "b": 4.0, "c": 0.0, "d": 2.0}
    some = mixing.plan(sizes, 1200)
    assert abs(sum(n * some[s] for s, n, *_ in sizes) - 1200) < 1e-6 and some["b"] == 4.0
    assert mixing.plan([]) == {}


def test_mix_and_report(spark):
    docs = spark.createDataFrame([(i, s, 10 + i % 7) for i, s in enumerate(["a"] * 3000 + ["b"] * 300 + ["x"] * 50 + [None] * 50)], "doc_id long, source string, n_tokens long").selectExpr("*", "1 AS rate", "2 AS target_share")
    w = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 5), ("empty", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, w)
    rep = {r.source: r for r in mixing.report(docs, w).collect()}
    assert set(rep) == {"a", "b", "empty"} and rep["empty"].mix_tokens == 0 and rep["empty"].share == 0
    for s, share in (("a", 2 / 3), ("b", 1 / 3)):
        assert abs(rep[s].share - share) < 0.02 and rep[s].most - rep[s].fewest <= 1 and rep[s].most <= {"a": 1, "b": 5}[s]
        assert m.where(f"source = '{s}'").count() == rep[s].copies
    assert sorted(m.collect()) == sorted(mixing.mix(docs.repartition(5), w).collect())
    assert mixing.mix(docs.where("false"), w).count() == 0 and mixing.report(docs.where("false"), w).count() == 3
    assert mixing.mix(docs, w.where("false")).count() == 0
