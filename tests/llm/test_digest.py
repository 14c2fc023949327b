import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gridloom.llm import digest as d


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=60))
def test_universe_keeps_order(xs):
    x = np.array(xs)
    q = d.quantize(x)
    o = np.argsort(x, kind="stable")
    assert (np.diff(q[o]) >= 0).all() and q.min() >= 0 and q.max() < 1 << d.BITS
    ok = np.abs(x) > 1e-300
    assert np.allclose(d.value_of(q)[ok], x[ok], rtol=2.0 ** -(d.BITS - 13))


def rank_error(values, got, p):
    want = max(1, int(np.ceil(p * len(values) - 1e-9)))
    lo, hi = np.searchsorted(values, got * (1 - 1e-5), "left") + 1, np.searchsorted(values, got * (1 + 1e-5), "right")
    return max(0, lo - want, want - hi)


def test_compression_is_bounded_in_size_and_rank():
    rng = np.random.default_rng(1)
    x = np.sort(rng.lognormal(3, 1, 200_000))
    k = 640
    parts = [d.compress(*d.add(d.quantize(p) + (1 << d.BITS), np.ones(len(p), np.int64)), len(p) // k) for p in np.array_split(rng.permutation(x), 7)]
    n, c = d.add(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
    n, c = d.compress(n, c, len(x) // k)
    assert c.sum() == len(x) and len(n) <= 3 * k
    probs = (0.01, 0.25, 0.5, 0.9, 0.999)
    worst = max(rank_error(x, v, p) for v, p in zip(d.quantiles(n, c, probs), probs))
    assert 0 < worst <= d.BITS * (len(x) // k)


@pytest.mark.parametrize("kind", ["uniform", "tied", "skewed", "one_place", "both_signs"])
def test_no_inner_node_exceeds_its_share(kind):
    """Many parts, cut into subtrees like the tasks of `percentiles`, then compressed as a whole."""
    rng = np.random.default_rng(4)
    make = {"uniform": lambda: rng.uniform(0, 1, 60_000), "tied": lambda: rng.integers(0, 9, 60_000) + 0.5, "skewed": lambda: rng.exponential(1, 60_000) ** 4, "one_place": lambda: 5 + rng.uniform(0, 1e-7, 60_000), "both_signs": lambda: rng.normal(0, 1, 60_000)}[kind]
    k, parts, total = 640, [], 60 * 60_000
    for _ in range(60):
        parts.append(d.compress(*d.add(d.quantize(make()) + (1 << d.BITS), np.ones(60_000, np.int64)), 60_000 // k))
    n, c = d.add(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
    depth = np.frexp(n.astype(float))[1] - 1
    task = np.where(depth >= d.CUT, n >> np.maximum(0, depth - d.CUT), 0) % 7
    cut = [d.compress(n[task == t], c[task == t], total // k, d.CUT) for t in range(7)]
    n, c = d.add(np.concatenate([a for a, _ in cut]), np.concatenate([b for _, b in cut]))
    for n, c in ((n, c), d.compress(n, c, total // k)):
        assert c.sum() == total and c[n < 1 << d.BITS].max(initial=0) <= total // k
    assert len(n) <= 3 * k


def test_groups_missing_values_ties_and_merging(spark):
    rng = np.random.default_rng(2)
    rows = [(g, r, float(v)) for g in ("a", "b", None) for r in (1, 2) for v in rng.lognormal(2, 1, 700).round(1)]
    rows += [("a", 1, float("nan")), ("a", 1, float("inf")), ("a", 1, None), ("only", 1, None), ("tie", 1, 5.0), ("tie", 2, 5.0)]
    df = spark.createDataFrame(rows, "g string, r int, v double").withColumnRenamed("v", "value").repartition(5)
    for k in (100, 6400):
        whole = {r.g: r for r in d.percentiles(d.digests(df, ["g"], ["value"], k), ["g"], k=k).collect()}
        runs = d.merge(d.digests(df, ["g", "r"], ["value"], k), ["g", "r"])
        merged = {r.g: r for r in d.percentiles(d.merge(runs, ["g"]), ["g"], k=k).collect()}
        assert set(whole) == {"a", "b", None, "tie"} == set(merged)
        for got in (whole, merged):
            for g, r in got.items():
                vals = np.sort([v for x, _, v in rows if x == g and v is not None and np.isfinite(v)])
                assert r.n == len(vals)
                for p, c in zip(d.PROBS, ("p10", "p25", "p50", "p75", "p90", "p99")):
                    assert rank_error(vals, r[c], p) <= r.rank_error
    assert d.percentiles(d.digests(df.where("false"), ["g"], ["value"]), ["g"]).count() == 0
