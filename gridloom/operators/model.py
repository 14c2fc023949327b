"""Weighted least squares from sufficient statistics, cluster-robust errors, feature checks, components and mixtures."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridloom.functions.clean import clip, digest_of, finite
from gridloom.operators.ranks import null_safe, quantiles
from gridloom.runtime import materialize, release

MAX_TERMS, WARD_ROWS = 400, 3000


def dummies(column: str, levels: list[str]) -> dict[str, Column]:
    """Treatment coding against the level that is not listed."""
    return {f"C({column})[T.{v}]": F.when(F.col(column) == v, F.lit(1.0)).otherwise(F.lit(0.0)) for v in levels}


def interactions(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}:{y}": p * q for x, p in a.items() for y, q in b.items()}


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by the midpoint rule after x = sin^2 (t), smooth for a, b >= 1/2."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    t = np.arcsin(np.sqrt(x))
    n = 4000
    grid = (np.arange(n) + 0.5) * t / n
    logs = (2 * a - 1) * np.log(np.sin(grid)) + (2 * b - 1) * np.log(np.cos(grid)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return float(min(1.0, 2 * np.exp(logs).sum() * t / n))


def p_value(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_share(df / (df + t * t), df / 2, 0.5) if df > 0 else float("nan")


def t_quantile(df: float, tail: float = 0.05) -> float:
    """The t beyond which, to both sides, `tail` lies."""
    lo, hi = 0.0, 1e3
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if p_value(mid, df) > tail else (lo, mid)
    return hi


FIT = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("model", "scenario", "outcome", "term")], *[T.StructField(n, T.DoubleType()) for n in ("coef", "std_err", "t", "p", "ci_low", "ci_high")],
    *[T.StructField(n, T.LongType()) for n in ("nobs", "n_input", "clusters", "absorbed")], T.StructField("r_squared", T.DoubleType()), T.StructField("df_resid", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("cov_type", "sample_hash", "status")],
])


@dataclass(frozen=True)
class Fit:
    """One fit of a suite: its names, the rows it uses (a condition), its outcome and its weight (none: all alike)."""

    model: str
    scenario: str
    outcome: str
    value: Column
    weight: Column | None = None
    rows: Column | None = None


def least_squares(df: DataFrame, fits: list[Fit], terms: dict[str, Column], cluster: str | None = None, absorb: str | None = None, ids: list[Column] | None = None) -> DataFrame:
    """Coefficients of weighted least-squares fits on the same terms, one row per fit and term, see FIT.

    All fits come from the same few aggregations, whatever the number of rows or fits: means, moments about the means, scores.
    absorb: a column whose levels each have an effect of their own; columns are taken about its weighted means instead of
    carrying a dummy per level, and its levels count in the degrees of freedom. Covariance: the sandwich over score sums per
    cluster with factor g/(g-1) (n-1)/(n-k) if there are two clusters or more, else HC3. sample_hash: of `ids`, which name a row
    whatever its weight. Too few rows or a singular design give one row with a status, no exception.
    """
    spark, names, k = df.sparkSession, list(terms), len(terms)
    if k > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms; absorb fixed effects instead")
    constant = [n == "Intercept" for n in names]
    if absorb and any(constant):
        raise ValueError("an intercept is absorbed with the levels")
    cells = F.array(*[F.struct(
        F.lit(i).alias("fit"), (F.lit(True) if f.rows is None else F.coalesce(f.rows, F.lit(False))).alias("in"), finite(f.value.cast("double")).alias("y"), (F.lit(1.0) if f.weight is None else finite(f.weight.cast("double"))).alias("w"),
    ) for i, f in enumerate(fits)])
    xs = [f"x{i}" for i in range(k)]
    base = df.select(
        *[finite(c.cast("double")).alias(x) for x, c in zip(xs, terms.values())], F.coalesce(F.xxhash64(*ids) if ids else F.lit(0), F.lit(0)).alias("id"),
        (F.col(cluster) if cluster else F.lit("")).alias("g"), (F.col(absorb) if absorb else F.lit("")).alias("f"), F.explode(cells).alias("c"),
    ).where(F.col("c.in"))
    n_input = {r.fit: r.n for r in base.groupBy(F.col("c.fit").alias("fit")).agg(F.count("*").alias("n")).collect()}
    rows = stored = materialize(base.select("c.fit", "c.y", "c.w", *xs, "id", "g", "f").dropna().where(F.col("w") > 0), "fit")  # read by every step
    cols, by = ["y", *xs], ["fit", "f"] if absorb else ["fit"]
    # with neither levels nor an intercept nothing may be shifted; an intercept itself stays
    moved = [absorb is not None or (any(constant) and (i == 0 or not constant[i - 1])) for i in range(k + 1)]
    means = rows.groupBy(*by).agg(F.sum("w").alias("fw"), F.count("*").cast("double").alias("fn"), *[(F.sum(F.col(c) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0)) if m else F.lit(0.0)).alias(f"m_{c}") for c, m in zip(cols, moved)])
    centre = {} if absorb else {r.fit: [r[f"m_{c}"] for c in cols] for r in means.collect()}
    about = null_safe(rows, means if absorb else means.withColumns({"fw": F.lit(float("inf")), "fn": F.lit(float("inf"))}), by)
    rows = about.select("fit", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in cols], "w", "g", "id", "fw", "fn")
    x, y, w = [F.col(c) for c in xs], F.col("y"), F.col("w")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    square = lambda r, p: np.array([[r[f"{p}{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)
    sums = {r.fit: r for r in rows.groupBy("fit").agg(
        F.count("*").alias("n"), F.sum(F.col("id").cast("decimal(38,0)")).cast("string").alias("h"), F.sum(1.0 / F.col("fn")).alias("levels"), F.sum(w * y * y).alias("yy"), F.sum(w).alias("sw"), F.sum(w * y).alias("sy"),
        *[F.sum(w * v * y).alias(f"b{i}") for i, v in enumerate(x)], *[F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i, j in pairs],
    ).collect()}
    out, solved = [], {}
    for i, f in enumerate(fits):
        s = sums.get(i)
        n, levels = (s.n, round(s.levels) if absorb else 0) if s else (0, 0)
        why = "too_few_rows" if n < max(5, k + levels + 1) else None
        if not why:
            a, b = square(s, "a"), np.array([s[f"b{j}"] for j in range(k)], dtype=float)
            size = np.sqrt(np.maximum(np.diag(a), 0))
            scaled = a / np.outer(size, size) if (size > 0).all() else np.zeros((k, k))
            why = "singular_design" if np.linalg.matrix_rank(scaled, tol=1e-10, hermitian=True) < k else None
        if why:
            out.append((f.model, f.scenario, f.outcome, "__model_error__", *[None] * 6, n, n_input.get(i, 0), None, levels, None, None, None, None, why))
        else:
            inv = np.linalg.inv(scaled) / np.outer(size, size)
            solved[i] = (s, levels, inv, inv @ b, b)
    if solved:
        table = spark.createDataFrame([(i, [float(v) for v in beta], [float(v) for v in inv.ravel()]) for i, (_, _, inv, beta, _) in solved.items()], "fit int, beta array<double>, inv array<double>")
        # by arrays, so that the residual and the leverage stay small expressions, however many terms there are
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        known = rows.join(F.broadcast(table), "fit").withColumn("xa", F.array(*x)).withColumn("e", y - dot(F.col("xa"), F.col("beta")))
        per = known.groupBy("fit", "g").agg(*[F.sum(w * v * F.col("e")).alias(f"s{i}") for i, v in enumerate(x)])
        meat = {r.fit: r for r in per.groupBy("fit").agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).collect()} if cluster else {}
        alone = [i for i in solved if i not in meat or meat[i].g < 2]
        if alone:  # leverage of a row, with its part in the mean of its level
            line = lambda i: dot(F.col("xa"), F.slice(F.col("inv"), i * k + 1, F.lit(k)))
            h = w * (dot(F.col("xa"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), line)) + 1.0 / F.col("fw"))
            known = known.withColumn("u", F.pow(w * F.col("e") / F.greatest(F.lit(1e-12), 1 - h), F.lit(2.0)))
            hc3 = {r.fit: r for r in known.where(F.col("fit").isin(alone)).groupBy("fit").agg(*[F.sum(F.col("u") * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs]).collect()}
    release(stored)
    for i, (s, levels, inv, beta, b) in solved.items():
        f, groups = fits[i], meat[i].g if i in meat else None
        df_resid = s.n - k - levels
        cov, kind, df_t = (inv @ square(hc3[i], "m") @ inv, "HC3", df_resid) if i in alone else (inv @ square(meat[i], "m") @ inv * groups / (groups - 1) * (s.n - 1) / df_resid, "cluster", groups - 1)
        if any(constant):
            at, move = centre[i], np.eye(k)
            move[constant.index(True)] -= np.where(constant, 0.0, np.array(at[1:], dtype=float))
            beta, cov = move @ beta, move @ cov @ move.T
            beta[constant.index(True)] += at[0]
        se, wide = np.sqrt(np.maximum(0, np.diag(cov))), t_quantile(df_t)
        total = s.yy - (s.sy**2 / s.sw if any(constant) else 0.0)
        r2 = 1 - (s.yy - float(b @ inv @ b)) / total if total > 0 else None
        for t, c, d in zip(names, map(float, beta), map(float, se)):
            ratio = c / d if d > 0 else None
            out.append((f.model, f.scenario, f.outcome, t, c, d, ratio, p_value(ratio, df_t) if ratio is not None else None, c - wide * d, c + wide * d, s.n, n_input[i], groups, levels, r2, df_resid, kind, s.h, "ok"))
    return spark.createDataFrame(out, FIT)


def wls(df: DataFrame, outcome: Column, terms: dict[str, Column], weight: Column | None = None, cluster: str | None = None, model: str = "model", absorb: str | None = None, ids: list[Column] | None = None) -> DataFrame:
    """One fit, see `least_squares`."""
    return least_squares(df, [Fit(model, "main", "y", outcome, weight)], terms, cluster, absorb, ids)


def key_terms(fits: DataFrame) -> DataFrame:
    """Coefficients of fits that succeeded, without intercepts and interactions."""
    return fits.where((F.col("status") == "ok") & (F.col("term") != "Intercept") & ~F.col("term").contains(":"))


def compare_fits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Terms of two fits side by side, with whether the samples are the same and the signs agree."""
    x = a.select("term", F.col("coef").alias("coef_a"), F.col("sample_hash").alias("ha"))
    y = b.select("term", F.col("coef").alias("coef_b"), F.col("sample_hash").alias("hb"))
    return x.join(y, "term", "full").select("term", "coef_a", "coef_b", (F.col("coef_b") - F.col("coef_a")).alias("difference"), F.coalesce(F.signum("coef_a") == F.signum("coef_b"), F.lit(False)).alias("same_sign"), F.coalesce(F.col("ha") == F.col("hb"), F.lit(False)).alias("same_rows"))


def choose_reference(df: DataFrame, column: str, preferred: str | None = None) -> str | None:
    """The level that others are compared with: the preferred one if it occurs, else the first in order."""
    got = df.agg(F.max(F.when(F.col(column) == preferred, F.col(column))).alias("p"), F.min(column).alias("m")).first()
    return got.p or got.m


def sample_digest(df: DataFrame, *cols: str) -> DataFrame:
    """One digest of all rows, in whatever order: sum of row hashes and count."""
    return df.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(F.conv(F.substring(digest_of(*[F.col(c) for c in cols]), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")), 256).alias("digest"))


def feature_qc(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, distinct_like, std, status): all_missing, constant or ok, in one pass."""
    aggs = []
    for c in columns:
        x = finite(F.col(c))
        status = F.when(F.count(x) == 0, "all_missing").when(F.min(x) == F.max(x), "constant").otherwise("ok")
        aggs.append(F.struct(F.lit(c).alias("feature"), F.count(x).alias("n"), F.stddev_pop(x).alias("std"), status.alias("status")))
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def impute_clip(df: DataFrame, columns: list[str], fit_on: Column, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Missing values become the median, others are bounded by quantiles, all of the rows where `fit_on` holds."""
    fit = quantiles(df.where(F.coalesce(fit_on, F.lit(False))), [], {f"__q_{c}": F.col(c) for c in columns}, [low, 0.5, high])
    out = df.crossJoin(F.broadcast(fit))  # one row
    return out.select(*[F.when(finite(F.col(c)).isNull(), F.col(f"__q_{c}")[1]).otherwise(F.least(F.greatest(F.col(c), F.col(f"__q_{c}")[0]), F.col(f"__q_{c}")[2])).alias(c) if c in columns else F.col(c) for c in df.columns])


def pca(df: DataFrame, columns: list[str], target: float = 0.85, least: int = 3, most: int = 8) -> tuple[DataFrame, list[float]]:
    """df with pc1 ... and the explained shares: as many components as reach `target`, between least and most.

    Means and covariance from one aggregation; the rotation is an expression. Signs make the largest loading positive.
    """
    x = [F.col(c) for c in columns]
    s = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]).first()
    p = len(columns)
    cov = np.array([[s[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)], dtype=float)
    val, vec = np.linalg.eigh(cov)
    val, vec = np.maximum(val[::-1], 0), vec[:, ::-1]
    vec = vec * np.sign(vec[np.abs(vec).argmax(axis=0), range(p)])
    share = val / max(val.sum(), 1e-300)
    m = int(np.clip(np.searchsorted(np.cumsum(share), target) + 1, least, min(most, p)))
    parts = [sum(((c - float(s[f"m{i}"] or 0.0)) * float(vec[i, j]) for i, c in enumerate(x)), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(m)]
    return df.select("*", *parts), [float(v) for v in share[:m]]


def mixture_grid(df: DataFrame, features: list[str], ks: list[int], seeds: list[int] = (1,), min_share: float = 0.01, max_iter: int = 30):
    """(diagnostics rows, fitted models by k): log likelihood, AIC, BIC, least cluster share of full-covariance mixtures."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="__f").transform(df.select(*features)).select("__f").cache()
    n, d, rows, models = data.count(), len(features), [], {}
    for k in ks:
        fits = [GaussianMixture(k=k, seed=s, maxIter=max_iter, featuresCol="__f").fit(data) for s in seeds]
        model = max(fits, key=lambda m: m.summary.logLikelihood)
        ll, free = model.summary.logLikelihood, k - 1 + k * d + k * d * (d + 1) // 2
        share = min(model.weights)
        rows.append((k, ll, 2 * free - 2 * ll, math.log(n) * free - 2 * ll, float(share), share >= min_share))
        models[k] = model
    data.unpersist()
    return rows, models


def choose_k(rows: list[tuple], silhouettes: dict[int, float] | None = None) -> int:
    """Lowest BIC among those whose clusters are large enough, else the lowest of all; on ties the larger silhouette, then the smaller k."""
    fit = [r for r in rows if r[5]] or rows
    return min(fit, key=lambda r: (r[3], -(silhouettes or {}).get(r[0], 0.0), r[0]))[0]


def silhouette(df: DataFrame, features: list[str], cluster: str) -> float | None:
    """Mean silhouette by squared distances, from sums per cluster; null for fewer than two clusters."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    labels = {r[0]: i for i, r in enumerate(df.select(cluster).where(F.col(cluster).isNotNull()).distinct().orderBy(cluster).collect())}  # one row a cluster
    if len(labels) < 2:
        return None
    number = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col(cluster)].cast("double")
    rows = VectorAssembler(inputCols=features, outputCol="__f").transform(df.dropna(subset=[*features, cluster]).withColumn("__c", number))
    return ClusteringEvaluator(featuresCol="__f", predictionCol="__c", metricName="silhouette", distanceMeasure="squaredEuclidean").evaluate(rows)


def assignment_flags(df: DataFrame, core: Column, probability: str = "probability", margin: str = "margin", sure: float = 0.6, apart: float = 0.15) -> DataFrame:
    """Adds scope (main_fit or projected), low_confidence, ambiguous and their reason, ';' between several."""
    low, near = F.coalesce(F.col(probability) < sure, F.lit(True)), F.coalesce(F.col(margin) < apart, F.lit(True))
    out = df.withColumn("scope", F.when(F.coalesce(core, F.lit(False)), "main_fit").otherwise("projected")).withColumn("low_confidence", low).withColumn("ambiguous", near)
    return out.withColumn("reason", F.array_join(F.array_compact(F.array(F.when(low, "low_probability"), F.when(near, "ambiguous_cluster"), F.when(F.col("scope") == "projected", "projected"))), ";"))


def assign(df: DataFrame, model, features: list[str], prefix: str = "MT") -> DataFrame:
    """Adds cluster (numbered by weight, largest first), probability and margin to the second most likely."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    order = sorted(range(len(model.weights)), key=lambda i: (-model.weights[i], i))
    names = {i: f"{prefix}{r + 1:02d}" for r, i in enumerate(order)}
    out = model.setFeaturesCol("__f").setPredictionCol("__c").setProbabilityCol("__p").transform(VectorAssembler(inputCols=features, outputCol="__f").transform(df))
    p = F.array_sort(vector_to_array("__p"), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    label = F.create_map(*[x for i, n in names.items() for x in (F.lit(i), F.lit(n))])[F.col("__c")]
    return out.withColumn("cluster", label).withColumn("probability", p[0]).withColumn("margin", p[0] - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).drop("__f", "__c", "__p")


def cluster_scores(df: DataFrame, features: list[str], cluster: str) -> DataFrame:
    """One row: clusters, Calinski-Harabasz and Davies-Bouldin indices, from sums per cluster."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.var_pop(f).alias(f"v_{f}") for f in features]).collect()  # one row per cluster
    k, n = len(per), sum(r.n for r in per)
    spark: SparkSession = df.sparkSession
    schema = "clusters long, calinski_harabasz double, davies_bouldin double"
    if k < 2 or n <= k:
        return spark.createDataFrame([(k, None, None)], schema)
    m = np.array([[r[f"m_{f}"] for f in features] for r in per])
    c = np.array([r.n for r in per])
    inner = np.array([sum(r[f"v_{f}"] for f in features) for r in per])
    centre = (m * c[:, None]).sum(0) / n
    within_, between = (inner * c).sum(), (((m - centre) ** 2).sum(1) * c).sum()
    s = np.sqrt(inner)
    dist = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)) + np.eye(k)
    db = np.mean([max((s[i] + s[j]) / dist[i, j] for j in range(k) if j != i) for i in range(k)])
    return spark.createDataFrame([(k, float(between / (k - 1) / (within_ / (n - k))) if within_ > 0 else None, float(db))], schema)


def ward(points: np.ndarray, k: int) -> np.ndarray:
    """Ward clustering of a sample of at most WARD_ROWS on one machine: labels of k clusters."""
    n = len(points)
    if n > WARD_ROWS:
        raise ValueError(f"a diagnostic for at most {WARD_ROWS} rows, as distances of all pairs are held")
    label, size, centre = np.arange(n), np.ones(n), points.astype(float).copy()
    d = ((centre[:, None] - centre[None]) ** 2).sum(-1) / 2
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    for _ in range(n - max(1, k)):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        row = size * size[i] / (size + size[i]) * ((centre - centre[i]) ** 2).sum(-1)
        row[~alive] = np.inf
        row[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
    return np.unique(label, return_inverse=True)[1]


def bounded(c: Column) -> Column:
    return clip(c, 0.0, 1.0)
