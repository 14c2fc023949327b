"""Weighted and distributional statistics per group, as aggregations and windows.

Aggregates are algebraic wherever possible, so Spark combines them on the map side. Order statistics are exact and
sort within buckets of values only, see `ranks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.clean import finite, safe_divide
from gridloom.operators.ranks import null_safe, quantiles, running
from gridloom.runtime import free_names


def positive(w: Column) -> Column:
    """Weight, 0 where it is missing, not finite or not positive."""
    return F.greatest(F.coalesce(finite(w), F.lit(0.0)), F.lit(0.0))


def weighted_moments(x: Column, w: Column) -> dict[str, Column]:
    """mean, std (population), weighted (whether weights were used): weighted where weights sum to more than 0, else plain.

    One pass over sums of x, x^2 and weights, taken about 0; use on values whose spread is not tiny beside their size.
    """
    x = finite(x)
    w = F.when(x.isNotNull(), positive(w))
    sw, swx, swxx = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    use = sw > 0
    mean = F.when(use, swx / sw).otherwise(F.avg(x))
    var = F.when(use, F.greatest(F.lit(0.0), swxx / sw - (swx / sw) ** 2)).otherwise(F.var_pop(x))
    return {"mean": mean, "std": F.sqrt(var), "weighted": F.coalesce(use, F.lit(False))}


def weighted_mean(x: Column, w: Column, strict: bool = False) -> Column:
    """Weights that are not finite count 0, negative ones too; with `strict` rows of weight 0 don't count at all, which is the same.

    If no weight is left: the plain mean of all values.
    """
    x = finite(x)
    w = F.when(x.isNotNull(), positive(w))
    sw = F.sum(w)
    return F.when(sw > 0, F.sum(w * x) / F.nullif(sw, F.lit(0.0))).otherwise(F.avg(x))


def weighted_quantiles(df: DataFrame, keys: list[str], x: str, w: str, probs: dict[str, float]) -> DataFrame:
    """Per group the weighted quantiles by the mid-point rule: position (cumsum(w) - w/2) / sum(w), linear between, clamped at the ends.

    Rows with missing values or negative weights don't count; where weights sum to 0 all count alike. Ties are ordered by weight.
    """
    x_, w_, k_, t_, c_ = free_names(df, "__x", "__w", "__k", "__t", "__c")
    rows = df.select(*keys, finite(F.col(x)).alias(x_), F.coalesce(finite(F.col(w)), F.lit(0.0)).alias(w_)).where(F.col(x_).isNotNull() & (F.col(w_) >= 0))
    rows = rows.groupBy(*keys, x_, w_).agg(F.count("*").alias(k_))  # equal rows are one point from their first to their last position
    total = rows.groupBy(*keys).agg(F.sum(F.col(w_) * F.col(k_)).alias(t_), F.sum(k_).cast("double").alias(c_))
    rows = null_safe(rows, total, keys).withColumn(w_, F.when(F.col(t_) > 0, F.col(w_)).otherwise(F.lit(1.0))).withColumn(t_, F.when(F.col(t_) > 0, F.col(t_)).otherwise(F.col(c_)))
    rows = rows.groupBy(*keys, x_, w_, t_).agg(F.sum(k_).alias(k_))
    rows = running(rows, keys, x_, {c_: F.col(w_) * F.col(k_)}, [w_])
    first, last = (F.col(c_) - F.col(w_) * F.col(k_) + F.col(w_) / 2) / F.col(t_), (F.col(c_) - F.col(w_) / 2) / F.col(t_)
    rows = rows.withColumn("__first", first).withColumn("__last", last)
    first, last = F.col("__first"), F.col("__last")
    aggs = []
    for name, q in probs.items():
        low = F.max(F.when(last <= q, F.struct(last.alias("p"), F.col(x_).alias("x"))).when(first <= q, F.struct(first.alias("p"), F.col(x_).alias("x"))))
        high = F.min(F.when(first > q, F.struct(first.alias("p"), F.col(x_).alias("x"))).when(last > q, F.struct(last.alias("p"), F.col(x_).alias("x"))))
        between = low["x"] + (high["x"] - low["x"]) * (q - low["p"]) / (high["p"] - low["p"])
        aggs.append(F.when(low.isNull(), F.min(x_)).when(high.isNull(), F.max(x_)).otherwise(between).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def gini(df: DataFrame, keys: list[str], x: str, name: str = "gini") -> DataFrame:
    """Unweighted Gini per group; values are shifted to begin at 0 if any is negative; 0 for one value or a sum of 0."""
    x_, k_, m_, r_ = free_names(df, "__x", "__k", "__m", "__r")
    rows = df.select(*keys, finite(F.col(x)).alias(x_)).where(F.col(x_).isNotNull()).groupBy(*keys, x_).agg(F.count("*").alias(k_))
    rows = null_safe(rows, rows.groupBy(*keys).agg(F.least(F.lit(0.0), F.min(x_)).alias(m_)), keys)
    rows = running(rows.withColumn(x_, F.col(x_) - F.col(m_)), keys, x_, {r_: F.col(k_)})
    n, s = F.sum(k_), F.sum(F.col(x_) * F.col(k_))
    ranks = F.col(k_) * (F.col(r_) - F.col(k_)) + F.col(k_) * (F.col(k_) + 1) / 2  # of equal values together
    value = 2 * F.sum(ranks * F.col(x_)) / F.nullif(n * s, F.lit(0.0)) - (n + 1) / n
    return rows.groupBy(*keys).agg(F.when((n > 1) & (s > 0), value).otherwise(F.lit(0.0)).alias(name))


def weighted_gini(df: DataFrame, keys: list[str], x: str, w: str, name: str = "gini") -> DataFrame:
    """Weighted Gini per group from the trapezoids of the Lorenz curve; null if weights sum to 0, 0 if the values do."""
    x_, w_, a_, b_ = free_names(df, "__x", "__w", "__a", "__b")
    rows = df.select(*keys, finite(F.col(x)).alias(x_), positive(F.col(w)).alias(w_)).where(F.col(x_).isNotNull())
    rows = rows.groupBy(*keys, x_).agg(F.sum(w_).alias(w_))  # equal values lie on one line of the curve
    rows = running(rows, keys, x_, {b_: F.col(x_) * F.col(w_)})
    sw, sx = F.sum(w_), F.sum(F.col(x_) * F.col(w_))
    # trapezoid of a step: w * (2 b - x w), over both totals
    area = F.sum(F.col(w_) * (2 * F.col(b_) - F.col(x_) * F.col(w_)))
    value = F.when(sw <= 0, F.lit(None)).when(sx <= 0, F.lit(0.0)).otherwise(1 - area / F.nullif(sw * sx, F.lit(0.0)))
    return rows.groupBy(*keys).agg(value.cast("double").alias(name))


def entropy(df: DataFrame, keys: list[str], cls: str, w: Column | None = None, names: tuple[str, str, str] = ("entropy", "evenness", "classes")) -> DataFrame:
    """Shannon entropy (ln) of the weights of classes per group, the same over ln(classes), and the number of classes.

    0 where nothing is left or there is one class. Only class totals leave the map side.
    """
    t_ = free_names(df, "__t")[0]
    totals = df.where(F.col(cls).isNotNull()).groupBy(*keys, cls).agg(F.sum(positive(w) if w is not None else F.lit(1.0)).alias(t_)).where(F.col(t_) > 0)
    s, n = F.sum(t_), F.count("*")
    # -sum(p ln p) = ln(s) - sum(t ln t) / s
    h = F.greatest(F.lit(0.0), F.log(s) - F.sum(F.col(t_) * F.log(t_)) / s)
    return totals.groupBy(*keys).agg(h.alias(names[0]), F.when(n > 1, h / F.log(n.cast("double"))).otherwise(F.lit(0.0)).alias(names[1]), n.alias(names[2]))


def row_entropy(*shares: Column) -> Column:
    """Entropy (ln) over the positive shares of one row, made to sum to 1."""
    total = sum((positive(s) for s in shares), F.lit(0.0))
    parts = sum((F.when(positive(s) > 0, positive(s) * F.log(F.nullif(positive(s), F.lit(0.0)))).otherwise(F.lit(0.0)) for s in shares), F.lit(0.0))
    return F.when(total > 0, F.log(F.nullif(total, F.lit(0.0))) - parts / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0))


def summary(df: DataFrame, keys: list[str], columns: list[str], weight: str) -> DataFrame:
    """Wide summary per group: weighted mean, mean, median, p10, p90 of every column; one aggregation, and one for the ranks of all columns."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        x = finite(F.col(c))
        aggs += [weighted_mean(x, F.col(weight)).alias(f"{c}_wmean"), F.avg(x).alias(f"{c}_mean")]
    ranks = quantiles(df, keys, {f"__q_{c}": F.col(c) for c in columns}, [0.5, 0.1, 0.9])
    both = null_safe(df.groupBy(*keys).agg(*aggs), ranks, keys, "left")
    return both.select(*keys, "n", *[e for c in columns for e in (F.col(f"{c}_wmean"), F.col(f"{c}_mean"), *[F.col(f"__q_{c}")[i].alias(f"{c}_{q}") for i, q in enumerate(("median", "p10", "p90"))])])


def share(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds value / sum(value) of the group; uniform where the sum is 0. The totals, one row a group, are joined back."""
    s_, n_ = free_names(df, "__sum", "__count")
    out = null_safe(df, df.groupBy(*keys).agg(F.sum(value).alias(s_), F.count("*").alias(n_)), keys)
    return out.withColumn(name, F.when(F.col(s_) > 0, F.col(value) / F.nullif(F.col(s_), F.lit(0.0))).otherwise(1.0 / F.col(n_))).drop(s_, n_)


def spread(df: DataFrame, keys: list[str], x: str, name: str) -> DataFrame:
    """Coefficient of variation per group (population), for groups of at least three values."""
    return df.groupBy(*keys).agg(F.when(F.count(x) >= 3, safe_divide(F.stddev_pop(x), F.abs(F.avg(x)))).alias(name))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, mean, median, p90, max of each column, as rows (column, n, mean, median, p90, max)."""
    x = {c: finite(F.col(c)) for c in columns}
    one = df.agg(*[F.struct(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("max")).alias(f"s_{c}") for c, v in x.items()])
    one = null_safe(one, quantiles(df, [], {f"q_{c}": v for c, v in x.items()}, [0.5, 0.9]), [])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s_{c}")["n"].alias("n"), F.col(f"s_{c}")["mean"].alias("mean"), F.col(f"q_{c}")[0].alias("median"), F.col(f"q_{c}")[1].alias("p90"), F.col(f"s_{c}")["max"].alias("max")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
