"""Robust scores, quality tiers, flags and review lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.clean import clip, finite
from gridloom.operators.ranks import null_safe, quantiles


def robust_scores(df: DataFrame, specs: dict[str, tuple[str, bool, bool]], by: list[str] | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Adds scores of 0 to 100 by name: (column, log1p first, lower is better), between the low and high percentile.

    Without spread every present value scores 100. Percentiles of all columns come from one pass, see `ranks`.
    """
    by = by or []

    def x(c: str, log: bool) -> Column:
        v = finite(F.col(c))
        return F.when(v.isNotNull(), F.log1p(F.greatest(v, F.lit(0.0)))) if log else v

    bounds = quantiles(df, by, {f"__q_{n}": x(c, log) for n, (c, log, _) in specs.items()}, [low, high])
    out = null_safe(df, bounds, by, "left")
    for n, (c, log, inverse) in specs.items():
        q, v = F.col(f"__q_{n}"), x(c, log)
        s = F.when(v.isNull(), F.lit(None)).when(~(q[1] > q[0]), F.lit(100.0)).otherwise(clip((v - q[0]) / F.nullif(q[1] - q[0], F.lit(0.0)) * 100.0, 0.0, 100.0))
        out = out.withColumn(n, 100.0 - s if inverse else s)
    return out.drop(*[f"__q_{n}" for n in specs])


def above_group_quantile(df: DataFrame, by: list[str], column: str, p: float, valid: Column, name: str) -> DataFrame:
    """Adds a flag: the value exceeds the p-quantile of the valid rows of its group. The thresholds, one row per group, are joined back."""
    cut = quantiles(df.where(F.coalesce(valid, F.lit(False))), by, {"__cut": F.col(column)}, [p])
    return null_safe(df, cut, by, "left").withColumn(name, F.coalesce(finite(F.col(column)) > F.col("__cut")[0], F.lit(False))).drop("__cut")


def review_list(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row (key, rule, evidence) per rule that a row breaks; all rules in one pass."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(n).alias("rule"), ev.cast("string").alias("evidence"))) for n, (cond, ev) in rules.items()]))
    return df.select(F.col(key), F.explode(hits).alias("h")).select(key, "h.rule", "h.evidence")
