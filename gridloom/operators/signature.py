"""Multiscale signatures: long statistics per key and metric, standardisation against a reference group, scale transfer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.clean import finite, safe_divide
from gridloom.operators.ranks import null_safe, quantiles
from gridloom.operators.stats import weighted_moments

STATISTICS = ("mean", "std", "q10", "q25", "q50", "q75", "q90", "n_valid", "valid_share")


def local_signature(df: DataFrame, keys: list[str], metrics: list[str], valid: Column, weight: str, spine: DataFrame | None = None) -> DataFrame:
    """(keys, metric, statistic, value): the metrics are unpivoted first, so one small set of aggregates serves all of them.

    Rows where `valid` fails count in n but give no value. Keys of `spine` without rows come out with n_valid 0.
    """
    ok = F.coalesce(valid, F.lit(False))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(ok, finite(F.col(m).cast("double"))).alias("x")) for m in metrics])
    rows = df.select(*keys, F.col(weight).alias("__w"), F.explode(cells).alias("__s")).select(*keys, "__w", F.col("__s.metric").alias("metric"), F.col("__s.x").alias("__x"))
    by = [*keys, "metric"]
    mom, n = weighted_moments(F.col("__x"), F.col("__w")), F.count("__x").cast("double")
    base = rows.groupBy(*by).agg(mom["mean"].alias("__mean"), mom["std"].alias("__std"), n.alias("__n"), (n / F.count("*")).alias("__share"))
    ranks = quantiles(rows.drop("__w"), by, {"__q": F.col("__x")}, [0.1, 0.25, 0.5, 0.75, 0.9], within=(df, keys))
    wide, q = null_safe(base, ranks, by, "left"), F.col("__q")
    values = (F.col("__mean"), F.col("__std"), q[0], q[1], q[2], q[3], q[4], F.col("__n"), F.col("__share"))
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), v.alias("value")) for s, v in zip(STATISTICS, values)])).alias("s")).select(*by, "s.statistic", "s.value")
    if spine is None:
        return long
    names = spine.select(*keys).distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("statistic")) for m in metrics for s in STATISTICS]))).select(*keys, "s.metric", "s.statistic")
    full = names.join(long, [*keys, "metric", "statistic"], "left")
    return full.withColumn("value", F.when(F.col("statistic").isin("n_valid", "valid_share"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))


def with_codes(df: DataFrame, source: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """Each row once for every code in a column of `source`, of which there may be `most`; more is an error."""
    codes = [r[0] for r in source.select(column).distinct().limit(most + 1).collect()]
    if len(codes) > most:
        raise ValueError(f"{column} has more than {most} codes")
    return df.withColumn(column, F.explode(F.array(*[F.lit(c) for c in sorted(codes, key=str)]).cast(f"array<{source.schema[column].dataType.simpleString()}>")))


def city_signature(df: DataFrame, keys: list[str], metrics: list[str], valid: Column) -> DataFrame:
    """Wide row to long (keys, metric, value), value null where the row is not valid."""
    ok = F.coalesce(valid, F.lit(False))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.when(ok, finite(F.col(m))).alias("value")) for m in metrics])
    return df.select(*keys, F.explode(cells).alias("s")).select(*keys, "s.metric", "s.value")


def standardize(df: DataFrame, by: list[str], columns: list[str], core: Column) -> DataFrame:
    """Adds <c>_z and <c>_status per column: z with mean and population deviation of the core rows of the partition.

    Status: ok, zero_std, too_few_fit_values (under two), missing_value. Parameters come from one aggregation, joined back,
    so no partition is ever sorted or held whole.
    """
    fit = df.where(F.coalesce(core, F.lit(False))).groupBy(*by).agg(*[a for c in columns for a in (F.count(finite(F.col(c))).alias(f"__n_{c}"), F.avg(finite(F.col(c))).alias(f"__m_{c}"), F.stddev_pop(finite(F.col(c))).alias(f"__s_{c}"))])
    keyed = fit.select(*[F.col(k).alias(f"__k_{k}") for k in by], *[F.col(f"__{p}_{c}") for c in columns for p in "nms"])
    cond = [df[k].eqNullSafe(keyed[f"__k_{k}"]) for k in by]
    out = df.join(keyed, cond, "left") if by else df.crossJoin(keyed)
    for c in columns:
        x, n, m, s = finite(F.col(c)), F.coalesce(F.col(f"__n_{c}"), F.lit(0)), F.col(f"__m_{c}"), F.col(f"__s_{c}")
        usable = (n >= 2) & (s > 0)
        out = out.withColumn(f"{c}_z", F.when(usable, (x - m) / s)).withColumn(f"{c}_status", F.when(n < 2, "too_few_fit_values").when(~(s > 0), "zero_std").when(x.isNull(), "missing_value").otherwise("ok"))
    return out.drop(*[f"__k_{k}" for k in by], *[f"__{p}_{c}" for c in columns for p in "nms"])


def pivot(df: DataFrame, keys: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """Long to wide with known columns, so no extra job looks for them; the largest of repeated cells."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values])


def transfer(df: DataFrame, keys: list[str], scale: str, value: str) -> DataFrame:
    """Features across scales: differences, ratios, spread over at least three scales and its stability."""
    at = {s: F.max(F.when(F.col(scale) == s, F.col(value))) for s in ("full_city", "core_5km", "hex_2km", "hex_1km")}
    n = F.count(value)
    cv = F.when(n >= 3, safe_divide(F.stddev_pop(value), F.abs(F.avg(value))))
    return df.groupBy(*keys).agg(
        (at["core_5km"] - at["full_city"]).alias("core_minus_full"), (at["hex_1km"] - at["hex_2km"]).alias("fine_minus_coarse"),
        safe_divide(at["hex_1km"], at["full_city"]).alias("local_to_full"), cv.alias("scale_cv"), (1.0 / (1.0 + cv)).alias("scale_stability"),
    )


def rank_features(df: DataFrame, group: list[str], value: str, tie: str, name: str = "rank") -> DataFrame:
    """Rank by absolute value, largest first, ties by `tie`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(F.abs(value).desc_nulls_last(), tie)))
