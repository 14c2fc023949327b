"""Cleaning, clipping, scoring and labelling expressions. All are built-in expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(c: Column) -> Column:
    """As double; null where it is no number, NaN or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b; null where b is null, 0 or not finite."""
    return F.try_divide(a, F.nullif(finite(b), F.lit(0.0)))


def safe_bool(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    """Bounded to [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def log_nonnegative(c: Column) -> Column:
    """ln(1 + max(c, 0)); null stays null."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def choose(*cases: tuple[Column, str], otherwise: str | None = None) -> Column:
    """First label whose condition holds."""
    out = F
    for cond, label in cases:
        out = out.when(F.coalesce(cond, F.lit(False)), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def reasons(**flags: Column) -> Column:
    """Names of the flags that hold, in order, without repeats, joined by ';'; '' if none does."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()]))
    return F.array_join(F.array_distinct(names), ";")


def weighted_average(*parts: tuple[Column, float]) -> Column:
    """Row-wise weighted mean over the parts that are present; null if none is."""
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return safe_divide(total, weight)


def mean_available(*cols: Column) -> Column:
    """Row-wise mean of what is present."""
    return weighted_average(*[(c, 1.0) for c in cols])


def geometric_confidence(*parts: tuple[Column, float, float]) -> Column:
    """Product of (clip(c, 0, 1) + 1e-6)^w over (c, w, value for null), bounded to [0, 1]."""
    logs = sum((F.log(clip(F.coalesce(c, F.lit(d)), 0.0, 1.0) + 1e-6) * w for c, w, d in parts), F.lit(0.0))
    return clip(F.exp(logs), 0.0, 1.0)


def penalty(*parts: tuple[Column, float]) -> Column:
    """100 minus the penalties of the flags that hold, bounded to [0, 100], 2 decimals."""
    lost = sum((F.when(F.coalesce(c, F.lit(False)), F.lit(float(p))).otherwise(F.lit(0.0)) for c, p in parts), F.lit(0.0))
    return F.round(clip(F.lit(100.0) - lost, 0.0, 100.0), 2)


def piecewise_weight(score: Column, tier: Column) -> Column:
    """1 for 'core'; .60 to .90 over scores 50 to 70 for 'sensitivity'; .25 to .50 over 0 to 50 for the rest; 4 decimals, half to even."""
    mid = clip(0.60 + (score - 50.0) / 20.0 * 0.30, 0.60, 0.90)
    low = clip(0.25 + score / 50.0 * 0.25, 0.25, 0.50)
    return F.bround(F.when(tier == "core", F.lit(1.0)).when(tier == "sensitivity", mid).otherwise(low), 4)


def closeness(ratio: Column, factor: float = 3.0) -> Column:
    """100 where the ratio is 1, 0 where it is off by `factor` either way; null for ratios that are not positive."""
    return F.when(ratio > 0, clip(100.0 * (1.0 - F.abs(F.log(ratio)) / F.log(F.lit(factor))), 0.0, 100.0))


def grid_cell(c: Column, step: float) -> Column:
    """Whole number of steps, half to even."""
    return F.bround(c / F.lit(step)).cast("long")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def feature_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def band(c: Column, low: float, high: float) -> Column:
    """'low', 'medium', 'high'; 'unknown' for null."""
    return choose((c.isNull(), "unknown"), (c <= low, "low"), (c >= high, "high"), otherwise="medium")


def best_axis(axes: dict[str, Column], least: float) -> Column:
    """Name of the largest axis if it reaches `least` (the first on ties), else 'mixed'."""
    top = F.greatest(*axes.values()) if len(axes) > 1 else next(iter(axes.values()))
    return choose((top.isNull() | (top < least), "mixed"), *[(c == top, n) for n, c in axes.items()])


def growth(new: Column, old: Column) -> Column:
    """ln((1 + new) / (1 + old)); null if either is missing or negative."""
    return F.when((new >= 0) & (old >= 0), F.log((1.0 + new) / (1.0 + old)))


def stability(spread: Column) -> Column:
    return safe_divide(F.lit(1.0), 1.0 + spread)


def signed(c: Column, digits: int = 2) -> Column:
    """Number with its sign, for reports."""
    return F.format_string(f"%+.{digits}f", c)


def all_close(a: Column, b: Column, atol: float = 1e-9, rtol: float = 1e-7) -> Column:
    """Both missing, or |a - b| <= atol + rtol |b|."""
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False)) | (a.isNull() & b.isNull())


def digest_of(*cols: Column) -> Column:
    """SHA-256 of the columns' texts; nulls are told apart from empty text."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cols]), 256)


def seed_of(key: Column, seed: int) -> Column:
    """Stable uniform draw in [0, 1) per key: the first 52 bits of the SHA-256 of seed and key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}|"), key), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
