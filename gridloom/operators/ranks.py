"""Exact order statistics of groups of any size, without ever sorting or holding a whole group.

Values fall into buckets of an ordered scale, 64 to a doubling, so bucket counts (or sums of weights), combined before they
are shuffled, tell how much lies below each bucket. Only within buckets are values sorted, equal ones counted together; for
quantiles only within the few buckets that hold the ranks asked for. A group has at most 2 x 140,000 buckets. Groups of at
most `SMALL` rows, known from a count, need none of this: they are one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.functions.clean import finite
from gridloom.runtime import free_names

PER_DOUBLING, MIDDLE = 64, 70_000
#: Rows up to which a group is sorted or held as a whole.
SMALL = 100_000


def bucket(x: Column) -> Column:
    """Place of a finite value on the scale; never decreases as x grows."""
    size = F.floor(PER_DOUBLING * F.log2(F.abs(x))) + MIDDLE
    return F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; `right` has each of its keys under the same names."""
    other = free_names(left, *[f"__r_{k}" for k in keys])
    cond = F.lit(True)
    for k, o in zip(keys, other):
        cond &= F.col(f"`{k}`").eqNullSafe(F.col(f"`{o}`"))
    renamed = right.select(*[F.col(f"`{c}`").alias(other[keys.index(c)] if c in keys else c) for c in right.columns])
    return left.join(renamed, cond, how).drop(*other) if keys else left.crossJoin(F.broadcast(renamed))  # without keys: one row


def large_groups(df: DataFrame, keys: list[str], small: int) -> DataFrame | None:
    """Keys of the groups of more than `small` rows, at most one for every `small` rows; None if there is none."""
    found = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > small).select(*keys, "__n").collect()
    return df.sparkSession.createDataFrame(found, T.StructType([*[df.schema[k] for k in keys], T.StructField("__n", T.LongType())])).drop("__n") if found else None


def running(df: DataFrame, keys: list[str], x: str, sums: dict[str, Column], tie: list[str] | None = None, small: int = SMALL) -> DataFrame:
    """Adds for each name the sum of its column over all rows of the group up to and with this one, by x and then `tie`.

    x must not be null. Equal as a window over the whole group, but large groups are sorted bucket by bucket.
    """
    large = large_groups(df, keys, small)
    if large is None:
        whole = Window.partitionBy(*keys).orderBy(x, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(whole).alias(n) for n, c in sums.items()])
    b_, f_ = free_names(df, "__bucket", "__large")
    flagged = null_safe(df, F.broadcast(large.withColumn(f_, F.lit(True))), keys, "left") if keys else df.withColumn(f_, F.lit(True))
    placed = flagged.withColumn(b_, F.when(F.col(f_), bucket(F.col(x))).otherwise(F.lit(0))).drop(f_)
    held = placed.groupBy(*keys, b_).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(b_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*keys, b_, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    inside = Window.partitionBy(*keys, b_).orderBy(x, *(tie or [])).rowsBetween(Window.unboundedPreceding, 0)
    local = placed
    for n, c in sums.items():
        local = local.withColumn(n, F.sum(c).over(inside))
    out = null_safe(local, offsets, [*keys, b_])
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"__before_{n}")).drop(f"__before_{n}")
    return out.drop(b_)


def quantiles(df: DataFrame, keys: list[str], columns: dict[str, Column], probs: list[float], small: int = SMALL, within: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """Per group one row: keys, and for each name the array of its exact quantiles, linear between ranks; null where it has no value.

    Null, NaN and infinite values don't count. A large group without any value is missing; without keys there is always one row.
    within: a table and keys whose groups have no fewer rows than those of df, where they are cheaper to count.
    """
    direct = [F.percentile(finite(v.cast("double")), F.array(*[F.lit(p) for p in probs])).alias(n) for n, v in columns.items()]
    large = None if within and large_groups(*within, small) is None else large_groups(df, keys, small)
    if large is None:
        return df.groupBy(*keys).agg(*direct)
    if not keys:
        return _of_large(df, keys, columns, probs)
    few = F.broadcast(large)
    return null_safe(df, few, keys, "left_anti").groupBy(*keys).agg(*direct).unionByName(_of_large(null_safe(df, few, keys, "left_semi"), keys, columns, probs))


def _of_large(df: DataFrame, keys: list[str], columns: dict[str, Column], probs: list[float]) -> DataFrame:
    """Quantiles by the ranks that bucket counts bracket."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), finite(v.cast("double")).alias("x")) for i, v in enumerate(columns.values())])
    long = df.select(*keys, F.explode(cells).alias("__s")).select(*keys, F.col("__s.c").alias("__c"), F.col("__s.x").alias("__x")).where(F.col("__x").isNotNull())
    long = long.withColumn("__b", bucket(F.col("__x")))
    counts = long.groupBy(*keys, "__c", "__b").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*keys, "__c")
    at = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(p) * (F.col("__total") - 1)).alias("at")) for i, p in enumerate(probs)])
    ranks = F.flatten(F.transform(at, lambda t: F.array(F.struct(t["i"].alias("i"), F.lit(0).alias("up"), t["at"].alias("at"), F.floor(t["at"]).alias("r")), F.struct(t["i"].alias("i"), F.lit(1).alias("up"), t["at"].alias("at"), F.ceil(t["at"]).alias("r")))))
    below = (
        counts.withColumn("__below", F.coalesce(F.sum("__n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("__total", F.sum("__n").over(group))
        .withColumn("__t", F.filter(ranks, lambda t: (t["r"] >= F.col("__below")) & (t["r"] < F.col("__below") + F.col("__n"))))
        .where(F.size("__t") > 0).select(*keys, "__c", "__b", "__below", "__t")
    )
    wanted = below.select(*keys, "__c", "__b", F.explode("__t").alias("t"), "__below").select(*keys, "__c", "__b", F.col("t.i").alias("__i"), F.col("t.up").alias("__up"), (F.col("t.at") - F.floor("t.at")).alias("__part"), (F.col("t.r") - F.col("__below")).alias("__r"))
    place = [*keys, "__c", "__b"]
    near = null_safe(long, below.select(*place), place).groupBy(*place, "__x").agg(F.count("*").alias("__k"))
    near = near.withColumn("__to", F.sum("__k").over(Window.partitionBy(*place).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)))
    hit = null_safe(near, wanted, place).where((F.col("__r") < F.col("__to")) & (F.col("__r") >= F.col("__to") - F.col("__k")))
    end = lambda up: F.max(F.when(F.col("__up") == up, F.col("__x")))
    each = hit.groupBy(*keys, "__c", "__i").agg((end(0) + (end(1) - end(0)) * F.max("__part")).alias("__v"))
    # one entry for each of the columns and probabilities
    lists = each.groupBy(*keys, "__c").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__v"))), lambda t: t["__v"]).alias("__q"))
    found = lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__c", "__q"))).alias("__m"))
    return found.select(*keys, *[F.try_element_at("__m", F.lit(j)).alias(n) for j, n in enumerate(columns)])
