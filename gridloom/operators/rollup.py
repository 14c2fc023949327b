"""Rollups, compositions, dominance, top-k tables, samples, set comparisons, contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridloom.functions.clean import seed_of
from gridloom.operators.ranks import null_safe, running


def grouping_levels(df: DataFrame, levels: dict[str, list[str]], aggs: list[Column]) -> DataFrame:
    """Aggregates over several groupings at once, with the level's name; keys that a level lacks are null.

    Null keys are left out of the levels that group by them.
    """
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    sets = [[F.col(k) for k in cols] for cols in levels.values()]
    # one scan and one shuffle; grouping_id tells the levels apart, and null keys of the data from keys that a level lacks
    bits = lambda cols: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols)
    got = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("__g"), *aggs)
    name, ok = F.lit(None), F.lit(False)
    for n, cols in levels.items():
        here = F.col("__g") == bits(cols)
        name = F.when(here, n).otherwise(name)
        whole = here
        for k in cols:
            whole &= F.col(k).isNotNull()
        ok |= whole
    return got.where(ok).select(name.alias("group_level"), *[c for c in got.columns if c != "__g"])


def with_total(df: DataFrame, key: str, aggs: list[Column], label: str = "ALL") -> DataFrame:
    """Aggregates per key and one row for all of them."""
    rolled = df.where(F.col(key).isNotNull()).rollup(key).agg(F.grouping(key).alias("__all"), *aggs)
    return rolled.withColumn(key, F.when(F.col("__all") == 1, F.lit(label)).otherwise(F.col(key))).drop("__all")


def composition(df: DataFrame, key: str, cls: str, weight: Column) -> DataFrame:
    """Per key and class: rows, weight, and their shares within the key."""
    w = Window.partitionBy(key)
    t = df.where(F.col(key).isNotNull() & F.col(cls).isNotNull()).groupBy(key, cls).agg(F.count("*").alias("n"), F.sum(F.coalesce(weight, F.lit(0.0))).alias("weight"))
    return t.withColumn("count_share", F.col("n") / F.sum("n").over(w)).withColumn("weight_share", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(w)), F.lit(0.0)))


def dominant(df: DataFrame, keys: list[str], cls: str, share: str) -> DataFrame:
    """The class with the largest share per key, the first in order on ties, with its share."""
    return df.groupBy(*keys).agg(F.min(F.struct((-F.col(share)).alias("s"), F.col(cls).alias("c"))).alias("m")).select(*keys, F.col("m.c").alias("dominant"), (-F.col("m.s")).alias("dominant_share"))


def variation_similarity(a: DataFrame, b: DataFrame, keys: list[str], cls: str, share: str) -> DataFrame:
    """1 - half the summed differences of two share vectors per key; classes that one lacks have share 0."""
    both = a.select(*keys, cls, F.col(share).alias("__p"), F.lit(0.0).alias("__q")).unionByName(b.select(*keys, cls, F.lit(0.0).alias("__p"), F.col(share).alias("__q")))
    per = both.groupBy(*keys, cls).agg(F.sum("__p").alias("__p"), F.sum("__q").alias("__q"))
    has = per.groupBy(*keys).agg(F.sum("__p").alias("__sp"), F.sum("__q").alias("__sq"), F.sum(F.abs(F.col("__p") - F.col("__q"))).alias("__d"))
    return has.select(*keys, F.when((F.col("__sp") > 0) & (F.col("__sq") > 0), 1 - F.col("__d") / 2).alias("similarity"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows per group in a total order; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def strata(df: DataFrame, by: list[str], id_: str, examples: int) -> DataFrame:
    """Rows per stratum and its first ids, joined; only as many ids as are shown are collected."""
    first = top_k(df.select(*by, id_), by, [F.col(id_)], examples).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.col(id_).cast("string"))), ", ").alias("examples"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(id_).alias("ids")).join(first, by)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") == 1).drop("__rn")


def balanced_sample(df: DataFrame, by: list[str], id_: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows per group, those with the smallest seeded hashes of their id: the same in any order."""
    return top_k(df, by, [seed_of(F.col(id_).cast("string"), seed), F.col(id_)], most, "__rank").drop("__rank")


def weighted_sample(df: DataFrame, by: list[str], id_: str, weight: str, most: int, seed: int) -> DataFrame:
    """At most `most` rows per group without replacement, chances by weight: smallest -ln(u) / w by seeded hashes."""
    key = -F.log(F.greatest(seed_of(F.col(id_).cast("string"), seed), F.lit(1e-300))) / F.col(weight)
    return top_k(df.where(F.col(weight) > 0), by, [key, F.col(id_)], most, "__rank").drop("__rank")


def sample_with_replacement(origins: DataFrame, targets: DataFrame, by: str, origin: str, target: str, weight: str, draws: int, seed: int, attempts: int = 1) -> DataFrame:
    """`draws` targets per origin of the same group, chances by weight, with repeats: inverse lookup in cumulative shares.

    Columns: by, origin, draw, attempt, target; with `attempts` each draw has as many candidates, of which a caller that
    rejects some keeps the first. The lookup is an equi-join on (group, cell of the share), with the cells each target
    covers, so no origin meets all targets of its group. Targets stand in the order of their hashes.
    """
    cells = 256
    t = targets.where(F.col(weight) > 0).select(by, F.col(target).alias("__t"), F.col(weight).alias("__w")).withColumn("__h", seed_of(F.col("__t").cast("string"), seed + 1))
    t = running(t, [by], "__h", {"__to": F.col("__w")}, ["__t"])
    t = null_safe(t, t.groupBy(by).agg(F.sum("__w").alias("__all")), [by])
    ends = F.col("__to") >= F.col("__all") * (1 - 1e-12)  # rounding must not leave a draw beyond the last share
    t = t.withColumn("__hi", F.when(ends, F.lit(1.0)).otherwise(F.col("__to") / F.col("__all"))).withColumn("__lo", F.greatest(F.lit(0.0), (F.col("__to") - F.col("__w")) / F.col("__all")))
    t = t.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("__hi") * cells).cast("int")))))
    o = origins.select(by, F.col(origin).alias("__o"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts))))
    o = o.withColumn("__u", seed_of(F.concat_ws("|", F.col("__o").cast("string"), F.col("draw").cast("string"), F.col("attempt").cast("string")), seed)).withColumn("__cell", F.floor(F.col("__u") * cells).cast("int"))
    return o.join(t, [by, "__cell"]).where((F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__hi"))).select(by, F.col("__o").alias(origin), "draw", "attempt", F.col("__t").alias(target))


# contracts


def unique_check(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row (check, status, duplicate_keys, extra_rows)."""
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return dup.agg(F.count("*").alias("duplicate_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows")).select(F.lit(name).alias("check"), F.when(F.col("duplicate_keys") == 0, "pass").otherwise("fail").alias("status"), "duplicate_keys", "extra_rows")


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, nulls, rows) of all columns in one pass; NaN counts as missing."""
    types = dict(df.dtypes)
    miss = {c: F.count_if(F.col(c).isNull() | (F.isnan(c) if types[c] in ("double", "float") else F.lit(False))) for c in columns}
    one = df.agg(F.count("*").alias("rows"), *[m.alias(c) for c, m in miss.items()])
    return one.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])).alias("s")).select("s.column", "s.nulls", "rows")


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state) with state both, missing or extra."""
    e, a = expected.select(key).distinct().withColumn("__e", F.lit(1)), actual.select(key).distinct().withColumn("__a", F.lit(1))
    return e.join(a, key, "full").select(key, F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").otherwise("both").alias("state"))


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two tables: added, removed or changed."""
    b, a = before.select(key, F.col(value).alias("__b"), F.lit(True).alias("__hb")), after.select(key, F.col(value).alias("__a"), F.lit(True).alias("__ha"))
    j = b.join(a, key, "full").where(~(F.col("__b").eqNullSafe(F.col("__a")) & F.col("__hb").isNotNull() & F.col("__ha").isNotNull()))
    return j.select(key, F.when(F.col("__hb").isNull(), "added").when(F.col("__ha").isNull(), "removed").otherwise("changed").alias("change"))


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "m:1") -> DataFrame:
    """Equi-join that fails at run time where the right side (m:1, 1:1) or the left side (1:m, 1:1) repeats a key.

    The guard rides on the aggregation that the sides need anyhow; no job runs beforehand.
    """
    def guarded(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*on))
        return df.withColumn("__ok", F.when(n > 1, F.raise_error(F.lit(f"the {side} side repeats a key")).cast("int")).otherwise(F.lit(1))).where(F.col("__ok") == 1).drop("__ok")

    if cardinality in ("m:1", "1:1"):
        right = guarded(right, "right")
    if cardinality in ("1:m", "1:1"):
        left = guarded(left, "left")
    return left.join(right, on, how)


def checks(rows: dict[str, tuple[DataFrame, Column, object]]) -> DataFrame:
    """(check, status, value, expected): each a one-row aggregate compared with what is expected."""
    parts = [df.agg(value.cast("double").alias("value")).select(F.lit(n).alias("check"), F.when(F.col("value") == F.lit(float(exp)), "pass").otherwise("fail").alias("status"), "value", F.lit(float(exp)).alias("expected")) for n, (df, value, exp) in rows.items()]
    return reduce(DataFrame.unionByName, parts)
