"""Per-key work without imbalance, where a few keys hold most records.

Fragment-replicate by load. Loads per key are counted with map-side combination. Keys above a share of a task's
fair load are *heavy*; at most `1 / share` times the tasks can be. A heavy key is split into shards in proportion to
its load, and the shards are bin-packed (largest first, onto the least loaded task) over the loads that the light keys
bring to each task. The matching side is replicated to exactly those shards.

Placement uses the exchange that the join or aggregation has anyhow: a task is the hash of (slot, key) modulo the
number of partitions; light keys have slot 0, and for each shard a slot is looked up whose hash is the task it was packed to.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridloom.runtime import free_names


@dataclass
class LoadPlan:
    """tasks: partitions; total: rows with a key; rows: all rows; heavy: (key, load, slots), one slot per shard; loads: rows expected per task."""

    tasks: int
    total: int
    heavy: list[tuple[object, int, list[int]]]
    loads: list[int]
    rows: int = 0

    @property
    def imbalance(self) -> float:
        """Largest task over the mean."""
        return max(self.loads) * len(self.loads) / max(1, sum(self.loads))


def plan_loads(df: DataFrame, key: str, tasks: int | None = None, heavy_share: float = 0.25) -> LoadPlan:
    """Count loads per key and pack them. Null keys are not planned: they match nothing and are spread by row.

    Loads are counted over all rows, combined before they are shuffled. What reaches the driver is bounded by the tasks: the
    rows of each task if every key stood unsplit, and the keys above the limit, of which there are at most tasks / heavy_share.
    """
    spark = df.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select(F.col(key).alias("k"))
    size = keyed.agg(F.count("*").alias("rows"), F.count("k").alias("total")).collect()[0]
    if not size.total:
        return LoadPlan(tasks, 0, [], [0] * tasks, size.rows)
    limit = max(1, math.ceil(heavy_share * size.total / tasks))
    big = F.when(F.col("n") > limit, F.struct("k", "n"))
    counted = keyed.where(F.col("k").isNotNull()).groupBy("k").agg(F.count("*").alias("n"))
    by_task = counted.groupBy(F.pmod(F.hash(F.lit(0), "k"), F.lit(tasks)).alias("t")).agg(F.sum("n").alias("n"), F.collect_list(big).alias("big")).collect()
    loads = [0] * tasks
    found: list[tuple[object, int]] = []
    for r in by_task:
        loads[r.t] += r.n - sum(x.n for x in r.big)
        found += [(x.k, x.n) for x in r.big]
    if not found:
        return LoadPlan(tasks, size.total, [], loads, size.rows)
    # for each heavy key, the smallest slot that leads to each task
    keys = _table(spark, {"k": [k for k, _ in found]}, T.StructType([T.StructField("k", df.schema[key].dataType)]))
    reach = F.transform(F.sequence(F.lit(1), F.lit(12 * tasks)), lambda slot: F.pmod(F.hash(slot, F.col("k")), F.lit(tasks)))
    slot_of: dict[object, dict[int, int]] = {}
    for r in keys.coalesce(1).select("k", reach.alias("t")).collect():
        for slot, t in enumerate(r.t, 1):
            slot_of.setdefault(r.k, {}).setdefault(t, slot)
    heap = [(n, t) for t, n in enumerate(loads)]
    heapq.heapify(heap)
    heavy = []
    for k, n in sorted(found, key=lambda x: (-x[1], str(x[0]))):
        shards, chosen, skipped = math.ceil(n / limit), [], []
        for _ in range(shards):
            while heap and heap[0][1] not in slot_of[k]:
                skipped.append(heapq.heappop(heap))
            if not heap:
                break
            m, t = heapq.heappop(heap)
            chosen.append(slot_of[k][t])
            loads[t] += math.ceil(n / shards)
            heapq.heappush(heap, (m + math.ceil(n / shards), t))
        for x in skipped:
            heapq.heappush(heap, x)
        heavy.append((k, n, chosen or [0]))
    return LoadPlan(tasks, size.total, heavy, loads, size.rows)


def _table(spark: SparkSession, columns: dict[str, list], schema: T.StructType) -> DataFrame:
    """A small table made without a Python worker."""
    return spark.createDataFrame(pa.table({f.name: pa.array(columns[f.name], to_arrow_type(f.dataType)) for f in schema}), schema)


def _slots(df: DataFrame, key: str, plan: LoadPlan, name: str) -> DataFrame:
    """Adds the array of slots of heavy keys, null for others. The table joined has at most tasks / heavy_share rows."""
    k_ = free_names(df, "__heavy")[0]
    if not plan.heavy:
        return df.withColumn(name, F.lit(None).cast("array<int>"))
    schema = T.StructType([T.StructField(k_, df.schema[key].dataType), T.StructField(name, T.ArrayType(T.IntegerType()))])
    table = _table(df.sparkSession, {k_: [k for k, _, _ in plan.heavy], name: [slots for _, _, slots in plan.heavy]}, schema)
    return df.join(F.broadcast(table), df[key] == table[k_], "left").drop(k_)


def fragment(df: DataFrame, key: str, plan: LoadPlan, slot: str, spread: list[str] | None = None) -> DataFrame:
    """Adds the slot of each row: one of its heavy key's, 0 for light keys, any for null keys.

    Rows of a key are dealt to its slots by a hash of `spread`, columns that tell rows apart, or else of their place in the
    input, so that equal rows are spread like others. The place is the same when a task of a scan is repeated; rows that come
    out of a shuffle have no fixed place and need `spread`, or to be written first.
    """
    s_ = free_names(df, "__slots")[0]
    row = F.pmod(F.xxhash64(*([F.col(f"`{c}`") for c in spread] if spread else [F.monotonically_increasing_id()])), F.lit(1 << 30)).cast("int")
    r_ = free_names(df, "__row")[0]
    return (
        _slots(df.withColumn(r_, row), key, plan, s_)
        .withColumn(slot, F.when(F.col(key).isNull(), F.col(r_)).when(F.col(s_).isNull(), F.lit(0)).otherwise(F.get(F.col(s_), F.col(r_) % F.size(s_))))
        .drop(s_, r_)
    )


def replicate(df: DataFrame, key: str, plan: LoadPlan, slot: str) -> DataFrame:
    """Each row once per slot in which its key has rows; rows of light keys once, with slot 0."""
    s_ = free_names(df, "__slots")[0]
    return _slots(df, key, plan, s_).withColumn(slot, F.explode(F.coalesce(F.array_distinct(s_), F.array(F.lit(0))))).drop(s_)


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", plan: LoadPlan | None = None, spread: list[str] | None = None) -> DataFrame:
    """Equi-join on `key` (inner, left, left_semi or left_anti) in which no task gets more than its share of a heavy key of `left`.

    Other columns of `right` whose names clash with columns of `left` get the suffix `_right`. Null keys match nothing.
    spread: see `fragment`. Adaptive execution may merge tasks again, but only up to its advisory size.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the replicated side may not be preserved: its copies would come out repeatedly")
    taken = {c.lower() for c in left.columns}
    names = {}
    for c in right.columns:
        new = c
        while c != key and new.lower() in taken | {x.lower() for x in names.values()}:
            new += "_right"
        names[c] = new
    right = right.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    plan = plan or plan_loads(left, key)
    slot = "__slot"
    while slot in left.columns or slot in right.columns:
        slot = "_" + slot
    return fragment(left, key, plan, slot, spread).join(replicate(right, key, plan, slot), [slot, key], how).drop(slot)


def per_key(df: DataFrame, key: str, partial: list[Column], merge: list[Column], plan: LoadPlan | None = None, spread: list[str] | None = None) -> DataFrame:
    """Results per key (null keys are a group too), computed in two steps: `partial` per shard, `merge` per key over the shards' rows.

    At most as many rows of a key as it has shards reach the task that merges it. spread: see `fragment`.
    """
    plan = plan or plan_loads(df, key)
    slot = free_names(df, "__slot")[0]
    placed = F.when(F.col(key).isNull(), F.pmod(F.col(slot), F.lit(plan.tasks))).otherwise(F.col(slot))
    return fragment(df, key, plan, slot, spread).withColumn(slot, placed).groupBy(slot, key).agg(*partial).groupBy(key).agg(*merge)
