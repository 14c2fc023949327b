"""Percentiles per group of very large numeric columns, with a guaranteed rank error, by mergeable q-digests.

Values are quantized to an ordered universe: the first `BITS` bits of the order-preserving image of a double, so
neighbouring values of the universe differ by less than one part in 2^(BITS-12). A digest is a set of counts on nodes of
the dyadic tree over the universe; node = 2^(BITS-level) + (value >> level), the root is 1. It is compressed from the
leaves upward: siblings whose counts together with their parent's are at most floor(n/k) move into the parent, so at most
3 k nodes remain. Digests of partitions, runs or days are merged by adding the counts of equal nodes.

The invariant: no inner node holds more than floor(n/k). A digest of raw values has it, as its inner nodes are empty;
addition keeps it, as floor(a/k) + floor(b/k) <= floor((a+b)/k); compression keeps it, as what moves into a parent is at
most floor(n/k) with what the parent held, provided that it sees the whole family. Only values in the BITS ancestors of a
leaf can be to either side of it, so a rank is wrong by at most BITS * floor(n/k), whatever the values, their order or the
way they were merged; digests of less than k values are exact on the universe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gridloom.runtime import BROADCAST_ROWS, materialize

BITS = 32
CUT = 20  # depth of the subtrees that are compressed apart
COMPRESSION = 6400  # rank error at most 32 / 6400 = 0.5 %
PROBS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
HELD = 2_000_000


def quantize(x: np.ndarray) -> np.ndarray:
    """Place in the universe, 0 .. 2^BITS - 1, in the order of the values."""
    raw = (np.asarray(x, dtype=np.float64) + 0.0).view(np.int64)
    ordered = np.where(raw < 0, ~raw.view(np.uint64), raw.view(np.uint64) | np.uint64(1 << 63))
    return (ordered >> np.uint64(64 - BITS)).astype(np.int64)


def value_of(code: np.ndarray) -> np.ndarray:
    """Middle of the doubles that share a place in the universe."""
    ordered = (np.asarray(code, dtype=np.int64).astype(np.uint64) << np.uint64(64 - BITS)) | np.uint64(1 << (63 - BITS))
    raw = np.where(ordered >> np.uint64(63) == 1, ordered & np.uint64((1 << 63) - 1), ~ordered)
    return raw.view(np.float64)


def add(nodes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge: one count per node."""
    order = np.argsort(nodes, kind="stable")
    nodes, counts = nodes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1]))) if len(nodes) else np.empty(0, int)
    return nodes[first], np.add.reduceat(counts, first) if len(first) else counts


def compress(nodes: np.ndarray, counts: np.ndarray, limit: int, top: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Move families of at most `limit` upward, level by level, as far as depth `top`. Expects one count per node and whole subtrees of that depth."""
    if limit == 0 or len(nodes) <= 3:
        return nodes, counts
    kept_n, kept_c = [], []
    depth = np.frexp(nodes.astype(np.float64))[1] - 1  # leaves have depth BITS, the root 0
    carry_n, carry_c = np.empty(0, np.int64), np.empty(0, np.int64)
    for level in range(BITS, top, -1):
        here = depth == level
        n, c = add(np.concatenate((nodes[here], carry_n)), np.concatenate((counts[here], carry_c)))
        if not len(n):
            carry_n, carry_c = n, c
            continue
        up = depth == level - 1
        un, uc = nodes[up], counts[up]
        parents, where = np.unique(n >> 1, return_inverse=True)
        family = np.bincount(where, weights=c, minlength=len(parents)).astype(np.int64)
        at = np.minimum(np.searchsorted(un, parents), max(0, len(un) - 1))
        if len(un):
            family += np.where(un[at] == parents, uc[at], 0)
        moves = (family <= limit)[where]
        kept_n.append(n[~moves])
        kept_c.append(c[~moves])
        carry_n, carry_c = n[moves] >> 1, c[moves]
    above = depth <= top
    n, c = add(np.concatenate((nodes[above], carry_n, *kept_n)), np.concatenate((counts[above], carry_c, *kept_c)))
    return n, c


def quantiles(nodes: np.ndarray, counts: np.ndarray, probs: tuple[float, ...] = PROBS) -> np.ndarray:
    """Values whose ranks are within the bound of ceil(p n): the first node, by last value and then size, at which the counts reach it."""
    level = BITS - (np.frexp(nodes.astype(np.float64))[1] - 1)
    last = ((nodes + 1) << level) - 1 - (1 << BITS)
    order = np.lexsort((level, last))
    reached = np.cumsum(counts[order])
    want = np.maximum(1, np.ceil(np.asarray(probs) * reached[-1] - 1e-9))
    return value_of(last[order][np.minimum(np.searchsorted(reached, want), len(order) - 1)])


def _partials(keys: list[str], columns: list[str], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        names = [*keys, "metric", "node"]

        def digest() -> pd.DataFrame | None:
            if not held:
                return None
            whole = pd.concat(held).groupby(names, dropna=False, sort=False)["count"].sum().reset_index()
            total = whole.groupby([*keys, "metric"], dropna=False, sort=False)["count"].transform("sum")
            large = total >= k
            if not large.any():
                return whole
            out = [whole[~large]]
            for _, g in whole[large].groupby([*keys, "metric"], dropna=False, sort=False):
                n, c = compress(*add(g["node"].to_numpy(), g["count"].to_numpy()), int(g["count"].sum()) // k)
                part = g.iloc[:1].drop(columns=["node", "count"]).loc[lambda d: d.index.repeat(len(n))]
                out.append(part.assign(node=n, count=c))
            return pd.concat(out)

        for pdf in batches:
            for metric in columns:
                x = pdf[metric].to_numpy(dtype=np.float64, na_value=np.nan)
                ok = np.isfinite(x)
                part = pdf.loc[ok, keys].assign(metric=metric, node=quantize(x[ok]) + (1 << BITS))
                held.append(part.groupby(names, dropna=False, sort=False).size().rename("count").reset_index())
                rows += len(held[-1])
            if rows > HELD:
                held = [digest()]
                rows = len(held[0])
        if (got := digest()) is not None and len(got):
            yield got[[*names, "count"]]

    return run


def digests(df: DataFrame, keys: list[str], columns: list[str], k: int = COMPRESSION) -> DataFrame:
    """Digest rows (keys, metric, node, count) of each numeric column per group, null groups included.

    Every partition makes its own digests, of at most 3 k nodes a group, so a node may stand in several rows, whose
    counts add up. Null, NaN and infinite values are missing. A digest can be stored and merged with others later.
    """
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(_partials(keys, columns, k), _node_schema(df, keys))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Digests of groups from those of parts (partitions, runs, days): counts of equal nodes are added."""
    return parts.groupBy(*keys, "metric", "node").agg(F.sum("count").alias("count"))


def percentiles(digest: DataFrame, keys: list[str], probs: tuple[float, ...] = PROBS, k: int = COMPRESSION) -> DataFrame:
    """One row per group and metric: n, rank_error (the guaranteed bound, in ranks) and p10, p25 ... for the asked probabilities.

    Equal nodes of any parts are added. A group is cut into its whole subtrees at depth CUT, which are added and compressed in
    different tasks with the limit of the whole group, known from a first sum; then one task answers. It gets at most 3 k
    nodes and one for every subtree, of which there are 2^CUT, however large the group is.
    """
    names = [f"p{p * 100:g}".replace(".", "_") for p in probs]
    by = [*keys, "metric"]
    fields = [f for f in digest.schema if f.name in keys]
    out_schema = T.StructType([*fields, T.StructField("metric", T.StringType()), T.StructField("n", T.LongType()), T.StructField("rank_error", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _whole_groups(batches, by):
            large = whole["limit"] > 0
            yield whole.loc[~large, [*by, "node", "count"]]
            for _, g in whole[large].groupby(by, dropna=False, sort=False):
                n, c = compress(*add(g["node"].to_numpy(np.int64), g["count"].to_numpy(np.int64)), int(g["limit"].iloc[0]), CUT)
                yield g.iloc[np.zeros(len(n), dtype=int)].assign(node=n, count=c)[[*by, "node", "count"]]

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _whole_groups(batches, by):
            rows = []
            for key, g in whole.groupby(by, dropna=False, sort=False):
                n, c = add(g["node"].to_numpy(np.int64), g["count"].to_numpy(np.int64))
                total = int(c.sum())
                rows.append((*[None if x is None or x != x else x for x in key], total, BITS * (total // k), *quantiles(n, c, probs)))
            yield pd.DataFrame(rows, columns=out_schema.names)

    tasks = int(digest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(digest.select(*by, "node", "count"), "digests")  # read for the sums and for the counts
    parts = _with_limits(stored, by, k)
    depth = F.floor(F.log2("node") + 1e-11).cast("int")
    subtree = F.when(depth > CUT, F.call_function("shiftright", F.col("node"), depth - CUT)).otherwise(F.when(depth == CUT, F.col("node")).otherwise(F.lit(0)))
    cut = parts.repartition(tasks, *by, subtree).sortWithinPartitions(*by).mapInPandas(shrink, _node_schema(digest, keys))
    return cut.repartition(tasks, *by).sortWithinPartitions(*by).mapInPandas(answer, out_schema)


def _with_limits(stored: DataFrame, by: list[str], k: int) -> DataFrame:
    """Adds the most that an inner node of the row's group may hold. The sums are broadcast if they are few, else the rows of a group are dealt to 64 tasks."""
    other = [f"__t{i}" for i in range(len(by))]
    totals = stored.groupBy(*by).agg(F.floor(F.sum("count") / k).alias("limit")).select(*[F.col(c).alias(t) for c, t in zip(by, other)], "limit")
    same = F.lit(True)
    for c, t in zip(by, other):
        same &= F.col(c).eqNullSafe(F.col(t))
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return stored.join(F.broadcast(totals), same).drop(*other)
    dealt = stored.withColumn("__deal", F.pmod(F.xxhash64("node"), F.lit(64)))
    copied = totals.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    return dealt.join(copied, same & (F.col("__deal") == F.col("__copy"))).drop(*other, "__deal", "__copy")


def _node_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in keys], T.StructField("metric", T.StringType()), T.StructField("node", T.LongType()), T.StructField("count", T.LongType())])


def _whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a sorted partition cut anew, so that no group is split; holds one batch and one group at most."""
    held: pd.DataFrame | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = held.iloc[-1]
        same = np.ones(len(held), dtype=bool)
        for c in by:
            same &= held[c].isna().to_numpy() if pd.isna(last[c]) else (held[c] == last[c]).to_numpy()
        start = len(held) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield held.iloc[:start].reset_index(drop=True)
            held = held.iloc[start:].reset_index(drop=True)
    if held is not None:
        yield held
