"""Radius join on the sphere: all pairs of points at most `radius_m` apart by great-circle distance.

Voronoi partition around pivots, replication by the triangle inequality, vantage-point trees inside the cells.

* Pivots are points of the indexed side with small hashes, so they follow its density; their number grows with the data
  (`n / per_cell`, at most `max_pivots` a cell), and cells that still hold too many points are split by pivots of their own.
* An indexed point s goes to the cell of its nearest pivot. A query point q whose nearest pivot is at distance d
  goes to every cell whose pivot is within d + 2 r: for any s within r of q, d(q, pivot(s)) <= d(s, pivot(s)) + r
  <= d(s, pivot(q)) + r <= d + 2 r. So no pair is lost and none appears twice.
* Equal coordinates are joined once; identifiers are attached afterwards by equi-joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from gridloom.runtime import materialize

EARTH_M = 6_371_008.8
LEAF = 48


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lam, phi = np.radians(lon), np.radians(lat)
    return np.column_stack((np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)))


def arc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle metres between unit vectors, from the chord (exact for near points, unlike the arc cosine)."""
    chord = np.sqrt(((a - b) ** 2).sum(axis=-1))
    return 2.0 * EARTH_M * np.arcsin(np.minimum(1.0, chord / 2.0))


class VantageTree:
    """Vantage-point tree over unit vectors under the great-circle metric, queried for many points at once."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple[int, float, int, int] | np.ndarray] = []
        self.root = self._build()

    def _build(self) -> int:
        """Without recursion, as coinciding points may make the tree deep."""
        self.nodes.append(np.arange(len(self.points)))
        todo = [0]
        while todo:
            at = todo.pop()
            idx = self.nodes[at]
            if len(idx) <= LEAF:
                continue
            rest = idx[1:]
            d = arc(self.points[rest], self.points[idx[0]])
            mu = float(np.median(d))
            inner, outer = rest[d <= mu], rest[d > mu]
            if not len(outer):  # all at one distance: nothing to split by
                continue
            self.nodes += [inner, outer]
            self.nodes[at] = (int(idx[0]), mu, len(self.nodes) - 2, len(self.nodes) - 1)
            todo += [len(self.nodes) - 2, len(self.nodes) - 1]
        return 0

    def within(self, queries: np.ndarray, r: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) at most r apart; r for all queries or for each of them."""
        r = np.broadcast_to(np.asarray(r, dtype=float), len(queries))
        qs: list[np.ndarray] = []
        ps: list[np.ndarray] = []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            at, who = todo.pop()
            if not len(who):
                continue
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                for part, pts, d in self._blocks(queries, who, node):
                    q, p = np.nonzero(d <= r[part][:, None])
                    qs.append(part[q])
                    ps.append(pts[p])
                continue
            vantage, mu, inner, outer = node
            d = arc(queries[who], self.points[vantage])
            hit = who[d <= r[who]]
            qs.append(hit)
            ps.append(np.full(len(hit), vantage))
            todo += [(inner, who[d - r[who] <= mu]), (outer, who[d + r[who] >= mu])]
        none = np.empty(0, dtype=np.int64)
        return (np.concatenate(qs) if qs else none), (np.concatenate(ps) if ps else none)

    def least(self, queries: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Distance of each query's nearest point, or its bound if no point is nearer."""
        best = bound.astype(float).copy()
        todo = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while todo:
            at, who, floor = todo.pop()
            who = who[floor <= best[who]]
            if not len(who):
                continue
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                for part, _, d in self._blocks(queries, who, node):
                    best[part] = np.minimum(best[part], d.min(axis=1))
                continue
            vantage, mu, inner, outer = node
            d = arc(queries[who], self.points[vantage])
            best[who] = np.minimum(best[who], d)
            todo += [(outer, who, np.maximum(0.0, mu - d)), (inner, who, np.maximum(0.0, d - mu))]
        return best

    def _blocks(self, queries: np.ndarray, who: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distances of a leaf's points, in blocks of bounded size."""
        for lo in range(0, len(who), 4096):
            for plo in range(0, len(node), 512):
                part, pts = who[lo : lo + 4096], node[plo : plo + 512]
                yield part, pts, arc(queries[part][:, None, :], self.points[pts][None, :, :])


def is_place(lon: Column, lat: Column) -> Column:
    """Finite, on the globe, and not the placeholder (0, 0)."""
    return lon.between(-180, 180) & lat.between(-90, 90) & ~((lon == 0) & (lat == 0))


def _chords(points: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared chords to all pivots, clipped at 0, for as many points at a time as 32 MB hold."""
    step = max(1, (1 << 22) // max(1, len(pivots)))
    for i in range(0, len(points), step):
        yield slice(i, i + step), np.maximum(0.0, 2.0 - 2.0 * (points[i : i + step] @ pivots.T))


#: Pivots of cells that are split, by the name of the cell; the cell of pivot i of cell c is called c/i.
Level = dict[str, np.ndarray]


def _place(level: Broadcast):
    """Cell of each point one level down: that of the nearest pivot; cells that are not split stay."""

    @F.pandas_udf("string")
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for cell, lon, lat in batches:
            at, out = unit_vectors(lon.to_numpy(), lat.to_numpy()), cell.to_numpy(dtype=object).copy()
            for name, rows in cell.groupby(cell.to_numpy()).indices.items():
                if name in level.value:
                    for part, c2 in _chords(at[rows], level.value[name]):
                        out[rows[part]] = [f"{name}/{i}" for i in c2.argmin(axis=1)]
            yield pd.Series(out, dtype=object)

    return place


def _reach(level: Broadcast):
    """Cells one level down that may hold a point within r of each query of a cell, by the triangle inequality."""

    @F.pandas_udf("array<string>")
    def reach(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for cell, lon, lat, r in batches:
            at, out, slack = unit_vectors(lon.to_numpy(), lat.to_numpy()), np.empty(len(cell), dtype=object), 2.0 * r.to_numpy() + 0.5  # half a metre covers rounding
            for name, rows in cell.groupby(cell.to_numpy()).indices.items():
                if name not in level.value:
                    for i in rows:
                        out[i] = [name]
                    continue
                for part, c2 in _chords(at[rows], level.value[name]):
                    own = 2.0 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(c2.min(axis=1)) / 2.0))
                    most = np.minimum(np.pi, (own + slack[rows[part]]) / EARTH_M)
                    near = c2 <= (2.0 * np.sin(most / 2.0))[:, None] ** 2 + 1e-15
                    for i, row in zip(rows[part], near):
                        out[i] = [f"{name}/{j}" for j in np.nonzero(row)[0]]
            yield pd.Series(out, dtype=object)

    return reach


class Cells:
    """Voronoi cells of points (slon, slat). `indexed` holds each point once with its cell, of at most 4 x per_cell points.

    The pivots of a cell are points of it with small hashes. Cells with more points are split again by pivots of their own,
    as often as needed, so a cell stays small wherever points crowd. For every level the argument of the module holds within
    the cell that is split. The pivots are broadcast: at most one for every per_cell points.
    """

    def __init__(self, points: DataFrame, per_cell: int, max_pivots: int, seed: int):
        spark = points.sparkSession
        sc = materialize(points, "points")
        self.levels: list[Broadcast] = []
        self.indexed = sc.withColumn("cell", F.lit(""))
        crowded = {"": sc.count()}
        for round_ in range(16):
            h = F.xxhash64("slon", "slat", F.lit(seed + round_))
            wanted = {c: min(max_pivots, max(1 if not round_ else 8, math.ceil(n / per_cell))) for c, n in crowded.items()}
            if not round_:
                chosen = self.indexed.orderBy(h, "slon", "slat").limit(wanted[""]).toPandas()
            else:
                table = spark.createDataFrame(pa.table({"cell": list(wanted), "share": [wanted[c] / crowded[c] for c in wanted]}))
                # one row per crowded cell, at most one for every 4 x per_cell points
                chosen = self.indexed.join(F.broadcast(table), "cell").where(F.pmod(h, F.lit(1 << 40)) < F.col("share") * float(1 << 40)).select("cell", "slon", "slat").toPandas()
            level = {c: np.unique(unit_vectors(g["slon"].to_numpy(), g["slat"].to_numpy()), axis=0) for c, g in chosen.groupby("cell")}
            if not level:
                break
            self.levels.append(spark.sparkContext.broadcast(level))
            placed = self.indexed.withColumn("cell", _place(self.levels[-1])("cell", "slon", "slat"))
            self.indexed = materialize(placed, "cells") if sum(crowded.values()) > 4 * per_cell else placed
            if sum(crowded.values()) <= 4 * per_cell:
                break
            crowded = {r.cell: r.n for r in self.indexed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 4 * per_cell).collect()}
            if not crowded:
                break

    def own(self, df: DataFrame, lon: str, lat: str) -> DataFrame:
        """Adds the cell whose pivot is nearest."""
        df = df.withColumn("cell", F.lit(""))
        for level in self.levels:
            df = df.withColumn("cell", _place(level)("cell", lon, lat))
        return df

    def reached(self, df: DataFrame, lon: str, lat: str, r: Column) -> DataFrame:
        """Each row once for every cell that may hold a point within r."""
        df = df.withColumn("cell", F.lit(""))
        for level in self.levels:
            df = df.withColumn("cell", F.explode(_reach(level)("cell", lon, lat, r)))
        return df

    def meet(self, asked: DataFrame, local, schema: str, most: int) -> DataFrame:
        """local(queries, points) per cell; the queries of a cell are dealt to tasks of at most some `most` of them, with the points copied."""
        spark = asked.sparkSession
        busy = asked.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most).select("cell", F.ceil(F.col("n") / most).cast("int").alias("shards")).toPandas()
        if not len(busy):  # the table holds at most one row for every `most` queries
            return asked.groupBy("cell").cogroup(self.indexed.groupBy("cell")).applyInPandas(local, schema)
        table = F.broadcast(spark.createDataFrame(busy, "cell string, shards int"))
        dealt = asked.join(table, "cell", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("qlon", "qlat").cast("int"), F.col("shards")), F.lit(0)))
        copied = self.indexed.join(table, "cell", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shards") - 1, F.lit(0)))))
        return dealt.groupBy("cell", "shard").cogroup(copied.groupBy("cell", "shard")).applyInPandas(local, schema)


def _places(df: DataFrame, key: str, at: tuple[str, str], p: str) -> DataFrame:
    lon, lat = F.col(at[0]).cast("double"), F.col(at[1]).cast("double")
    return df.where(is_place(lon, lat) & F.col(key).isNotNull()).select(F.col(key).alias(f"{p}id"), lon.alias(f"{p}lon"), lat.alias(f"{p}lat")).distinct()


PAIR = "qlon double, qlat double, slon double, slat double, distance_m double"


def _pairs(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({
        "qlon": left["qlon"].to_numpy()[i], "qlat": left["qlat"].to_numpy()[i],
        "slon": right["slon"].to_numpy()[j], "slat": right["slat"].to_numpy()[j], "distance_m": arc(a[i], b[j]),
    })


def _vectors(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return unit_vectors(left["qlon"].to_numpy(), left["qlat"].to_numpy()), unit_vectors(right["slon"].to_numpy(), right["slat"].to_numpy())


def near_pairs(
    queries: DataFrame, points: DataFrame, radius_m: float, *, query_id: str, point_id: str,
    query_at: tuple[str, str] = ("lon", "lat"), point_at: tuple[str, str] = ("lon", "lat"),
    per_cell: int = 4000, max_pivots: int = 8192, seed: int = 17,
) -> DataFrame:
    """Distinct (query id, point id, distance_m) of all pairs at most radius_m apart; columns query_id, point_id, distance_m.

    Rows with a null identifier or no valid place give no pair; repeated rows give their pair once; an identifier with
    several places is near if one of them is (the least distance counts). Empty inputs give an empty result.
    """
    q, s = _places(queries, query_id, query_at, "q"), _places(points, point_id, point_at, "s")
    cells = Cells(s.select("slon", "slat").distinct(), per_cell, max_pivots, seed)
    asked = materialize(cells.reached(q.select("qlon", "qlat").distinct(), "qlon", "qlat", F.lit(float(radius_m))), "asked")

    def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0) for c in ("qlon", "qlat", "slon", "slat", "distance_m")})
        a, b = _vectors(left, right)
        return _pairs(left, right, a, b, *VantageTree(b).within(a, radius_m))

    met = cells.meet(asked, local, PAIR, 8 * per_cell)
    return (
        met.join(q, ["qlon", "qlat"]).join(s, ["slon", "slat"])
        .groupBy(F.col("qid").alias(query_id), F.col("sid").alias(point_id)).agg(F.min("distance_m").alias("distance_m"))
    )


def nearest_points(
    queries: DataFrame, points: DataFrame, *, query_id: str, point_id: str,
    query_at: tuple[str, str] = ("lon", "lat"), point_at: tuple[str, str] = ("lon", "lat"),
    per_cell: int = 4000, max_pivots: int = 8192, seed: int = 17,
) -> DataFrame:
    """(query id, point id, distance_m) of the nearest point of each query, the smaller id on ties; for valid places only.

    Each query asks the tree of its own cell first; the distance found bounds the cells and the subtrees that are asked then,
    so only points at the least distance of a cell are ever put out, however dense they lie.
    """
    q, s = _places(queries, query_id, query_at, "q"), _places(points, point_id, point_at, "s")
    cells = Cells(s.select("slon", "slat").distinct(), per_cell, max_pivots, seed)

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0) for c in ("qlon", "qlat", "r")})
        a, b = _vectors(left, right)
        return left[["qlon", "qlat"]].assign(r=VantageTree(b).least(a, np.full(len(a), np.inf)))

    def final(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0) for c in ("qlon", "qlat", "slon", "slat", "distance_m")})
        a, b = _vectors(left, right)
        tree = VantageTree(b)
        return _pairs(left, right, a, b, *tree.within(a, tree.least(a, left["r"].to_numpy())))

    own = materialize(cells.own(q.select("qlon", "qlat").distinct(), "qlon", "qlat"), "own")
    bounded = cells.meet(own, first, "qlon double, qlat double, r double", 8 * per_cell)
    asked = materialize(cells.reached(bounded, "qlon", "qlat", F.col("r")), "asked")
    met = cells.meet(asked, final, PAIR, 8 * per_cell)
    return (
        met.join(q, ["qlon", "qlat"]).join(s, ["slon", "slat"])
        .groupBy(F.col("qid").alias(query_id)).agg(F.min(F.struct("distance_m", "sid")).alias("b"))
        .select(query_id, F.col("b.sid").alias(point_id), "b.distance_m")
    )
