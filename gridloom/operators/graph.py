"""Graphs as tables of edges. Iterations are joins; every step is written to the shared folder, so plans stay small and
lost executors cost one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gridloom.functions.clean import seed_of
from gridloom.runtime import materialize, release


def segments(ways: DataFrame, way: str, order: str, node: str) -> DataFrame:
    """(way, u, v): consecutive nodes of each way."""
    w = Window.partitionBy(way).orderBy(order, node)
    return ways.select(way, F.col(node).alias("u"), F.lead(node).over(w).alias("v")).where(F.col("v").isNotNull())


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(*[F.col({"u": "v", "v": "u"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(back)


def undirected(edges: DataFrame, length: str) -> DataFrame:
    """One edge u < v per pair with the least positive length; loops and lengths that are not positive numbers are left out."""
    ok = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")) & (F.col(length) > 0) & ~F.isnan(length))
    return ok.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(length).alias(length))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): distinct neighbours, loops not counted."""
    pairs = both_ways(edges.select("u", "v").where(F.col("u") != F.col("v"))).distinct()
    return pairs.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def components(edges: DataFrame, nodes: DataFrame | None = None, hub: int = 1_000_000) -> DataFrame:
    """(node, component), component = its least node. Alternates large-star and small-star steps until nothing changes.

    A step sends each node's neighbours to its least neighbour, so hubs are met once, not once per pair. The edges of a node
    with more than `hub` of them, as the least node of a large component gets, are dealt to several tasks.
    """
    e = materialize(edges.select("u", "v").where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "cc")
    everyone = both_ways(e).select(F.col("u").alias("node"))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")))
    everyone = materialize(everyone.where(F.col("node").isNotNull()).distinct(), "cc")

    def star(e: DataFrame, large: bool, hubs: DataFrame | None) -> DataFrame:
        pairs = both_ways(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        if hubs is None:
            j = pairs.join(least, "u")
        else:  # a hub's neighbours are dealt to its shards, its row goes to each of them
            dealt = pairs.join(F.broadcast(hubs), "u", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("v"), F.col("shards")), F.lit(0))).drop("shards")
            copied = least.join(F.broadcast(hubs), "u", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("shards") - 1, F.lit(0))))).drop("shards")
            j = dealt.join(copied, ["u", "shard"])
        if large:
            out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    def hubs_of(e: DataFrame, edges: int) -> DataFrame | None:
        """(u, shards) of the nodes with more than `hub` edges, at most 2 x edges / hub of them."""
        if edges <= hub:
            return None
        found = both_ways(e).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("u", F.ceil(F.col("n") / hub).alias("shards")).collect()
        return e.sparkSession.createDataFrame(found, T.StructType([T.StructField("u", e.schema["u"].dataType), T.StructField("shards", T.LongType())])) if found else None

    before, edges_now = None, e.count()
    while True:
        middle = materialize(star(e, True, hubs_of(e, edges_now)), "cc", after=e)
        e = materialize(star(middle, False, hubs_of(middle, edges_now)), "cc", after=middle)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, edges_now = now, now[0]
    label = both_ways(e).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return everyone.join(label, "node", "left").select("node", F.least(F.coalesce("m", "node"), F.col("node")).alias("component"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with most nodes, the least label on ties."""
    c = materialize(components(edges), "cc")
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    keep = c.join(F.broadcast(top), "component", "left_semi").select(F.col("node").alias("u"))  # one row is broadcast
    return edges.join(keep, "u", "left_semi")


def shortest(edges: DataFrame, sources: DataFrame, length: str, cutoff: float | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(source, node, distance): least sums of lengths from each source along directed edges, none above the cutoff.

    Relaxation of the nodes that improved in the last step only; with a cutoff the frontier stays local. For the
    distance to the nearest of many sources give them one name in column `source`. sources: columns source, node.
    With `targets` (source, node) only these pairs come out, exactly, see `routes`.
    """
    w = F.col("w")
    e = materialize(edges.select("u", "v", F.col(length).alias("w")).where((w > 0) & (w < float("inf"))), "sp")
    best = materialize(sources.select("source", "node").distinct().withColumn("d", F.lit(0.0)), "sp")
    if targets is not None:
        return routes(e, best, targets, cutoff)
    front = best
    while True:
        step = front.join(e, front["node"] == e["u"]).select("source", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"))
        if cutoff is not None:
            step = step.where(F.col("d") <= cutoff)
        step = step.groupBy("source", "node").agg(F.min("d").alias("d"))
        old = best.withColumnRenamed("d", "d0")
        front = materialize(step.join(old, ["source", "node"], "left").where(F.col("d0").isNull() | (F.col("d") < F.col("d0"))).select("source", "node", "d"), "sp", after=front if front is not best else None)
        if front.isEmpty():
            return best.select("source", "node", F.col("d").alias("distance"))
        best = materialize(best.unionByName(front).groupBy("source", "node").agg(F.min("d").alias("d")), "sp", after=best)


def routes(e: DataFrame, best: DataFrame, targets: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Relaxation from `best` (source, node, d) over edges (u, v, w), for pairs (source, node) alone, and exact for them.

    A path that improves a target is shorter than the target's distance so far and ends with an edge into it. So a node is
    followed only while its distance is less than some target's less its shortest edge in, or while a target that has an edge
    in is not reached. The slack of a micrometre keeps sums that are rounded.
    """
    shortest_in = e.groupBy(F.col("v").alias("node")).agg(F.min("w").alias("last"))
    goals = materialize(targets.select("source", "node").distinct().join(shortest_in, "node"), "sp")
    e = materialize(e.groupBy("u", "v").agg(F.min("w").alias("w")).join(e.groupBy(F.col("u").alias("v")).agg(F.min("w").alias("onward")), "v", "left"), "sp", after=e)
    front = best
    while True:
        far = F.coalesce("d", F.lit(float("inf")))
        bound = materialize(goals.join(best, ["source", "node"], "left").groupBy("source").agg(F.max(far).alias("most"), (F.max(far - F.col("last")) + 1e-6).alias("limit")), "sp")
        step = front.join(bound, "source").where(F.col("d") < F.col("limit")).join(e, F.col("node") == F.col("u"))
        step = step.select("source", F.col("v").alias("node"), (F.col("d") + F.col("w")).alias("d"), "onward", "most", "limit").where(F.col("d") < F.col("most"))
        if cutoff is not None:
            step = step.where(F.col("d") <= cutoff)
        step = step.groupBy("source", "node").agg(F.min("d").alias("d"), *[F.min(c).alias(c) for c in ("onward", "most", "limit")])
        useful = F.col("last").isNotNull() | ((F.col("d") < F.col("limit")) & (F.col("d") + F.col("onward") < F.col("most") + 1e-6))
        step = step.join(goals, ["source", "node"], "left").where(useful)
        old = best.withColumnRenamed("d", "d0")
        front = materialize(step.join(old, ["source", "node"], "left").where(F.col("d0").isNull() | (F.col("d") < F.col("d0"))).select("source", "node", "d"), "sp", after=front if front is not best else None)
        release(bound)
        if front.isEmpty():
            return best.join(goals, ["source", "node"], "left_semi").select("source", "node", F.col("d").alias("distance"))
        best = materialize(best.unionByName(front).groupBy("source", "node").agg(F.min("d").alias("d")), "sp", after=best)


def route_pairs(pairs: DataFrame, paths: DataFrame, origin: str, destination: str, straight: str, nodes: DataFrame | None = None) -> DataFrame:
    """Adds route_length_m, detour_ratio, route_found and failure_reason (same_node, node_not_found, no_path) to origin-destination pairs.

    nodes: column `node`, the nodes of the network; without it a missing node is no path.
    """
    p = paths.select(F.col("source").alias("__s"), F.col("node").alias("__n"), F.col("distance").alias("__d"))
    j = pairs.join(p, (F.col(origin) == F.col("__s")) & (F.col(destination) == F.col("__n")), "left").drop("__s", "__n").withColumn("__known", F.lit(True))
    if nodes is not None:
        at = nodes.select("node").where(F.col("node").isNotNull()).distinct()
        for c in (origin, destination):
            j = j.join(at.select(F.col("node").alias("__at"), F.lit(True).alias("__in")), F.col(c) == F.col("__at"), "left").withColumn("__known", F.col("__known") & F.coalesce("__in", F.lit(False))).drop("__at", "__in")
    same = F.col(origin) == F.col(destination)
    ok = ~same & F.col("__d").isNotNull()
    why = F.when(~F.col("__known"), "node_not_found").when(same, "same_node").when(F.col("__d").isNull(), "no_path")
    return (
        j.withColumn("route_length_m", F.when(ok, F.col("__d"))).withColumn("detour_ratio", F.when(ok, F.try_divide(F.col("__d"), F.col(straight))))
        .withColumn("route_found", F.coalesce(ok, F.lit(False))).withColumn("failure_reason", why).drop("__d", "__known")
    )


def contract_chains(edges: DataFrame, length: str) -> DataFrame:
    """Undirected edges with chains of nodes of degree two merged: (u, v, length, parts). Closed rings keep their least node.

    Edges that meet at a node of degree two are linked; the linked groups are components of a graph of edges.
    """
    e = materialize(undirected(edges, length).withColumn("e", F.concat_ws("\u001f", "u", "v")), "chain")
    ends = e.select("e", F.explode(F.array("u", "v")).alias("node"), length)
    deg = ends.groupBy("node").agg(F.count("*").alias("k"), F.min("e").alias("a"), F.max("e").alias("b"))
    links = deg.where(F.col("k") == 2).select(F.col("a").alias("u"), F.col("b").alias("v"))
    group = components(links, e.select("e")).select(F.col("node").alias("e"), "component")
    outer = ends.join(group, "e").join(deg.select("node", "k"), "node")
    total = e.join(group, "e").groupBy("component").agg(F.sum(length).alias(length), F.count("*").alias("parts"))
    tips = outer.groupBy("component").agg(F.min(F.when(F.col("k") != 2, F.col("node"))).alias("lo"), F.max(F.when(F.col("k") != 2, F.col("node"))).alias("hi"), F.min("node").alias("any"))
    return tips.join(total, "component").select(F.coalesce("lo", "any").alias("u"), F.coalesce("hi", "any").alias("v"), length, "parts")


def sources_of(n: Column) -> Column:
    """How many sources a graph of n nodes gets."""
    return F.least(n, F.when(n <= 50_000, 64).when(n <= 200_000, 32).when(n <= 800_000, 16).otherwise(8))


def betweenness(edges: DataFrame, k: int | None = None, seed: int = 1) -> DataFrame:
    """(node, betweenness) of the undirected unweighted graph from k sources with the smallest seeded hashes, over k.

    Without k each component is a graph of its own: it gets `sources_of` its size and is divided by that. Counts shortest
    paths level by level outward from all sources at once, then collects dependencies level by level inward.
    """
    e = materialize(both_ways(edges.select("u", "v").where(F.col("u") != F.col("v"))).distinct(), "bt")
    order = [seed_of(F.col("node").cast("string"), seed), F.col("node")]
    if k is None:
        part = materialize(components(e), "bt")
        size = part.groupBy("component").agg(F.count("*").alias("n")).select("component", sources_of(F.col("n")).alias("k"))
        nodes = materialize(part.join(size, "component"), "bt")
        rank = F.row_number().over(Window.partitionBy("component").orderBy(*order))
        src = nodes.withColumn("rank", rank).where(F.col("rank") <= 64).where(F.col("rank") <= F.col("k"))
    else:
        nodes = e.select(F.col("u").alias("node")).distinct().withColumn("k", F.lit(k))
        src = nodes.orderBy(*order).limit(k)
    seen = materialize(src.select(F.col("node").alias("s"), "node", F.lit(0).alias("lv"), F.lit(1.0).alias("paths")), "bt")
    front, level = seen, 0
    while True:
        reach = front.join(e, F.col("node") == F.col("u")).groupBy("s", F.col("v").alias("node")).agg(F.sum("paths").alias("paths"))
        front = materialize(reach.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(level + 1).alias("lv"), "paths"), "bt", after=front if front is not seen else None)
        if front.isEmpty():
            break
        level += 1
        seen = materialize(seen.unionByName(front), "bt", after=seen)
    delta = materialize(seen.where(F.col("lv") == level).select("s", "node", F.lit(0.0).alias("dep")), "bt")
    done = delta
    for lv in range(level, 0, -1):
        child = seen.where(F.col("lv") == lv).join(delta, ["s", "node"]).select("s", F.col("node").alias("c"), ((1 + F.col("dep")) / F.col("paths")).alias("per"))
        parent = seen.where(F.col("lv") == lv - 1).select("s", "node", "paths")
        up = child.join(e, F.col("c") == F.col("u")).select("s", F.col("v").alias("node"), "per").groupBy("s", "node").agg(F.sum("per").alias("per"))
        delta = materialize(parent.join(up, ["s", "node"], "left").select("s", "node", F.coalesce(F.col("per") * F.col("paths"), F.lit(0.0)).alias("dep")), "bt")
        done = done.unionByName(delta)
    total = done.where(F.col("s") != F.col("node")).groupBy("node").agg(F.sum("dep").alias("b"))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) / F.col("k")).alias("betweenness"))


def within(distance: Column, limit: float) -> tuple[Column, Column]:
    """Flag and linear score of a distance to the nearest facility: reached within the limit; 1 - d / limit, 0 beyond or if none."""
    return F.coalesce(distance <= limit, F.lit(False)), F.coalesce(F.greatest(F.lit(0.0), 1 - distance / limit), F.lit(0.0))
