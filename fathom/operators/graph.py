"""Graph operators: reachability over edges with filters, paths to targets, components, rebuild plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stage, unstage

#: Levels after which the nodes seen are put into one table.
MERGE = 12


def reach(edges: DataFrame, roots: DataFrame, direction: str = "down", max_depth: int | None = None, edge_filter: Column | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(node, depth) of all nodes reached from the roots (node), level by level: a frontier joined to the edges, minus the nodes seen.

    edges (src, dst); nodes (node) limits what may be entered. As many rounds as there are levels, or max_depth if that is given; neither side is collected."""
    e = edges if edge_filter is None else edges.where(edge_filter)
    src, dst = ("src", "dst") if direction == "down" else ("dst", "src")
    e = e.select(F.col(src).alias("node"), F.col(dst).alias("to")).distinct()
    if nodes is not None:
        e = e.join(nodes.select(F.col("node").alias("to")).distinct(), "to", "left_semi")
    e = stage(e, "edges")
    levels = [stage(roots.select("node").distinct().withColumn("depth", F.lit(0)), "level")]
    seen, depth = levels[0], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = levels[-1].select("node").join(e, "node").select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti")
        front = stage(step.withColumn("depth", F.lit(depth)), "level")
        if front.isEmpty():
            unstage(front)
            break
        if len(levels) == MERGE:
            merged = stage(seen, "seen")
            unstage(*levels[:-1])
            levels, seen = [merged], merged
        levels.append(front)
        seen = seen.unionByName(front)
    unstage(e)
    return seen


def paths_to(edges: DataFrame, roots: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(src, dst): edges that lie on some path from a root to a target."""
    down = reach(edges, roots, "down", max_depth).select("node")
    up = reach(edges, targets, "up", max_depth).select("node")
    on = down.join(up, "node", "left_semi").distinct()
    return edges.join(on.select(F.col("node").alias("src")), "src", "left_semi").join(on.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable.

    edges: (a, b) longs, in any direction, repeats allowed. Nodes without an edge are not returned.
    Alternates large-star and small-star rounds until the edges stop changing; each round is a
    map-side-combined minimum and a join, so a hub of any degree is never gathered in one task.
    """
    a, b = F.col("a"), F.col("b")
    now = stage(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "cc")
    sign = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 998244353)).first())
    last = sign(now)
    while last[0]:
        both = now.select(a, b).union(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m0")).select(a.alias("u"), F.least("u", "m0").alias("m"))
        large = both.join(low, both.a == low.u).where(b > a).select(b.alias("a"), F.col("m").alias("b"))
        large = large.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m")).select(a.alias("u"), "m")
        hung = large.join(floor, large.a == floor.u)
        small = hung.select(b.alias("a"), F.col("m").alias("b")).union(floor.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = small.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
        nxt = stage(small, "cc")
        got = sign(nxt)
        unstage(now)
        now = nxt
        if got == last:
            break
        last = got
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select(b.alias("node"), b.alias("component")).distinct())


def rebuild_plan(impact: DataFrame, kinds: DataFrame, policies: dict[str, str], fallback: str = "review") -> DataFrame:
    """(node, kind, depth, action, ord): an action for each affected node by its kind, in order of depth and node."""
    named = F.create_map(*[F.lit(x) for kv in policies.items() for x in kv])
    rows = impact.where("depth > 0").join(kinds, "node", "left")
    return rows.select("node", "kind", "depth", F.coalesce(named[F.col("kind")], F.lit(fallback)).alias("action"))
