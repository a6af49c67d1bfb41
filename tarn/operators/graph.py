"""Questions on edge tables: resolution, reach, guards, depth. Every walk is bounded or ends on an empty frontier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.session import stored


def resolve(calls: DataFrame, functions: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """(caller, callee, name): each call name resolved to one routine.

    calls(caller, module, name, ord), functions(fn_id, module, name, ord), imports(module, name, target, rank). One
    candidate is taken wherever it lives; of several the one in the caller's module, then the best import rank, then the
    first by order. Calls of oneself are dropped, and an edge keeps its first call name.
    """
    f = functions.select(F.col("fn_id").alias("callee"), F.col("module").alias("to"), "name", F.col("ord").alias("f_ord"))
    found = calls.join(f, "name")
    if imports is not None:
        i = imports.groupBy("module", "name", F.col("target").alias("to")).agg(F.min("rank").alias("rank"))
        found = found.join(i, ["module", "name", "to"], "left")
    else:
        found = found.withColumn("rank", F.lit(None).cast("long"))
    best = F.struct((F.col("to") != F.col("module")).alias("other"), F.coalesce("rank", F.lit(2**62)).alias("rank"), "f_ord", "callee")
    chosen = found.groupBy("caller", "name", "ord").agg(F.min(best)["callee"].alias("callee"))
    return chosen.where("caller <> callee").groupBy("caller", "callee").agg(F.min_by("name", F.struct("ord", "name")).alias("name"))


def unresolved(calls: DataFrame, functions: DataFrame) -> DataFrame:
    return calls.join(functions.select("name").distinct(), "name", "left_anti").select("caller", "name").distinct()


def within(edges: DataFrame, seeds: DataFrame, hops: int | None = None, include: bool = True) -> DataFrame:
    """(seed, node, depth): nodes reached from each seed along edges (src, dst), at their least depth; all of them if hops is None.

    Level by level; a level is joined once and loses what was seen before, so cycles end.
    """
    level = stored(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0).cast("long")))
    levels, depth = [level], 0
    while hops is None or depth < hops:
        depth += 1
        step = level.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("seed", "node")
        level = stored(step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if not level.limit(1).count():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels if include else levels[1:] or [level])


def nearest(edges: DataFrame, doors: DataFrame, guards: DataFrame, hops: int = 3) -> DataFrame:
    """(door, guard, hops, route): the nearest guard along edges within ``hops``, the least id of equally near ones; null without.

    A walk stops at the first guard it meets. The route names the nodes after the door.
    """
    ids = guards.select(F.col("node").alias("dst"), F.lit(True).alias("_guard")).distinct()
    level = stored(doors.select(F.col("node").alias("door"), "node", F.array().cast("array<string>").alias("route")).distinct())
    found = []
    for depth in range(1, hops + 1):
        step = level.join(edges.select(F.col("src").alias("node"), "dst"), "node").join(ids, "dst", "left")
        step = step.select("door", F.col("dst").alias("node"), F.concat("route", F.array(F.col("dst").cast("string"))).alias("route"), F.coalesce("_guard", F.lit(False)).alias("_guard"))
        step = stored(step.groupBy("door", "node", "_guard").agg(F.min("route").alias("route")))
        hit = step.where("_guard").groupBy("door").agg(F.min(F.struct("node", "route")).alias("x")).select("door", F.col("x.node").alias("guard"), F.lit(depth).cast("long").alias("hops"), F.array_join("x.route", ">").alias("route"))
        found.append(hit)
        level = step.where("NOT _guard").join(hit.select("door"), "door", "left_anti").select("door", "node", "route")
    best = reduce(DataFrame.unionByName, found)
    return doors.select(F.col("node").alias("door")).distinct().join(best, "door", "left")


def depths(nodes: DataFrame, edges: DataFrame, most: int = 64) -> DataFrame:
    """(node, depth): 1 for a leaf, else one more than the deepest successor, for the nodes that no cycle holds or feeds on; most rounds."""
    known = stored(nodes.select("node").distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("depth", F.lit(1).cast("long")))
    all_known = known
    left = stored(edges.select("src", "dst").distinct())
    outs = stored(left.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    for _ in range(most):
        ready = left.join(all_known.select(F.col("node").alias("dst"), "depth"), "dst").groupBy("src").agg(F.count(F.lit(1)).alias("k"), F.max("depth").alias("d")).join(outs, "src").where("k = n")
        new = stored(ready.select(F.col("src").alias("node"), (F.col("d") + 1).alias("depth")).join(all_known.select("node"), "node", "left_anti"))
        if not new.limit(1).count():
            break
        all_known = stored(all_known.unionByName(new))
    return all_known


def nearest_before(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str) -> DataFrame:
    """As-of join: each point with the last mark of its key at or before it, by one sort of both together."""
    both = points.withColumn("_m", F.lit(None).cast(dict(marks.dtypes)[mark])).withColumn("_kind", F.lit(1)).unionByName(marks.select(key, at, F.col(mark).alias("_m")).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(mark, F.last("_m", ignorenulls=True).over(w)).where("_kind = 1").drop("_kind", "_m")


def touched(findings: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (path, line) inside a hunk (path, first, last) of their file, and the others."""
    on = [findings["path"] == hunks["path"], findings["line"].between(hunks["first"], hunks["last"])]
    return findings.join(hunks, on, "left_semi"), findings.join(hunks, on, "left_anti")
