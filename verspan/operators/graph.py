"""Closures and bounded walks over edge tables, by joins of a frontier.

Each step joins the frontier with the edges and drops what is known by an anti join; what
is new is checkpointed to the shared folder, so that plans stay short at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verspan.shared import ready, stored


#: Steps after which the parts of a closure are put together in one checkpoint.
COMPACT = 16


def closure(edges: DataFrame, roots: DataFrame, src: str, dst: str) -> DataFrame:
    """(root, node, depth) of all nodes reachable along src -> dst, each once, nearest first, to any depth."""
    ready(edges.sparkSession)
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct().checkpoint()
    seen = frontier = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).cast("long").alias("depth")).distinct().checkpoint()
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(e, "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti")
        frontier = step.withColumn("depth", F.lit(depth).cast("long")).checkpoint()
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:
            seen = seen.checkpoint()
    return seen


def bounded_closure(edges: DataFrame, roots: DataFrame, src: str, dst: str, depth: int) -> DataFrame:
    """As ``closure`` for a known depth: one lazy plan without intermediate actions."""
    e = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    frontier = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).cast("long").alias("depth"))
    out = frontier
    for d in range(1, depth + 1):
        frontier = frontier.join(e, "node").select("root", F.col("next").alias("node"), F.lit(d).cast("long").alias("depth")).distinct()
        out = out.unionByName(frontier)
    return out.groupBy("root", "node").agg(F.min("depth").alias("depth"))


def call_chains(refs: DataFrame, targets: DataFrame, callee: str, caller: str, depth: int, order: Column | None = None, most: int = 200) -> DataFrame:
    """Paths of callers of each target, outermost first, at most ``depth`` long and without repeats.

    A path ends at the depth, at a frame without callers, or with the frame that
    closes a cycle. The first ``most`` paths of each target by text stay.
    """
    e = refs.select(F.col(callee).alias("at"), F.col(caller).alias("up")).where("at is not null and up is not null").distinct()
    live = targets.select(F.col(targets.columns[0]).alias("target"), F.col(targets.columns[0]).alias("at"), F.array().cast("array<string>").alias("path"), F.array(F.col(targets.columns[0])).alias("seen"))
    done = None
    for d in range(1, depth + 1):
        step = live.join(e, "at", "left")
        ended = step.where("up is null and size(path) > 0").select("target", "path")
        grown = step.where("up is not null").select("target", F.col("up").alias("at"), F.concat("path", F.array("up")).alias("path"), "seen", F.array_contains("seen", F.col("up")).alias("cycle"))
        stop = grown if d == depth else grown.where("cycle")
        done = ended.unionByName(stop.select("target", "path")) if done is None else done.unionByName(ended).unionByName(stop.select("target", "path"))
        live = grown.where("not cycle").select("target", "at", "path", F.concat("seen", F.array("at")).alias("seen"))
    chains = done.select("target", F.array_join(F.reverse("path"), " > ").alias("chain"))
    r = F.row_number().over(Window.partitionBy("target").orderBy("chain"))
    return chains.withColumn("pos", r.cast("long")).where(F.col("pos") <= most)


def nearest_declaring(entities: DataFrame, ancestors: DataFrame, declared: DataFrame, owner: str, value: str) -> DataFrame:
    """For each entity the nearest ancestor (root, node, depth) that declares a value: (root, declared_in, depth, value)."""
    hit = entities.select(F.col(entities.columns[0]).alias("root")).join(ancestors, "root").join(declared.select(F.col(owner).alias("node"), F.col(value).alias("value")), "node")
    best = F.min_by(F.struct(F.col("node").alias("declared_in"), "depth", "value"), F.struct("depth", "node"))
    return hit.groupBy("root").agg(best.alias("b")).select("root", "b.declared_in", "b.depth", "b.value")


def tree_labels(nodes: DataFrame, by: list[str], node: str, parent: str) -> DataFrame:
    """(by, node, depth, first, last) of forests: x lies below y if and only if y.first < x.first <= y.last.

    nodes: one row for each node, its parent null or unknown at the top. Each node's path to the top
    doubles with each round of joins, so the number of rounds is the logarithm of the depth; nodes are
    then numbered by their paths, forest by forest. A node whose path runs into a cycle has no label.
    """
    own = nodes.select(*by, F.col(node).alias("node"), F.col(parent).alias("up")).dropDuplicates([*by, "node"])
    known = own.select(*by, F.col("node").alias("up"), F.lit(True).alias("_known"))
    # path: from below ``up`` to the node; what has no ``up`` left is at the top
    state = stored(own.join(known, [*by, "up"], "left").select(*by, "node", F.when(F.col("_known"), F.col("up")).alias("up"), F.array("node").alias("path")), "paths")
    open_ = state.where("up is not null").count()
    while open_:
        above = state.select(*by, F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        state = stored(state.join(above, [*by, "up"], "left").select(*by, "node", F.when(F.col("up").isNotNull(), F.col("next")).alias("up"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("upper", "path")).alias("path"))
                       .where(F.size(F.array_distinct("path")) == F.size("path")), "paths")
        open_ = state.where("up is not null").count()
    size = state.select(*by, F.explode("path").alias("node")).groupBy(*by, "node").agg(F.count("*").alias("_size"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy("path"))
    numbered = state.withColumn("first", first.cast("long")).join(size, [*by, "node"])
    return numbered.select(*by, F.col("node").alias(node), (F.size("path") - 1).cast("long").alias("depth"), "first", (F.col("first") + F.col("_size") - 1).alias("last"))
