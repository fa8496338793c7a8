"""Bounded traversal of the dependency graph, by joins of whole frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, MOST_DEPTH, REPORT_DEPTH = 3, 20, 10
#: Frontiers of up to so many nodes are broadcast to the edges; beyond it both are shuffled.
FEW = 100_000


def levels(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """``node, depth`` of the nodes at less than ``depth`` steps from the root, along ``edges(src, dst)``.

    The plan is unrolled for a fixed depth: each step joins a frontier of distinct nodes with the edges, and a node's
    depth is its least. Nodes of earlier steps leave each frontier, so that a step costs its own edges only.
    """
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"))
    seen, n, met = frontier, 1, 1
    few = lambda df, size: F.broadcast(df) if size <= FEW else df
    for d in range(1, depth):
        step = edges.join(few(frontier.select(F.col("node").alias("src")), n), "src").select(F.col("dst").alias("node")).distinct()
        step = settled(step.join(few(seen.select("node"), met), "node", "left_anti").withColumn("depth", F.lit(d)))
        n = step.count()
        if not n:
            break
        seen, frontier, met = seen.unionByName(step), step, met + n
    return seen


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder; where none is set, the plan stays as it is, but cached."""
    sc = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) or not sc._jsc.sc().getCheckpointDir().isEmpty():
        return df.checkpoint()
    return df.persist()


def dependency_graph(dependencies: DataFrame, root: str, max_depth: int = DEPTH, internal_only: bool = False) -> DataFrame:
    """``from, to, dep_kind, depth``: every edge out of a node nearer than ``max_depth``, with the depth of that node."""
    edges = dependencies.where("is_internal") if internal_only else dependencies
    if min(max_depth, MOST_DEPTH) <= 0:
        return edges.limit(0).select(F.col("package").alias("from"), F.col("dependency").alias("to"), "dep_kind", F.lit(0).alias("depth"))
    near = levels(edges.select(F.col("package").alias("src"), F.col("dependency").alias("dst")), root, min(max_depth, MOST_DEPTH))
    return edges.join(near.select(F.col("node").alias("package"), "depth"), "package").select(F.col("package").alias("from"), F.col("dependency").alias("to"), "dep_kind", "depth")


def reverse_dependency_graph(dependencies: DataFrame, root: str, max_depth: int = DEPTH) -> DataFrame:
    """The same against the direction of the edges, over internal edges; an edge still reads dependent to dependency."""
    turned = dependencies.where("is_internal").select(F.col("dependency").alias("package"), F.col("package").alias("dependency"), "dep_kind", "is_internal")
    return dependency_graph(turned, root, max_depth).select(F.col("to").alias("from"), F.col("from").alias("to"), "dep_kind", "depth")


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("depth", "from", "to", "dep_kind")


def path_between(dependencies: DataFrame, start: str, goal: str, max_depth: int = REPORT_DEPTH) -> DataFrame:
    """Edges on walks from ``start`` to ``goal`` within the edges that ``start`` reaches."""
    return path_within(settled(dependency_graph(dependencies, start, max_depth)), goal, max_depth)


def path_within(forward: DataFrame, goal: str, max_depth: int = REPORT_DEPTH) -> DataFrame:
    """Edges of ``forward(from, to, dep_kind)`` on walks to ``goal``."""
    back = levels(forward.select(F.col("to").alias("src"), F.col("from").alias("dst")).distinct(), goal, max_depth * 2 + 2)
    marked = back.select("node")
    ends = forward.join(marked.withColumnRenamed("node", "from"), "from", "left_semi").join(marked.withColumnRenamed("node", "to"), "to", "left_semi")
    return ends.select("from", "to", "dep_kind")


def intermediates(path: DataFrame, packages: DataFrame, start: str, goal: str) -> DataFrame:
    """Packages between both ends of a path, with what is known of them."""
    nodes = path.select(F.col("from").alias("name")).union(path.select("to")).distinct().where(~F.col("name").isin(start, goal))
    return nodes.join(packages.select("name", "path", "kind", "description"), "name", "left")


def impact(dependencies: DataFrame, name: str) -> DataFrame:
    """One row: direct dependents, all dependents within the report's depth, and those that are only transitive."""
    direct = dependencies.where(F.col("dependency") == name).select("package").distinct()
    reach = reverse_dependency_graph(dependencies, name, REPORT_DEPTH).select(F.col("from").alias("package")).distinct()
    both = direct.withColumn("d", F.lit(1)).join(reach.withColumn("r", F.lit(1)), "package", "full_outer")
    return both.agg(F.count("d").alias("direct"), F.count("r").alias("total"), F.count(F.when(F.col("d").isNull(), 1)).alias("transitive_only"))
