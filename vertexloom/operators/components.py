"""Connected components by alternating large and small stars.

Kiveris et al., "Connected components in MapReduce and beyond": logarithmically many rounds also on long
paths.  Minima are aggregated before the shuffle and joined back to the edges, so a hub's neighbours
are never gathered in one task; the join on a hub is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.functions import BUCKETS, percent, size_bucket
from vertexloom.graph import Graph
from vertexloom.operators.small import SMALL_EDGES, components_kernel, in_one_task, is_small
from vertexloom.plans.staging import discard, stage


#: Pairs from which on a hub may be worth splitting.
MANY = 5_000_000


def _least(pairs: DataFrame, many: bool) -> DataFrame:
    """``u`` and the least, ``m``, of its neighbourhood.

    Where there are ``many`` pairs it is written, so that the join back to the edges stands on two plain exchanges:
    only then can adaptive execution split the partition of a hub.
    """
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return stage(least, "star-minima") if many else least


def _state() -> tuple[Column, Column]:
    """What tells two edge tables apart: the count and a sum of hashes."""
    return F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")


def large_star(edges: DataFrame, many: bool = False) -> DataFrame:
    """Every larger neighbour is linked to the least of the neighbourhood.  A written table."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, many)
    linked = stage(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
    discard(least)
    return linked


def small_star(edges: DataFrame, many: bool = False) -> tuple[DataFrame, tuple]:
    """Every smaller neighbour, and the vertex itself, is linked to the least of them.  A written table, and its state, seen on the way."""
    least, seen = _least(edges, many), Observation()
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    linked = moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    written = stage(linked.observe(seen, *_state()), "small-stars")
    discard(least)
    return written, (seen.get["n"], seen.get["h"])


def star_roots(pairs: DataFrame, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``node`` and ``root`` (least of its component) of each node of ``pairs`` (u, v) that isn't a root.

    As soon as the distinct pairs left, counted, are ``small_edges`` or fewer, they are joined in one task.
    """
    seen = Observation()
    distinct = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stage(distinct.observe(seen, *_state()), "stars")
    before, state, rounds = None, (seen.get["n"], seen.get["h"]), 0
    while True:
        if state == before or not state[0]:
            pairs.sparkSession.sparkContext.setJobDescription(None)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if state[0] <= small_edges:
            found = in_one_task(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), components_kernel, "vertex long, component long")
            return found.where("vertex <> component").select(F.col("vertex").alias("node"), F.col("component").alias("root"))
        many = state[0] > MANY
        rounds += 1
        pairs.sparkSession.sparkContext.setJobDescription(f"components: round {rounds}")
        before, large = state, large_star(edges, many)
        discard(edges)
        edges, state = small_star(large, many)
        discard(large)


def connected_components(graph: Graph, small_edges: int | None = None) -> DataFrame:
    """``vertex`` and ``component`` (its least id) of every id that occurs in an edge, edges undirected.  A written table.

    A graph of ``small_edges`` edges or fewer is labelled in one task (0: never).
    """
    if is_small(graph, small_edges):
        return stage(in_one_task(graph, components_kernel, "vertex long, component long"), "components")
    roots = star_roots(graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v")), small_edges=0)
    labelled = graph.vertices().join(roots.withColumnRenamed("node", "vertex"), "vertex", "left")
    return stage(labelled.select("vertex", F.coalesce("root", "vertex").alias("component")), "components")


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def largest_components(components: DataFrame, k: int = 20) -> DataFrame:
    """``rank``, ``component``, ``size``, ``percent`` of all vertices, of the k largest; ties to the smaller label."""
    sizes = component_sizes(components)
    total = sizes.agg(F.sum("size")).scalar()
    top = sizes.orderBy(F.desc("size"), "component").limit(k)
    ranked = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("order"), "component", "size"))).alias("all"))
    rows = ranked.select(F.posexplode("all").alias("at", "c"))
    return rows.select((F.col("at") + 1).alias("rank"), "c.component", "c.size", percent("c.size", total).alias("percent"))


def size_buckets(components: DataFrame) -> DataFrame:
    """``bucket``, ``components``, ``percent`` of all components; empty buckets have zero."""
    counted = component_sizes(components).groupBy(size_bucket("size").alias("bucket")).agg(F.count("*").alias("components"))
    every = components.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    joined = every.join(counted, "bucket", "left").fillna(0, ["components"])
    total = counted.agg(F.coalesce(F.sum("components"), F.lit(0))).scalar()
    return joined.select("bucket", "components", percent("components", total).alias("percent"))


def counts(graph: Graph, components: DataFrame, shown: int = 20) -> DataFrame:
    """One row: ``vertices``, ``edges``, ``components`` and how many components a list of ``shown`` leaves out."""
    found = components.agg(F.count("*").alias("vertices"), F.count_if(F.col("vertex") == F.col("component")).alias("components"))
    edges = graph.edges.agg(F.count("*")).scalar().alias("edges")
    return found.select("vertices", edges, "components", F.greatest(F.col("components") - shown, F.lit(0)).alias("remainder"))
