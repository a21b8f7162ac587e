"""Degrees, neighbours, and who owns them.  Undirected, every neighbour once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import OWNERS, owner
from vertexloom.graph import Graph


def degrees(graph: Graph) -> DataFrame:
    """``vertex``, ``degree`` of every id from 0 to N-1: its distinct neighbours, itself counted once if it has a loop."""
    counted = graph.adjacency_sets().groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))
    return graph.ids().join(counted, "vertex", "left").fillna(0, ["degree"])


def top_degrees(graph: Graph, k: int = 10) -> DataFrame:
    return degrees(graph).orderBy(F.desc("degree"), "vertex").limit(k)


def bottom_degrees(graph: Graph, k: int = 10) -> DataFrame:
    return degrees(graph).orderBy("degree", "vertex").limit(k)


def degree_of(graph: Graph, vertex: int) -> DataFrame:
    """``vertex``, ``degree``; 0 for an id that has no edge or is out of range."""
    near = graph.edges.where((F.col("src") == vertex) | (F.col("dst") == vertex))
    other = F.when(F.col("src") == vertex, F.col("dst")).otherwise(F.col("src"))
    return near.agg(F.count_distinct(other).alias("degree")).select(F.lit(vertex).cast("long").alias("vertex"), "degree")


def neighbors(graph: Graph, vertex: int, owners: int = OWNERS) -> DataFrame:
    """``neighbor``, ``owner`` of one vertex, from a filtered scan; raises for an id out of range."""
    if not 0 <= vertex < graph.num_vertices:
        raise ValueError(f"vertex {vertex} is out of range 0..{graph.num_vertices - 1}")
    near = graph.edges.where((F.col("src") == vertex) | (F.col("dst") == vertex))
    other = F.when(F.col("src") == vertex, F.col("dst")).otherwise(F.col("src"))
    return near.select(other.alias("neighbor")).distinct().select("neighbor", owner("neighbor", owners).alias("owner"))


def neighbors_by_owner(graph: Graph, vertex: int, owners: int = OWNERS) -> DataFrame:
    """``owner``, ``neighbors``; owners without a neighbour have zero."""
    counted = neighbors(graph, vertex, owners).groupBy("owner").agg(F.count("*").alias("neighbors"))
    every = graph.spark.range(owners).select(F.col("id").cast("int").alias("owner"))
    return every.join(counted, "owner", "left").fillna(0, ["neighbors"])
