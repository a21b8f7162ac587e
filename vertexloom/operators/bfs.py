"""Breadth-first search: semi-naive frontier expansion, one written level and one job per round.

Graphs that are counted as small run in one task instead (``operators.small``).

The edges are written once, bucketed by source.  A small frontier is broadcast, so the edges are scanned where they
lie; a large one is shuffled to the buckets, and the edges stay.  Targets are made distinct by a shuffle on the
vertex, with duplicates removed before it.  Vertices of earlier levels are removed by a broadcast while they are few, later by a join on
that same partitioning.  Counts decide, every round; a level's count is observed while it is written.
"""

from __future__ import annotations

import logging
import random
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.functions import percent, shown_distance
from vertexloom.graph import Graph
from vertexloom.operators.small import bfs_kernel, in_one_task, is_small
from vertexloom.plans.staging import Levels, bucketed, discard, stage

log = logging.getLogger(__name__)

#: Rows of a frontier up to which it is broadcast (16 bytes each).
BROADCAST_ROWS = 200_000


@dataclass
class Search:
    """A search: ``hops`` has the reached vertices with ``hop``; sizes, and seconds where levels were run one by one."""

    graph: Graph
    source: int
    hops: DataFrame
    known_sizes: list[int] | None = None
    level_seconds: list[float] = field(default_factory=list)

    @property
    def level_sizes(self) -> list[int]:
        if self.known_sizes is None:
            counted = self.hops.groupBy("hop").count().collect()
            self.known_sizes = [n for _, n in sorted((r["hop"], r["count"]) for r in counted)]
        return self.known_sizes


def choose_source(num_vertices: int, wanted: int | str | None = None, seed: int | None = None) -> int:
    """The source asked for; 1 if it is out of range; a random one if none is asked for.

    Text that isn't a number counts as 0.  A graph of one vertex has source 0.
    """
    if num_vertices <= 1:
        return 0
    if wanted is None:
        return random.Random(seed).randrange(num_vertices)
    try:
        number = int(wanted)
    except ValueError:
        number = 0
    return number if 0 <= number < num_vertices else 1


def expand(frontier: DataFrame, edges: DataFrame, small: bool) -> DataFrame:
    """Distinct targets of the frontier's edges, as ``vertex``."""
    side = F.broadcast(frontier) if small else frontier
    return edges.join(side.select(F.col("vertex").alias("src")), "src").select(F.col("dst").alias("vertex")).distinct()


def unseen(candidates: DataFrame, visited: DataFrame, few_visited: bool = False) -> DataFrame:
    """Candidates that no earlier level has; the flag says that the visited ones may be broadcast."""
    seen = visited.select("vertex")
    return candidates.join(F.broadcast(seen) if few_visited else seen, "vertex", "left_anti")


def bfs(graph: Graph, source: int | str | None = None, max_hops: int | None = None, seed: int | None = None, broadcast_rows: int = BROADCAST_ROWS, small_edges: int | None = None) -> Search:
    """Distances from one source along the edges' direction.

    A graph of ``small_edges`` edges or fewer is searched in one task (0: never).
    """
    spark = graph.spark
    if is_small(graph, small_edges):
        start = _source(graph.num_vertices, source, seed)
        done = stage(in_one_task(graph, bfs_kernel(start, max_hops), "kind int, vertex long, hop int, n long, seconds double"), "bfs")
        levels = [(r["n"], r["seconds"]) for r in done.where("kind = 1").orderBy("vertex").collect()]
        for level, (n, _) in enumerate(levels):
            log.info("level %d: %d vertices", level, n)
        sizes = [n for n, _ in levels if n]
        return Search(graph, start, done.where("kind = 0").select("vertex", "hop"), sizes, [s for _, s in levels[1:]])
    start = _source(graph.num_vertices, source, seed)
    edges = bucketed(graph.edges, "bfs_edges", "src")
    levels = Levels(spark, "bfs", "vertex long, hop int")
    frontier = levels.append(spark.createDataFrame([(start, 0)], "vertex long, hop int").coalesce(1))
    sizes, seconds = [1], []
    while sizes[-1] and (max_hops is None or len(sizes) <= max_hops):
        began = time.perf_counter()
        spark.sparkContext.setJobDescription(f"bfs: level {len(sizes)}")
        found = expand(frontier.select("vertex"), edges, sizes[-1] <= broadcast_rows)
        seen = Observation()
        fresh = unseen(found, levels.all(), sum(sizes) <= broadcast_rows).select("vertex", F.lit(len(sizes)).alias("hop"))
        frontier = levels.append(fresh.observe(seen, F.count("*").alias("n")))
        sizes.append(seen.get["n"])
        seconds.append(time.perf_counter() - began)
        log.info("level %d: %d vertices", len(sizes) - 1, sizes[-1])
    spark.sparkContext.setJobDescription(None)
    discard(edges)
    return Search(graph, start, levels.all(), sizes if sizes[-1] else sizes[:-1], seconds)


def _source(num_vertices: int, wanted: int | str | None, seed: int | None) -> int:
    start = choose_source(num_vertices, wanted, seed)
    if wanted is not None and str(start) != str(wanted).strip():
        log.warning("source %s isn't one of %d vertices: %d instead", wanted, num_vertices, start)
    return start


def distances(search: Search, include_unreached: bool = False) -> DataFrame:
    """``vertex``, ``hop``, ``ref_distance``; unreached ids have -1."""
    hops = search.hops
    if include_unreached:
        hops = search.graph.ids().join(hops, "vertex", "left").fillna(-1, ["hop"])
    return hops.select("vertex", "hop", shown_distance("hop").alias("ref_distance"))


def level_histogram(hops: DataFrame, level: str = "hop") -> DataFrame:
    """``level``, ``count``, ``percent`` of the visited, for every level from 0 on, also empty ones."""
    counted = hops.where(F.col(level) >= 0).groupBy(F.col(level).cast("int").alias("level")).agg(F.count("*").alias("count"))
    span = counted.agg(F.max("level").alias("top"), F.sum("count").alias("all"))
    every = span.select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"), "all")
    joined = every.join(counted, "level", "left").fillna(0, ["count"])
    return joined.select("level", "count", percent("count", "all").alias("percent"))


def summary(search: Search) -> DataFrame:
    """One row: ``source``, ``visited``, ``visited_percent``, ``max_distance``, ``avg_distance`` (as shown), ``eccentricity``, ``ref_levels``."""
    d = distances(search)
    n = F.lit(search.graph.num_vertices)
    return d.agg(
        F.count("*").alias("visited"), F.max("ref_distance").alias("max_distance"), F.avg("ref_distance").alias("avg_distance"), F.max("hop").alias("eccentricity")
    ).select(
        F.lit(search.source).cast("long").alias("source"),
        "visited",
        percent("visited", n).alias("visited_percent"),
        "max_distance",
        "avg_distance",
        "eccentricity",
        (F.col("eccentricity") + 2).alias("ref_levels"),
    )
