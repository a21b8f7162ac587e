"""Text reports with the wording that ``sources.runlogs`` reads again.

Reports are driver-side text over results of a few rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from vertexloom.operators import bfs as search_ops
from vertexloom.operators.components import counts, largest_components, size_buckets
from vertexloom.operators.degree import bottom_degrees, neighbors, neighbors_by_owner, top_degrees
from vertexloom.operators.pagerank import Ranking, top_k


@dataclass
class PerfRecord:
    """Seconds of one run; ``communication`` is the part of the traversal that went into exchanges."""

    total: float
    loading: float
    traversal: float
    levels: int
    communication: float = 0.0
    level_times: list[float] = field(default_factory=list)

    @property
    def computation(self) -> float:
        return self.traversal - self.communication

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (self.total, self.loading, self.traversal, self.communication, self.computation, self.levels, self.level_times)
        return spark.createDataFrame([row], "total double, loading double, traversal double, communication double, computation double, levels int, level_times array<double>")


def _share(part: float, whole: float) -> float:
    return 100 * part / whole if whole > 0 else 0.0


# The wording of the report lines.
def performance(p: PerfRecord) -> str:
    return "\n".join(
        (
            f"Total execution time: {p.total:.6f} s",
            f"Graph loading/init time: {p.loading:.6f} s ({_share(p.loading, p.total):.2f}%)",
            f"BFS traversal time: {p.traversal:.6f} s ({_share(p.traversal, p.total):.2f}%)",
            f"Communication time: {p.communication:.6f} s ({_share(p.communication, p.traversal):.2f}% of BFS time)",
            f"Computation time: {p.computation:.6f} s ({_share(p.computation, p.traversal):.2f}% of BFS time)",
            f"Number of BFS levels: {p.levels}",
            f"Average time per level: {p.traversal / p.levels if p.levels else 0:.6f} s",
        )
    )


def statistics(search: search_ops.Search) -> str:
    r = search_ops.summary(search).first()
    return "\n".join(
        (
            f"Source vertex: {r['source']}",
            f"Visited vertices: {r['visited']} ({r['visited_percent']:.2f}% of graph)",
            f"Maximum distance from source: {r['max_distance']}",
            f"Average distance from source: {r['avg_distance']:.2f}",
        )
    )


def levels(search: search_ops.Search) -> str:
    """The level table, by the distance as shown."""
    rows = search_ops.level_histogram(search_ops.distances(search), "ref_distance").orderBy("level").collect()
    return "\n".join(["Level | Count | Percent"] + [f"{r['level']} | {r['count']} | {r['percent']:.2f}%" for r in rows])


def partitions(stats: DataFrame) -> str:
    return "\n".join(f"Rank {r['owner']}: Loaded {r['slots']} vertices and {r['edges']} edges in local partition" for r in stats.orderBy("owner").collect())


def pagerank(ranking: Ranking, seconds: float, k: int = 10) -> str:
    lines = [f"{i}. Vertex {r['vertex']}: {r['rank']:.9f}" for i, r in enumerate(top_k(ranking.ranks, k).collect(), 1)]
    each = seconds / ranking.iterations if ranking.iterations else 0.0
    return "\n".join([*lines, f"Iterations: {ranking.iterations}", f"Converged: {'Yes' if ranking.converged else 'No'}", f"Average iteration time: {each:.6f} s"])


def degrees(graph, k: int = 10) -> str:  # noqa: ANN001
    table = lambda title, df: [title] + [f"{r['vertex']} | {r['degree']}" for r in df.collect()]
    return "\n".join(table("Highest degrees", top_degrees(graph, k)) + table("Lowest degrees", bottom_degrees(graph, k)))


def components(graph, found: DataFrame, shown: int = 20) -> str:  # noqa: ANN001
    total = counts(graph, found, shown).first()
    lines = [f"Vertices: {total['vertices']}", f"Edges: {total['edges']}", f"Components: {total['components']}"]
    lines += [f"{r['rank']} | {r['size']} | {r['percent']:.2f}%" for r in largest_components(found, shown).orderBy("rank").collect()]
    lines += [f"... and {total['remainder']} more"] if total["remainder"] else []
    return "\n".join(lines + [f"{r['bucket']}: {r['components']} ({r['percent']:.2f}%)" for r in size_buckets(found).collect()])


def neighbor_list(graph, vertex: int, owners: int = 4, per_line: int = 5) -> str:  # noqa: ANN001
    counted = [f"Owner {r['owner']}: {r['neighbors']}" for r in neighbors_by_owner(graph, vertex, owners).orderBy("owner").collect()]
    near = [f"{r['neighbor']}@{r['owner']}" for r in neighbors(graph, vertex, owners).orderBy("neighbor").collect()]
    return "\n".join(counted + [" ".join(near[i : i + per_line]) for i in range(0, len(near), per_line)])
