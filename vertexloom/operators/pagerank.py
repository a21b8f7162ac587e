"""PageRank, one aggregation per iteration.

The out-degree is joined to the edges once, and the edges are written bucketed by the vertex that gives, so they
never move again: an iteration shuffles ranks, and contributions that are summed by target before the
shuffle.  Each iteration is one job: the new ranks are written, and the difference to the old ones is observed on the way.

In push form a vertex gives its rank to the targets of its edges.  In pull form it takes from them: each target gives
its rank divided by its own out-degree, and one without out-edges gives nothing.  On symmetric graphs both are the same.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vertexloom.graph import Graph
from vertexloom.operators.small import in_one_task, is_small, pagerank_kernel
from vertexloom.plans.staging import bucketed, discard, stage

log = logging.getLogger(__name__)

NORMS = {
    "l1": lambda d: F.sum(F.abs(d)),
    "linf": lambda d: F.max(F.abs(d)),
    "signed_max": F.max,
}


@dataclass
class Ranking:
    """``ranks`` has ``vertex`` and ``rank``; ``differences`` one entry per iteration."""

    ranks: DataFrame
    differences: list[float]
    converged: bool

    @property
    def iterations(self) -> int:
        return len(self.differences)


def giving_edges(graph: Graph, form: str = "push") -> DataFrame:
    """``src`` (who gives), ``dst`` (who gets) and the ``out_degree`` of who gives."""
    degrees = graph.out_degrees(all_ids=False).withColumnRenamed("vertex", "src").withColumnRenamed("degree", "out_degree")
    edges = {"push": graph, "pull": graph.reversed()}[form].edges
    return edges.join(degrees, "src")


def step(edges: DataFrame, ranks: DataFrame, n: int, damping: float) -> DataFrame:
    """``vertex``, ``rank``, ``prev`` after one iteration; vertices without in-edges keep the teleport share."""
    sent = edges.join(ranks.select(F.col("vertex").alias("src"), "rank"), "src")
    got = sent.groupBy(F.col("dst").alias("vertex")).agg(F.sum(F.lit(damping) * F.col("rank") / F.col("out_degree")).alias("got"))
    new = F.coalesce("got", F.lit(0.0)) + F.lit((1 - damping) / n)
    return ranks.select("vertex", F.col("rank").alias("prev")).join(got, "vertex", "left").select("vertex", new.alias("rank"), "prev")


def pagerank(graph: Graph, damping: float = 0.85, tol: float | None = 1e-5, max_iter: int = 100, norm: str = "l1", small_edges: int | None = None, form: str = "push") -> Ranking:
    """Ranks of every id from 0 to N-1; dangling vertices give nothing on.

    Stops when the difference of two iterations is ``tol`` or less, or after ``max_iter``; without
    ``tol`` after exactly ``max_iter``.  A graph of ``small_edges`` edges or fewer is ranked in one task (0: never).
    """
    if is_small(graph, small_edges):
        kernel = pagerank_kernel(graph.num_vertices, damping, tol, max_iter, norm, form)
        done = stage(in_one_task(graph, kernel, "kind int, id long, value double"), "ranks")
        found = [r["value"] for r in sorted(done.where("kind = 1").collect(), key=lambda r: r["id"])]
        for i, difference in enumerate(found, 1):
            log.info("iteration %d: %.9g", i, difference)
        ranks = done.where("kind = 0").select(F.col("id").alias("vertex"), F.col("value").alias("rank"))
        return Ranking(ranks, found, bool(found) and tol is not None and found[-1] <= tol)
    n = graph.num_vertices
    edges = bucketed(giving_edges(graph, form), "giving_edges", "src")
    ranks = graph.ids().select("vertex", F.lit(1.0 / max(n, 1)).alias("rank"))
    differences: list[float] = []
    old = None
    while n and len(differences) < max_iter:
        seen = Observation()
        graph.spark.sparkContext.setJobDescription(f"pagerank: iteration {len(differences) + 1}")
        new = step(edges, ranks, n, damping)
        written = stage(new.observe(seen, NORMS[norm](F.col("rank") - F.col("prev")).alias("d")), "ranks")
        if old is not None:
            discard(old)
        old, ranks = written, written.select("vertex", "rank")
        differences.append(seen.get["d"])
        log.info("iteration %d: %.9g", len(differences), differences[-1])
        if tol is not None and differences[-1] <= tol:
            break
    graph.spark.sparkContext.setJobDescription(None)
    if old is not None:
        discard(edges)
    return Ranking(ranks, differences, bool(differences) and tol is not None and differences[-1] <= tol)


def top_k(ranks: DataFrame, k: int = 10, digits: int = 9) -> DataFrame:
    """The k highest ranks, rounded; ties to the smaller vertex."""
    return ranks.select("vertex", F.round("rank", digits).alias("rank")).orderBy(F.desc("rank"), "vertex").limit(k)


def mass(ranks: DataFrame) -> DataFrame:
    """``mass``, the sum of all ranks: 1 where no vertex dangles."""
    return ranks.agg(F.sum("rank").alias("mass"))


def summary(graph: Graph, ranking: Ranking, seconds: float = 0.0) -> DataFrame:
    """One row: ``iterations``, ``converged``, the last ``difference`` and the mean ``seconds_per_iteration``."""
    last = ranking.differences[-1] if ranking.differences else None
    row = (ranking.iterations, ranking.converged, last, seconds / max(1, ranking.iterations))
    return graph.spark.createDataFrame([row], "iterations int, converged boolean, difference double, seconds_per_iteration double")


def history(graph: Graph, differences: list[float]) -> DataFrame:
    """``iteration`` from 1 and ``l1_diff``."""
    return graph.spark.createDataFrame(list(enumerate(differences, 1)), "iteration int, l1_diff double")
