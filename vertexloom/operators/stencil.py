"""Relaxation on a periodic grid: each interior cell becomes the mean of its four neighbours.

Cells are rows (``y``, ``x``, ``value``).  Each cell sends a quarter of its value to its neighbours, and sums by
target cell give the new grid, so one aggregation does a step; the first and last column are fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vertexloom.plans.staging import discard, stage


@dataclass
class Relaxation:
    cells: DataFrame
    norms: list[float]


def boundary_grid(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Zero inside, a sine on the first and last column."""
    y, x = F.floor(F.col("id") / nx), F.col("id") % nx
    wave = F.sin(F.lit(2 * math.pi) * y / F.lit(max(ny - 1, 1)))
    return spark.range(nx * ny).select(y.alias("y"), x.alias("x"), F.when((x == 0) | (x == nx - 1), wave).otherwise(0.0).alias("value"))


def relax_step(cells: DataFrame, nx: int, ny: int) -> DataFrame:
    """``y``, ``x``, ``value``, ``prev`` after one step; rows wrap around."""
    ends = lambda c: (F.col(c) == 0) | (F.col(c) == nx - 1)
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    sent = cells.select("y", "x", "value", F.explode(moves).alias("m")).select(F.pmod(F.col("y") + F.col("m.dy"), F.lit(ny)).alias("y"), (F.col("x") + F.col("m.dx")).alias("x"), "value")
    mean = sent.where(F.col("x").between(1, nx - 2)).groupBy("y", "x").agg((F.sum("value") / 4).alias("mean"))
    joined = cells.withColumnRenamed("value", "prev").join(mean, ["y", "x"], "left")
    return joined.select("y", "x", F.when(ends("x"), F.col("prev")).otherwise(F.coalesce("mean", F.lit(0.0))).alias("value"), "prev")


def row_blocks(spark: SparkSession, ny: int, ranks: int) -> DataFrame:
    """``rank``, ``first_row``, ``rows``: the inner rows 1 to ny - 2 in blocks whose sizes are one apart at most, smaller ones first."""
    low = (ny - 2) // ranks
    few = ranks * (low + 1) - (ny - 2)
    rank = F.col("id")
    first = 1 + rank * low + F.greatest(rank - few, F.lit(0))
    return spark.range(ranks).select(rank.cast("int").alias("rank"), first.cast("int").alias("first_row"), F.when(rank < few, low).otherwise(low + 1).cast("int").alias("rows"))


def relax(cells: DataFrame, nx: int, ny: int, steps: int = 1000, tol: float = 1e-8, check_every: int = 1) -> Relaxation:
    """Steps until the L2 norm of a step is ``tol`` or less, or for ``steps``; the norm is looked at every ``check_every`` steps."""
    norms: list[float] = []
    old = None
    for number in range(steps):
        seen, checked = Observation(), number % check_every == 0
        cells.sparkSession.sparkContext.setJobDescription(f"relaxation: step {number + 1}")
        moved = relax_step(cells, nx, ny)
        if checked:
            moved = moved.observe(seen, F.sqrt(F.sum((F.col("value") - F.col("prev")) * (F.col("value") - F.col("prev")))).alias("n"))
        written = stage(moved, "grid")
        if old is not None:
            discard(old)
        old, cells = written, written.select("y", "x", "value")
        if checked:
            norms.append(seen.get["n"])
            if norms[-1] <= tol:
                break
    cells.sparkSession.sparkContext.setJobDescription(None)
    return Relaxation(cells, norms)


def differing(a: DataFrame, b: DataFrame, tol: float) -> DataFrame:
    """``cells``: how many differ by more than ``tol`` or are in one grid alone."""
    joined = a.select("y", "x", F.col("value").alias("v")).join(b.select("y", "x", F.col("value").alias("w")), ["y", "x"], "full")
    return joined.agg(F.count_if(F.coalesce(F.abs(F.col("v") - F.col("w")) > tol, F.lit(True))).alias("cells"))
