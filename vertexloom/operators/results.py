"""Analytics over benchmark results: the data behind each chart.

``results`` has one row per dataset and implementation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions import dataset_label, guarded_ratio


def distinct_values(results: DataFrame, column: str) -> DataFrame:
    return results.select(F.trim(column).alias(column)).distinct()


def scaling_series(results: DataFrame, x: str, y: str) -> DataFrame:
    """``implementation``, ``x``, ``y`` where both are known: a line per implementation, by ascending x."""
    return results.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select("implementation", F.col(x).alias("x"), F.col(y).alias("y")).orderBy("implementation", "x")


def comparison(results: DataFrame) -> DataFrame:
    """``label``, ``implementation``, ``computation_time``, ``communication_time``: a point per run."""
    return results.select(dataset_label("dataset").alias("label"), "implementation", "computation_time", "communication_time")


def axis_limit(results: DataFrame, head_room: float = 1.1) -> DataFrame:
    """``axis_limit``: the larger of both maxima with head room, so that the diagonal is in view."""
    return results.agg((F.greatest(F.max("computation_time"), F.max("communication_time")) * head_room).alias("axis_limit"))


def cluster_bounds(results: DataFrame, below: float = 0.5, margin: float = 0.05) -> DataFrame:
    """Bounds of the points with both times under ``below``, widened by ``margin`` but not under 0."""
    near = results.where((F.col("computation_time") < below) & (F.col("communication_time") < below))
    low = lambda c: F.greatest(F.lit(0.0), F.min(c) - margin)
    high = lambda c: F.max(c) + margin
    return near.agg(
        low("computation_time").alias("x_min"), high("computation_time").alias("x_max"), low("communication_time").alias("y_min"), high("communication_time").alias("y_max"), F.count("*").alias("points")
    )


def ratios(results: DataFrame) -> DataFrame:
    """``dataset``, ``implementation``, ``ratio`` of communication to computation, 0 where nothing was computed."""
    return results.select(F.trim("dataset").alias("dataset"), "implementation", guarded_ratio("communication_time", "computation_time").alias("ratio"))


def normalised(rows: DataFrame, column: str, into: str) -> DataFrame:
    """``rows`` with ``column`` scaled to 0..1; 0 where all values are equal."""
    low, high = rows.agg(F.min(column)).scalar(), rows.agg(F.max(column)).scalar()
    scaled: Column = guarded_ratio((F.col(column) - low).cast("double"), (high - low).cast("double"))
    return rows.select("*", scaled.alias(into))


def distance_table(results: DataFrame, implementations: list[str]) -> DataFrame:
    """Mean distance by dataset (rows) and implementation (columns); the maximum where no mean is known, else 0.

    Of several runs in one cell the largest value counts.
    """
    value = F.coalesce(F.col("avg_distance"), F.col("max_distance").cast("double"), F.lit(0.0))
    rows = results.select(F.lower(F.trim("dataset")).alias("dataset"), F.upper(F.trim("implementation")).alias("i"), value.alias("v"))
    pivoted = rows.groupBy("dataset").pivot("i", implementations).agg(F.max("v"))
    return pivoted.select("dataset", *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(i.lower()) for i in implementations])


def speedup(results: DataFrame, base: str = "CPU") -> DataFrame:
    """``dataset``, ``implementation``, ``speedup`` of the traversal against ``base``, ``edges_per_second``."""
    own = results.select(F.trim("dataset").alias("dataset"), "implementation", "traversal_time", "total_edges")
    ref = own.where(F.col("implementation") == base).select("dataset", F.col("traversal_time").alias("base_time"))
    joined = own.join(ref, "dataset")
    return joined.select("dataset", "implementation", guarded_ratio("base_time", "traversal_time").alias("speedup"), guarded_ratio(F.col("total_edges").cast("double"), F.col("traversal_time")).alias("edges_per_second"))


def efficiency(speedups: DataFrame, workers: int) -> DataFrame:
    """``speedups`` with their ``efficiency``: the speed-up of each of ``workers``."""
    return speedups.withColumn("efficiency", F.col("speedup") / F.lit(float(workers)))
