"""What an exchange between owners looks like as data: counts, offsets, packing, reductions.

Spark's shuffle does the exchange itself; these are the same quantities as queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.functions import OWNERS, global_id, local_id, owner
from vertexloom.graph import Graph


def owner_map(graph: Graph, owners: int = OWNERS) -> DataFrame:
    """``vertex``, ``owner``, ``local_id``, and the ``global_id`` made of these two again."""
    mapped = graph.ids().select("vertex", owner("vertex", owners).alias("owner"), local_id("vertex", owners).alias("local_id"))
    return mapped.withColumn("global_id", global_id("local_id", "owner", owners))


def counts_by_owner(vertices: DataFrame, owners: int = OWNERS) -> DataFrame:
    """``owner``, ``count`` of a set of vertices; zero rows kept."""
    counted = vertices.groupBy(owner("vertex", owners).alias("owner")).agg(F.count("*").alias("count"))
    every = vertices.sparkSession.range(owners).select(F.col("id").cast("int").alias("owner"))
    return every.join(counted, "owner", "left").fillna(0, ["count"])


def count_matrix(graph: Graph, owners: int = OWNERS) -> DataFrame:
    """``from_owner`` and one column ``to_r`` per owner: edges between the owners of their ends."""
    pairs = graph.edges.select(owner("src", owners).alias("from_owner"), owner("dst", owners).alias("to"))
    pivoted = pairs.groupBy("from_owner").pivot("to", list(range(owners))).count()
    return pivoted.select("from_owner", *[F.coalesce(F.col(str(r)), F.lit(0)).cast("long").alias(f"to_{r}") for r in range(owners)])


def send_offsets(graph: Graph, owners: int = OWNERS) -> DataFrame:
    """``from_owner``, ``to_owner``, ``count``, ``offset``: counts and their exclusive prefix sums."""
    pairs = graph.edges.groupBy(owner("src", owners).alias("from_owner"), owner("dst", owners).alias("to_owner")).agg(F.count("*").alias("count"))
    before = F.sum("count").over(Window.partitionBy("from_owner").orderBy("to_owner").rowsBetween(Window.unboundedPreceding, -1))
    return pairs.select("from_owner", "to_owner", "count", F.coalesce(before, F.lit(0)).alias("offset"))


def packed(vertices: DataFrame, owners: int = OWNERS) -> DataFrame:
    """Vertices in the order of the send buffers: sorted by owner, then id, over as many partitions as it takes."""
    return vertices.select(owner("vertex", owners).alias("owner"), "vertex").repartitionByRange("owner", "vertex").sortWithinPartitions("owner", "vertex")


def send_buffer(vertices: DataFrame, owners: int = OWNERS, range_size: int = 1 << 20) -> DataFrame:
    """``owner``, ``vertex``, ``place``: each vertex's place, from 0, in the buffer for its owner, by ascending id.

    Two levels: counts of id ranges are added up first, then each range on its own, so no task gets all of an owner.
    """
    held = vertices.select(owner("vertex", owners).alias("owner"), "vertex", F.floor(F.col("vertex") / range_size).alias("range"))
    counted = held.groupBy("owner", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("owner").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counted.select("owner", "range", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("owner", "range").orderBy("vertex")) - 1
    return held.withColumn("inside", inside).join(starts, ["owner", "range"]).select("owner", "vertex", (F.col("start") + F.col("inside")).alias("place"))


def split_local_remote(vertices: DataFrame, rank: int, owners: int = OWNERS) -> DataFrame:
    """``vertex`` and whether it is ``local`` to a rank."""
    return vertices.select("vertex", (owner("vertex", owners) == rank).alias("local"))


def all_reduce(parts: DataFrame, how: str = "sum") -> DataFrame:
    """Element-wise reduction of vectors given as rows (``index``, ``value``)."""
    reduce = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    return parts.groupBy("index").agg(reduce("value").alias("value"))


def all_gather(parts: DataFrame) -> DataFrame:
    """``rank``, ``values``: every rank gets the values (``rank``, ``index``, ``value``) of all, in order of rank and index.

    A vector of some thousand entries, as a scalar subquery: it is held whole by definition.
    """
    whole = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "index", "value"))), lambda x: x["value"]).alias("values"))
    return parts.select("rank").distinct().select("rank", whole.scalar().alias("values"))


def axpy(x: DataFrame, y: DataFrame, a: float) -> DataFrame:
    """``index``, ``value`` = y + a * x, joined by index."""
    joined = x.select("index", F.col("value").alias("x")).join(y.select("index", F.col("value").alias("y")), "index")
    return joined.select("index", (F.col("y") + F.lit(a) * F.col("x")).alias("value"))
