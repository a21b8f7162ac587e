"""The graph: an edge DataFrame and what follows from it directly."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.functions import OWNERS, owner
from vertexloom.plans.staging import stage

#: Ids are 0 or more, and their number fits 64 bits too.
MAX_ID = 2**63 - 2
#: Vertices up to which results may have a row for every id, seen or not.
DENSE_LIMIT = 1 << 36


class Graph:
    """Directed edges ``src``, ``dst`` (bigint); multi-edges and self-loops are kept.

    The number of vertices is the largest id plus one, so ids that never occur count as vertices.
    """

    def __init__(self, edges: DataFrame, num_vertices: int | None = None) -> None:
        self.edges = edges
        if num_vertices is not None:
            self.__dict__["num_vertices"] = num_vertices

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst", validate: bool = False) -> Graph:
        """From any two integer columns; rows with a null end are no edges."""
        edges = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src is not null and dst is not null")
        if validate:
            bad = edges.where(~(F.col("src").between(0, MAX_ID) & F.col("dst").between(0, MAX_ID)))
            if not bad.isEmpty():
                raise ValueError(f"vertex ids must be in 0..{MAX_ID}: {bad.first()}")
        return cls(edges)

    @classmethod
    def from_csr(cls, spark: SparkSession, offsets: list[int], nonzeros: list[int]) -> Graph:
        """From row offsets and column indices; the rows are expanded by Spark."""
        rows = spark.createDataFrame([(v, a, b) for v, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False))], "src long, a int, b int")
        targets = F.slice(F.array(*map(F.lit, nonzeros)), F.col("a") + 1, F.col("b") - F.col("a"))
        return cls(rows.where("b > a").select("src", F.explode(targets.cast("array<long>")).alias("dst")), len(offsets) - 1)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def num_vertices(self) -> int:
        return self._counted()["num_vertices"]

    @cached_property
    def num_edges(self) -> int:
        return self._counted()["num_edges"]

    def _counted(self) -> dict:
        """Both counts from one scan; what is known already stays."""
        found = self.size().first().asDict()
        for name, n in found.items():
            self.__dict__.setdefault(name, n)
        return self.__dict__

    def staged(self) -> Graph:
        """The same graph over a written edge table, for algorithms that scan it many times."""
        return Graph(stage(self.edges, "edges"), self.__dict__.get("num_vertices"))

    def size(self) -> DataFrame:
        """One row: ``num_vertices``, ``num_edges``."""
        return self.edges.agg(
            F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("num_vertices"),
            F.count("*").alias("num_edges"),
        )

    def ids(self) -> DataFrame:
        """Every id from 0 to N-1 as ``vertex``; refuses absurd sizes."""
        if self.num_vertices > DENSE_LIMIT:
            raise ValueError(f"{self.num_vertices} ids: use the vertices that occur instead")
        return self.spark.range(self.num_vertices).select(F.col("id").alias("vertex"))

    def vertices(self) -> DataFrame:
        """Ids that occur in an edge."""
        return self.edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()

    def reversed(self) -> Graph:
        return Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.__dict__.get("num_vertices"))

    def undirected(self) -> Graph:
        """Each edge in both directions, multi-edges kept."""
        return Graph(self.edges.union(self.reversed().edges), self.__dict__.get("num_vertices"))

    def adjacency_sets(self) -> DataFrame:
        """Each neighbour once in each direction: ``src``, ``dst``."""
        return self.undirected().edges.distinct()

    def out_degrees(self, all_ids: bool = True) -> DataFrame:
        """``vertex``, ``degree``; with a zero row for ids without an edge if ``all_ids``."""
        counted = self.edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("degree"))
        return self.ids().join(counted, "vertex", "left").fillna(0, ["degree"]) if all_ids else counted

    def in_degrees(self, all_ids: bool = True) -> DataFrame:
        return self.reversed().out_degrees(all_ids)

    def row_offsets(self, range_size: int = 1 << 20) -> DataFrame:
        """``vertex``, ``offset``: exclusive prefix sum of the out-degrees.

        Two levels: sums of id ranges are added up first, then each range on its own, so no task
        gets all ids.
        """
        counted = self.out_degrees().withColumn("range", F.floor(F.col("vertex") / range_size))
        upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
        sums = counted.groupBy("range").agg(F.sum("degree").alias("n"))
        starts = sums.select("range", F.coalesce(F.sum("n").over(upto(Window.orderBy("range"))), F.lit(0)).alias("start"))
        inside = F.coalesce(F.sum("degree").over(upto(Window.partitionBy("range").orderBy("vertex"))), F.lit(0))
        return counted.join(starts, "range").select("vertex", (F.col("start") + inside).alias("offset"))

    def adjacency_lists(self) -> DataFrame:
        """``src``, ``dsts`` (sorted) and ``out_degree`` of every vertex with an out-edge."""
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts")).withColumn("out_degree", F.size("dsts").cast("long"))

    def partition_stats(self, owners: int = OWNERS) -> DataFrame:
        """``owner``, ``slots`` (N / owners + 1 each) and the ``edges`` it holds by their source."""
        counted = self.edges.groupBy(owner("src", owners).alias("owner")).agg(F.count("*").alias("edges"))
        all_owners = self.spark.range(owners).select(F.col("id").cast("int").alias("owner"))
        return all_owners.join(counted, "owner", "left").fillna(0, ["edges"]).select("owner", F.lit(self.num_vertices // owners + 1).cast("long").alias("slots"), "edges")

    def partitioned(self, owners: int | None = None) -> Graph:
        """Edges hash-partitioned by source, as a join on ``src`` wants them."""
        return Graph(self.edges.repartition(owners, "src") if owners else self.edges.repartition("src"), self.__dict__.get("num_vertices"))
