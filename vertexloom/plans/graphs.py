"""Edge frames derived from the order tables, and the micro-graphs of the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.graph import Graph

# The nine-vertex sample graph, as row offsets and column indices.
SAMPLE_OFFSETS = [0, 4, 11, 12, 14, 15, 16, 18, 19, 20]
SAMPLE_NONZEROS = [1, 2, 3, 6, 0, 3, 4, 5, 6, 7, 8, 0, 0, 1, 1, 1, 0, 1, 1, 1]


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer of each order -> customer of the next order key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    here = orders.select((F.col("o_orderkey") + 1).alias("o_orderkey"), F.col("o_custkey").alias("src"))
    return Graph.from_edges(here.join(orders.withColumnRenamed("o_custkey", "dst"), "o_orderkey"))


def timeline(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order -> the same customer's next order: a deep path for every customer, and ids without an edge."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return Graph.from_edges(orders.select(F.col("o_orderkey").alias("src"), nxt.alias("dst")))


def power_law(spark: SparkSession, scale: int, edges: int, seed: int = 1) -> Graph:
    """A graph of 2 ** ``scale`` ids and ``edges`` edges whose degrees follow a power law, the same for the same arguments.

    Each bit of both ends is drawn by a hash with the quadrant odds 0.57, 0.19, 0.19 and 0.05 of the recursive-matrix model, and ids
    are scrambled by an odd factor, so that an id says nothing about its degree.
    """
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for bit in range(scale):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(bit), "id"), F.lit(100))
        src = src * 2 + (draw >= 76).cast("long")
        dst = dst * 2 + (draw.between(57, 75) | (draw >= 95)).cast("long")
    mixed = lambda c: F.pmod(c * F.lit(0x9E3779B1) + F.lit(seed), F.lit(1 << scale))
    return Graph.from_edges(spark.range(edges).select(mixed(src).alias("src"), mixed(dst).alias("dst")))


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Part of each line -> part of the order's next line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return Graph.from_edges(lines.select(F.col("l_partkey").alias("src"), nxt.alias("dst")))


def sample(spark: SparkSession) -> Graph:
    return Graph.from_csr(spark, SAMPLE_OFFSETS, SAMPLE_NONZEROS)


def from_pairs(spark: SparkSession, pairs: list[tuple[int, int]]) -> Graph:
    return Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"))


def example_logs() -> list[tuple[str, str]]:
    """(file, text) of three synthetic run logs, with equal counts on some ranks; the last lacks its average distance."""
    # The wording of the lines.

    def log(ranks: list[tuple[int, int]], lines: list[str]) -> str:
        return "\n".join([f"Rank {r}: Loaded {v} vertices and {e} edges in local partition" for r, (v, e) in enumerate(ranks)] + lines)

    body = [
        "Source vertex: 8",
        "Visited vertices: 990 (99.00% of graph)",
        "Maximum distance from source: 7",
        "Average distance from source: 4.03",
        "Total execution time: 0.72 s",
        "Graph loading/init time: 0.64 s (88.89%)",
        "BFS traversal time: 0.05 s (6.94%)",
        "Communication time: 0.02 s (40.00% of BFS time)",
        "Computation time: 0.03 s (60.00% of BFS time)",
        "Number of BFS levels: 8",
        "Average time per level: 0.00625 s",
    ]
    slower = [x.replace("0.72", "1.5").replace("0.05 s", "0.25 s").replace("0.02 s", "0.05 s").replace("0.03 s", "0.2 s") for x in body]
    return [
        ("g500-scale18_cpu.out", log([(251, 400), (251, 410), (251, 400), (251, 405)], body)),
        ("g500-scale18_gpu.out", log([(251, 400), (251, 410), (251, 400), (251, 405)], slower)),
        ("web-small_gpu_stf.out", log([(90, 700), (90, 650)], [x for x in slower if not x.startswith("Average distance")])),
    ]
