"""Run logs of graph benchmarks: text in, one typed row per run out, CSV in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions import implementation_label

# The wording of the report lines in the logs, and the column names of the results CSV.
NUMBER = r"([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
LOADED = r"Rank ([0-9]+): Loaded ([0-9]+) vertices and ([0-9]+) edges"
#: Report line, group that holds the value, column, type.
FIELDS = (
    ("Source vertex: ([0-9]+)", 1, "source_vertex", "bigint"),
    (r"Visited vertices: ([0-9]+) \(" + NUMBER + "%", 1, "visited_vertices", "bigint"),
    (r"Visited vertices: ([0-9]+) \(" + NUMBER + "%", 2, "visited_percentage", "double"),
    ("Maximum distance from source: ([0-9]+)", 1, "max_distance", "int"),
    ("Average distance from source: " + NUMBER, 1, "avg_distance", "double"),
    ("Total execution time: " + NUMBER, 1, "total_time", "double"),
    (r"Graph loading/init time: " + NUMBER + r" s \(" + NUMBER + "%", 1, "loading_time", "double"),
    (r"Graph loading/init time: " + NUMBER + r" s \(" + NUMBER + "%", 2, "loading_percentage", "double"),
    (r"BFS traversal time: " + NUMBER + r" s \(" + NUMBER + "%", 1, "traversal_time", "double"),
    (r"BFS traversal time: " + NUMBER + r" s \(" + NUMBER + "%", 2, "traversal_percentage", "double"),
    (r"Communication time: " + NUMBER + r" s \(" + NUMBER + "%", 1, "communication_time", "double"),
    (r"Communication time: " + NUMBER + r" s \(" + NUMBER + "%", 2, "communication_percentage", "double"),
    (r"Computation time: " + NUMBER + r" s \(" + NUMBER + "%", 1, "computation_time", "double"),
    (r"Computation time: " + NUMBER + r" s \(" + NUMBER + "%", 2, "computation_percentage", "double"),
    ("Number of BFS levels: ([0-9]+)", 1, "bfs_levels", "int"),
    ("Average time per level: " + NUMBER, 1, "avg_time_per_level", "double"),
)
RESULTS_SCHEMA = ", ".join(
    sorted([f"{name} {kind}" for _, _, name, kind in FIELDS] + ["dataset string", "implementation string", "total_vertices bigint", "total_edges bigint"])
)


def write_logs(spark: SparkSession, folder: str, logs: list[tuple[str, str]]) -> None:
    """Write each (file, text) below ``folder``, wherever Spark can write."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file, text in logs:
        target = jvm.org.apache.hadoop.fs.Path(folder, file)
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (base name) and ``text`` of each ``.out`` file below a folder."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.out")
    return whole.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.col("value").alias("text"))


def dataset_name(file: Column) -> Column:
    """The file name up to its implementation suffix, or all of it."""
    # The file suffixes; the last two are those of this engine's own suite.
    name = F.regexp_extract(file, r"^(.+?)_(?:cpu|gpu|gpu_stf|task|rounds)\.out", 1)
    return F.coalesce(F.nullif(name, F.lit("")), file)


def partition_lines(logs: DataFrame) -> DataFrame:
    """``file``, ``rank``, ``vertices``, ``edges`` of every line that a rank wrote when it had loaded."""
    lines = logs.select("file", F.explode(F.regexp_extract_all("text", F.lit(LOADED), F.lit(0))).alias("line"))
    part = lambda i: F.regexp_extract("line", LOADED, i).cast("long")
    return lines.select("file", part(1).alias("rank"), part(2).alias("vertices"), part(3).alias("edges"))


def partition_totals(logs: DataFrame) -> DataFrame:
    """``total_vertices`` as published (equal values count once), ``total_edges`` of all ranks, and the true ``slots_total``, ``edges_total``."""
    return partition_lines(logs).groupBy("file").agg(
        F.sum_distinct("vertices").alias("total_vertices"),
        F.sum("edges").alias("total_edges"),
        F.sum("vertices").alias("slots_total"),
        F.sum("edges").alias("edges_total"),
    )


def run_records(logs: DataFrame) -> DataFrame:
    """One row per log: dataset, implementation, all report fields (null where a line is missing), partition totals."""
    values = [F.nullif(F.regexp_extract("text", pattern, group), F.lit("")).cast(kind).alias(name) for pattern, group, name, kind in FIELDS]
    rows = logs.select("file", dataset_name(F.col("file")).alias("dataset"), implementation_label("file").alias("implementation"), *values)
    return rows.join(partition_totals(logs), "file", "left")


def unparsed(records: DataFrame) -> DataFrame:
    """Files without a single report field."""
    return records.where(F.coalesce(*[F.col(name).cast("string") for _, _, name, _ in FIELDS]).isNull()).select("file")


def combine(*parts: DataFrame) -> DataFrame:
    """Rows of all parts; columns that one lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def write_results(records: DataFrame, path: str) -> None:
    """One CSV file with the columns in alphabetical order; a report of a few rows, so one task writes it."""
    records.select(sorted(records.columns)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV by its header's names, dataset names trimmed."""
    kinds = {name: kind for _, _, name, kind in FIELDS} | {"dataset": "string", "implementation": "string", "total_vertices": "bigint", "total_edges": "bigint"}
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.trim(c).try_cast(kinds.get(c, "string")).alias(c) for c in rows.columns])
