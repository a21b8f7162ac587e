"""A benchmark suite: searches of every graph file by each implementation, with the reports as logs and as a table."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from vertexloom.operators import bfs as search_ops
from vertexloom.operators import reports
from vertexloom.plans.staging import work_folder
from vertexloom.sources.edges import read_graph
from vertexloom.sources.runlogs import read_logs, run_records, write_logs

#: Suffix of the log: the edges up to which one task searches the graph (None: the engine's own limit).
IMPLEMENTATIONS = {"task": None, "rounds": 0}


def exchange_seconds(spark: SparkSession, since: float) -> float:
    """Mean seconds per core that tasks of stages submitted after ``since`` (epoch seconds) spent on writing and fetching shuffle data."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    spent = 0.0
    for i in range(stages.size()):
        s = stages.apply(i)
        if s.submissionTime().isDefined() and s.submissionTime().get().getTime() >= 1000 * since:
            spent += s.shuffleWriteTime() / 1e9 + s.shuffleFetchWaitTime() / 1e3
    return spent / max(1, spark.sparkContext.defaultParallelism)


def run_one(spark: SparkSession, path: str, source: int = 8, small_edges: int | None = None) -> str:
    """Load a graph, search it, and return the log text of the run."""
    began = time.perf_counter()
    graph = read_graph(spark, path).staged()
    stats = reports.partitions(graph.partition_stats())
    loaded, at = time.perf_counter(), time.time()
    search = search_ops.bfs(graph, source, small_edges=small_edges)
    levels = len(search.level_sizes)
    ended = time.perf_counter()
    exchanged = min(exchange_seconds(spark, at), ended - loaded)
    perf = reports.PerfRecord(ended - began, loaded - began, ended - loaded, levels, exchanged, search.level_seconds)
    return "\n".join([stats, reports.statistics(search), reports.levels(search), reports.performance(perf)])


def run_suite(spark: SparkSession, paths: list[str], source: int = 8, implementations: dict[str, int | None] | None = None, folder: str | None = None) -> DataFrame:
    """One record per graph and implementation, scraped from the logs that the runs wrote below ``folder``."""
    folder = folder or f"{work_folder(spark)}/suite-{uuid.uuid4().hex}"
    for path in paths:
        name = os.path.basename(path.rstrip("/"))
        for suffix, small_edges in (implementations or IMPLEMENTATIONS).items():
            write_logs(spark, folder, [(f"{name}_{suffix}.out", run_one(spark, path, source, small_edges))])
    return run_records(read_logs(spark, folder))
