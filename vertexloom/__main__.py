"""Command line: ``python -m vertexloom COMMAND FILE ...`` prints the reports of one run.

Settings of the session come from Spark's own configuration (``spark-submit`` or ``SPARK_CONF_DIR``).
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from vertexloom import session
from vertexloom.operators import components as C
from vertexloom.operators import pagerank as P
from vertexloom.operators import reports
from vertexloom.plans import suite
from vertexloom.sources.edges import read_graph
from vertexloom.sources.runlogs import write_results


def _bfs(spark: SparkSession, a: argparse.Namespace) -> str:
    return suite.run_one(spark, a.file, a.source, a.small_edges)


def _pagerank(spark: SparkSession, a: argparse.Namespace) -> str:
    graph, began = read_graph(spark, a.file).staged(), time.perf_counter()
    ranking = P.pagerank(graph, a.damping, a.tolerance, a.iterations, small_edges=a.small_edges, form=a.form)
    return reports.pagerank(ranking, time.perf_counter() - began, a.top)


def _components(spark: SparkSession, a: argparse.Namespace) -> str:
    graph = read_graph(spark, a.file).staged()
    return reports.components(graph, C.connected_components(graph, a.small_edges), a.top)


def _degrees(spark: SparkSession, a: argparse.Namespace) -> str:
    return reports.degrees(read_graph(spark, a.file).staged(), a.top)


def _neighbors(spark: SparkSession, a: argparse.Namespace) -> str:
    return reports.neighbor_list(read_graph(spark, a.file).staged(), a.vertex, a.owners)


def _suite(spark: SparkSession, a: argparse.Namespace) -> str:
    records = suite.run_suite(spark, a.files, a.source, folder=a.logs)
    write_results(records.drop("file", "slots_total", "edges_total"), a.results)
    return f"{records.count()} runs in {a.results}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="vertexloom", description="Graph analytics over edge lists, MatrixMarket files and Parquet.")
    commands = top.add_subparsers(required=True, metavar="COMMAND")

    def command(name: str, run: Callable[[SparkSession, argparse.Namespace], str], about: str, many: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=about)
        sub.set_defaults(run=run)
        sub.add_argument("files" if many else "file", nargs="+" if many else None)
        return sub

    def sized(sub: argparse.ArgumentParser) -> argparse.ArgumentParser:
        sub.add_argument("--small-edges", type=int, help="edges up to which one task does the work (0: never)")
        return sub

    bfs = sized(command("bfs", _bfs, "distances from one vertex, with the performance report"))
    bfs.add_argument("--source", default=None, help="the vertex to start from; none: a random one")
    rank = sized(command("pagerank", _pagerank, "the highest ranks"))
    rank.add_argument("--damping", type=float, default=0.85)
    rank.add_argument("--tolerance", type=float, default=1e-5)
    rank.add_argument("--iterations", type=int, default=100)
    rank.add_argument("--form", choices=("push", "pull"), default="push")
    rank.add_argument("--top", type=int, default=10)
    sized(command("components", _components, "sizes of the connected components")).add_argument("--top", type=int, default=20)
    command("degrees", _degrees, "highest and lowest degrees").add_argument("--top", type=int, default=10)
    near = command("neighbors", _neighbors, "neighbours of one vertex by owner")
    near.add_argument("vertex", type=int)
    near.add_argument("--owners", type=int, default=4)
    runs = command("suite", _suite, "a search of every file by each implementation, as logs and a results CSV", many=True)
    runs.add_argument("--source", type=int, default=8)
    runs.add_argument("--logs", default=None, help="folder of the logs")
    runs.add_argument("--results", default="results", help="folder of the CSV")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    chosen = parser().parse_args(arguments)
    print(chosen.run(spark or session(), chosen))


if __name__ == "__main__":
    main()
