"""All queries of the graph engine; their DuckDB counterparts are in ``oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vertexloom.functions import shown_distance
from vertexloom.operators import bfs as B
from vertexloom.operators import components as C
from vertexloom.operators import degree as D
from vertexloom.operators import exchange as X
from vertexloom.operators import pagerank as P
from vertexloom.operators import reports as T
from vertexloom.operators import results as R
from vertexloom.operators import stencil
from vertexloom.plans import graphs as G
from vertexloom.plans.oracles import oracles
from vertexloom.plans.staging import work_folder
from vertexloom.sources import edges as E
from vertexloom.sources import runlogs as L

SOURCE = 8
Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def _logs(s: SparkSession) -> DataFrame:
    return s.createDataFrame(G.example_logs(), "file string, text string")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Graph basics


@query
def graph_size(s, d):
    g = G.chain(s, d)
    return g.size().select("*", g.vertices().agg(F.count("*")).scalar().alias("num_seen"))


@query
def out_degree_all(s, d):
    return G.chain(s, d).out_degrees()


@query
def in_degree_all(s, d):
    return G.chain(s, d).in_degrees()


@query
def csr_offsets(s, d):
    return G.chain(s, d).row_offsets(range_size=1024)


@query
def adjacency_list(s, d):
    return G.chain(s, d).adjacency_lists().select("src", F.array_join("dsts", ",").alias("dsts"), "out_degree")


@query
def undirected_edges(s, d):
    return G.chain(s, d).adjacency_sets()


@query
def undirected_edge_total(s, d):
    return G.copurchase(s, d).adjacency_sets().agg(F.count("*").alias("total"))


@query
def copurchase_size(s, d):
    return G.copurchase(s, d).size()


@query
def csr_literal(s, d):
    return G.sample(s).edges


# Owners and exchange


@query
def partition_stats(s, d):
    return G.chain(s, d).partition_stats()


@query
def owner_map(s, d):
    return X.owner_map(G.chain(s, d))


@query
def counts_by_owner(s, d):
    return X.counts_by_owner(G.chain(s, d).vertices())


@query
def count_matrix(s, d):
    return X.count_matrix(G.chain(s, d))


@query
def send_offsets(s, d):
    return X.send_offsets(G.chain(s, d))


@query
def send_buffer(s, d):
    return X.send_buffer(G.chain(s, d).vertices(), range_size=64)


@query
def packed_vertices(s, d):
    buffer = X.packed(G.chain(s, d).vertices())
    return buffer.select("owner", "vertex", F.monotonically_increasing_id().alias("at")).withColumn("later", F.lead("vertex").over(Window.partitionBy("owner").orderBy("at"))).select("owner", "vertex", "later")


@query
def local_remote_split(s, d):
    return X.split_local_remote(G.chain(s, d).vertices(), rank=1)


@query
def all_reduce(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    return X.all_reduce(lines.select(F.col("l_linenumber").cast("long").alias("index"), F.col("l_suppkey").alias("value")))


@query
def all_reduce_max(s, d):
    lines = s.read.parquet(f"{d}/lineitem.parquet")
    return X.all_reduce(lines.select(F.col("l_linenumber").cast("long").alias("index"), F.col("l_partkey").alias("value")), "max")


@query
def all_gather(s, d):
    nations = s.read.parquet(f"{d}/nation.parquet")
    parts = nations.select(F.col("n_regionkey").cast("int").alias("rank"), F.col("n_nationkey").cast("long").alias("index"), F.col("n_nationkey").cast("long").alias("value"))
    return X.all_gather(parts).select("rank", F.array_join("values", ",").alias("gathered"))


@query
def axpy(s, d):
    x = s.range(1000).select(F.col("id").alias("index"), F.col("id").cast("double").alias("value"))
    y = s.range(1000).select(F.col("id").alias("index"), (F.col("id") % 7).cast("double").alias("value"))
    return X.axpy(x, y, 3.5)


@query
def sine_wave(s, d):
    return _rounded(E.sine_wave(s, 500), 9, "value")


# Degrees and neighbours


@query
def degrees(s, d):
    return D.degrees(G.chain(s, d))


@query
def top_degrees(s, d):
    return D.top_degrees(G.chain(s, d))


@query
def bottom_degrees(s, d):
    return D.bottom_degrees(G.chain(s, d))


@query
def degree_lookup(s, d):
    return D.degree_of(G.chain(s, d), SOURCE)


@query
def neighbors_of(s, d):
    return D.neighbors(G.chain(s, d), SOURCE)


@query
def neighbors_by_owner(s, d):
    return D.neighbors_by_owner(G.chain(s, d), SOURCE)


# BFS


@query
def bfs_hops(s, d):
    return B.distances(B.bfs(G.chain(s, d), SOURCE)).select("vertex", "hop")


@query
def bfs_ref_distance(s, d):
    return B.distances(B.bfs(G.chain(s, d), SOURCE)).select("vertex", "ref_distance")


@query
def bfs_unreached(s, d):
    return B.distances(B.bfs(G.timeline(s, d), SOURCE), include_unreached=True)


@query
def bfs_levels(s, d):
    return _rounded(B.level_histogram(B.bfs(G.chain(s, d), SOURCE).hops), 6, "percent")


@query
def bfs_ref_levels(s, d):
    shown = B.distances(B.bfs(G.timeline(s, d), SOURCE))
    return _rounded(B.level_histogram(shown, "ref_distance"), 6, "percent")


@query
def bfs_summary(s, d):
    return _rounded(B.summary(B.bfs(G.chain(s, d), SOURCE)), 6, "visited_percent", "avg_distance")


@query
def bfs_deep(s, d):
    return B.distances(B.bfs(G.timeline(s, d), SOURCE)).select("vertex", "hop")


@query
def bfs_fallback_source(s, d):
    return B.summary(B.bfs(G.chain(s, d), 10**12)).select("source", "visited")


@query
def bfs_frontier_step(s, d):
    g = G.chain(s, d)
    first = s.createDataFrame([(SOURCE,)], "vertex long")
    second = B.unseen(B.expand(first, g.edges, small=True), first, few_visited=True)
    return B.unseen(B.expand(second, g.edges, small=False), first.union(second))


@query
def bfs_undirected(s, d):
    return B.distances(B.bfs(G.timeline(s, d).undirected(), SOURCE)).select("vertex", "hop")


@query
def bfs_max_hops(s, d):
    return B.distances(B.bfs(G.chain(s, d), SOURCE, max_hops=2)).select("vertex", "hop")


@query
def bfs_copurchase(s, d):
    return _rounded(B.level_histogram(B.bfs(G.copurchase(s, d), SOURCE).hops), 6, "percent")


@query
def bfs_levels_distributed(s, d):
    return _rounded(B.level_histogram(B.bfs(G.chain(s, d), SOURCE, small_edges=0).hops), 6, "percent")


@query
def bfs_deep_distributed(s, d):
    return B.distances(B.bfs(G.timeline(s, d), SOURCE, small_edges=0)).select("vertex", "hop")


@query
def bfs_hops_distributed(s, d):
    return B.distances(B.bfs(G.chain(s, d), SOURCE, small_edges=0)).select("vertex", "hop")


@query
def bfs_unreached_distributed(s, d):
    return B.distances(B.bfs(G.timeline(s, d), SOURCE, small_edges=0), include_unreached=True)


@query
def bfs_summary_distributed(s, d):
    return _rounded(B.summary(B.bfs(G.chain(s, d), SOURCE, small_edges=0, broadcast_rows=0)), 6, "visited_percent", "avg_distance")


@query
def bfs_sample_graph(s, d):
    return B.distances(B.bfs(G.sample(s), 0))


# PageRank


def _ranks(s, d, n, **kw):
    return P.pagerank(G.chain(s, d), tol=None, max_iter=n, **kw)


@query
def pagerank_10(s, d):
    return _rounded(_ranks(s, d, 10).ranks, 12, "rank")


@query
def pagerank_20(s, d):
    return _rounded(_ranks(s, d, 20).ranks, 12, "rank")


@query
def pagerank_10_distributed(s, d):
    return _rounded(P.pagerank(G.chain(s, d), tol=None, max_iter=10, small_edges=0).ranks, 12, "rank")


@query
def pagerank_pull(s, d):
    return _rounded(_ranks(s, d, 10, form="pull").ranks, 12, "rank")


@query
def pagerank_pull_distributed(s, d):
    return _rounded(_ranks(s, d, 10, form="pull", small_edges=0).ranks, 12, "rank")


@query
def pagerank_converged_distributed(s, d):
    return _rounded(P.pagerank(G.chain(s, d), small_edges=0).ranks, 12, "rank")


@query
def pagerank_top10(s, d):
    return P.top_k(_ranks(s, d, 10).ranks, digits=12)


@query
def pagerank_l1_history(s, d):
    g = G.chain(s, d)
    return _rounded(P.history(g, P.pagerank(g, tol=None, max_iter=10).differences), 12, "l1_diff")


@query
def pagerank_mass(s, d):
    return _rounded(P.mass(_ranks(s, d, 10).ranks), 12, "mass")


@query
def pagerank_converged(s, d):
    return _rounded(P.pagerank(G.chain(s, d)).ranks, 12, "rank")


@query
def pagerank_sample_linf(s, d):
    return _rounded(P.pagerank(G.sample(s), tol=1e-6, norm="linf").ranks, 12, "rank")


# Components


@query
def components(s, d):
    return C.connected_components(G.chain(s, d))


@query
def components_distributed(s, d):
    return C.connected_components(G.chain(s, d), small_edges=0)


@query
def component_sizes_distributed(s, d):
    return _rounded(C.largest_components(C.connected_components(G.timeline(s, d), small_edges=0)), 6, "percent")


@query
def component_sizes_top20(s, d):
    return _rounded(C.largest_components(C.connected_components(G.timeline(s, d))), 6, "percent")


@query
def component_buckets(s, d):
    return _rounded(C.size_buckets(C.connected_components(G.timeline(s, d))), 6, "percent")


@query
def component_counts(s, d):
    g = G.timeline(s, d)
    return C.counts(g, C.connected_components(g))


# Benchmark logs and results


@query
def log_partitions(s, d):
    return L.partition_lines(_logs(s))


@query
def log_partition_totals(s, d):
    return L.partition_totals(_logs(s))


@query
def log_records(s, d):
    return L.run_records(_logs(s)).drop("slots_total", "edges_total")


@query
def log_union(s, d):
    logs = _logs(s)
    return L.combine(L.run_records(logs).select("dataset", "max_distance"), L.partition_totals(logs).select("file", "edges_total"))


@query
def result_datasets(s, d):
    return R.distinct_values(L.run_records(_logs(s)), "dataset")


@query
def result_series(s, d):
    return R.scaling_series(L.run_records(_logs(s)), "total_edges", "traversal_time")


@query
def result_comparison(s, d):
    return R.comparison(L.run_records(_logs(s)))


@query
def result_axis_limit(s, d):
    return _rounded(R.axis_limit(L.run_records(_logs(s))), 9, "axis_limit")


@query
def result_cluster_bounds(s, d):
    return _rounded(R.cluster_bounds(L.run_records(_logs(s))), 9, "x_min", "x_max", "y_min", "y_max")


@query
def result_ratios(s, d):
    return _rounded(R.ratios(L.run_records(_logs(s))), 9, "ratio")


@query
def result_normalised(s, d):
    rows = L.run_records(_logs(s)).select("dataset", "implementation", "total_edges")
    return _rounded(R.normalised(rows, "total_edges", "scaled"), 9, "scaled")


@query
def result_distance_table(s, d):
    return R.distance_table(L.run_records(_logs(s)), ["CPU", "GPU", "GPU_STF"])


@query
def result_speedup(s, d):
    return _rounded(R.speedup(L.run_records(_logs(s))), 6, "speedup", "edges_per_second")


@query
def shown_distances(s, d):
    return s.range(-1, 50).select(F.col("id").alias("hop"), shown_distance("id").alias("ref_distance"))


@query
def result_series_vertices(s, d):
    return R.scaling_series(L.run_records(_logs(s)), "total_vertices", "traversal_time")


@query
def result_series_level_edges(s, d):
    return R.scaling_series(L.run_records(_logs(s)), "total_edges", "avg_time_per_level")


@query
def result_series_level_vertices(s, d):
    return R.scaling_series(L.run_records(_logs(s)), "total_vertices", "avg_time_per_level")


@query
def result_efficiency(s, d):
    return _rounded(R.efficiency(R.speedup(L.run_records(_logs(s))), workers=4), 6, "speedup", "efficiency").select("dataset", "implementation", "speedup", "efficiency")


# Files: written to the shared folder and read back


def _folder(s, name):
    return f"{work_folder(s)}/{name}-{uuid.uuid4().hex}"


@query
def read_edge_list(s, d):
    path = _folder(s, "edge-list")
    E.write_edge_list(G.chain(s, d), path)
    return E.read_edge_list(s, path, strict=True).edges


@query
def read_token_stream(s, d):
    path = _folder(s, "tokens")
    G.chain(s, d).edges.select(F.concat("src", F.lit("\n"), "dst").alias("value")).write.text(path)
    return E.read_token_stream(s, path).edges


@query
def read_matrix_market(s, d):
    path = _folder(s, "matrix")
    E.write_matrix_market(G.chain(s, d), path)
    return E.read_matrix_market(s, path, strict=True)[0].edges


@query
def read_matrix_header(s, d):
    path = _folder(s, "matrix")
    E.write_matrix_market(G.chain(s, d), path)
    header = E.read_header(s, path)
    return s.createDataFrame([(header.rows, header.columns, header.entries)], "rows long, columns long, entries long")


@query
def read_bad_lines(s, d):
    path = _folder(s, "edge-list")
    marked = F.when(F.col("dst") % 50 == 0, F.concat(F.lit("x "), F.col("src").cast("string"))).otherwise(F.concat_ws(" ", "src", "dst"))
    G.chain(s, d).edges.select(marked.alias("value")).write.text(path)
    return E.bad_lines(s, path).groupBy("line").agg(F.count("*").alias("times"))


@query
def read_logs(s, d):
    path = _folder(s, "logs")
    L.write_logs(s, path, G.example_logs())
    return L.read_logs(s, path)


@query
def read_results(s, d):
    path = _folder(s, "results")
    L.write_results(L.run_records(_logs(s)).drop("file", "slots_total", "edges_total"), path)
    return L.read_results(s, path)


# Reports, line by line


def _text(s, text):
    return s.createDataFrame(list(enumerate(text.split("\n"))), "line_number int, line string")


@query
def report_statistics(s, d):
    return _text(s, T.statistics(B.bfs(G.chain(s, d), SOURCE)))


@query
def report_levels(s, d):
    return _text(s, T.levels(B.bfs(G.chain(s, d), SOURCE)))


@query
def report_performance(s, d):
    return _text(s, T.performance(T.PerfRecord(total=2.5, loading=2.0, traversal=0.5, levels=4, communication=0.125)))


@query
def report_partitions(s, d):
    return _text(s, T.partitions(G.chain(s, d).partition_stats()))


@query
def report_pagerank(s, d):
    return _text(s, T.pagerank(_ranks(s, d, 10), 0.0))


@query
def report_degrees(s, d):
    return _text(s, T.degrees(G.chain(s, d)))


@query
def report_components(s, d):
    g = G.timeline(s, d)
    return _text(s, T.components(g, C.connected_components(g)))


@query
def report_neighbors(s, d):
    return _text(s, T.neighbor_list(G.chain(s, d), SOURCE))


# Stencil


@query
def row_blocks(s, d):
    return stencil.row_blocks(s, 103, 8)


@query
def relaxation(s, d):
    return _rounded(stencil.relax(stencil.boundary_grid(s, 16, 12), 16, 12, steps=3).cells, 9, "value")


def queries() -> dict[str, Query]:
    return dict(_FOUND)


__all__ = ["oracles", "queries"]
