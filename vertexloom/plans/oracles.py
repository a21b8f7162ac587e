"""DuckDB SQL with the same results as the catalogue's queries."""

from __future__ import annotations

from vertexloom.plans.graphs import SAMPLE_NONZEROS, SAMPLE_OFFSETS, example_logs
from vertexloom.sources.runlogs import FIELDS

S = 8


_CHAIN = "e AS (SELECT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)"
_TIMELINE = "e AS MATERIALIZED (SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL)"
_N = "n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e)"
_IDS = "ids AS (SELECT unnest(range(0, (SELECT n FROM n))) AS vertex)"
_BOTH = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_COPURCHASE = """e AS (SELECT * FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
_SAMPLE = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({v}::BIGINT, {x}::BIGINT)" for v, (a, b) in enumerate(zip(SAMPLE_OFFSETS, SAMPLE_OFFSETS[1:], strict=False)) for x in SAMPLE_NONZEROS[a:b]) + ") t(src, dst))"
_SHOWN = "CASE WHEN hop > 0 THEN hop + 1 ELSE hop END::INTEGER"


def _bfs(edges: str, source: str, bound: int, table: str = "e") -> str:
    """CTEs up to ``h`` (vertex, hop)."""
    return f"""WITH RECURSIVE {edges},
r(vertex, hop) AS (SELECT ({source})::BIGINT, 0 UNION SELECT {table}.dst, r.hop + 1 FROM r JOIN {table} ON {table}.src = r.vertex WHERE r.hop < {bound}),
h AS (SELECT vertex, min(hop)::INTEGER AS hop FROM r GROUP BY vertex)"""


def _histogram(rows: str) -> str:
    return f"""c AS (SELECT level, count(*) AS n FROM ({rows}) GROUP BY level),
a AS (SELECT unnest(range(0, (SELECT max(level) + 1 FROM c)))::INTEGER AS level)
SELECT level, coalesce(n, 0)::BIGINT AS count, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM c), 6)::DOUBLE AS percent FROM a LEFT JOIN c USING (level)"""


def _pagerank(edges: str, steps: int, giver: str = "src", getter: str = "dst") -> str:
    """CTEs p0 to p{steps} (vertex, rank)."""
    parts = [f"WITH {edges}", _N, _IDS, "od AS (SELECT src, count(*) AS deg FROM e GROUP BY src)", "p0 AS (SELECT vertex, 1.0::DOUBLE / (SELECT n FROM n) AS rank FROM ids)"]
    for k in range(1, steps + 1):
        parts.append(
            f"""p{k} AS MATERIALIZED (SELECT ids.vertex, coalesce(g.got, 0) + (1 - 0.85::DOUBLE) / (SELECT n FROM n) AS rank FROM ids LEFT JOIN
(SELECT e.{getter} AS vertex, sum(0.85::DOUBLE * p.rank / od.deg) AS got FROM e JOIN p{k - 1} p ON p.vertex = e.{giver} JOIN od ON od.src = e.{giver} GROUP BY e.{getter}) g ON g.vertex = ids.vertex)"""
        )
    return ",\n".join(parts)


def _components(edges: str) -> str:
    return f"""WITH RECURSIVE {edges}, {_BOTH},
l(vertex, label) AS (SELECT DISTINCT src, src FROM u UNION SELECT u.dst, l.label FROM l JOIN u ON u.src = l.vertex WHERE l.label < u.dst),
c AS (SELECT vertex, min(label) AS component FROM l GROUP BY vertex),
z AS (SELECT component, count(*) AS size FROM c GROUP BY component)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LOGS = "g(file, text) AS (VALUES " + ", ".join(f"({_quoted(f)}, {_quoted(t)})" for f, t in example_logs()) + ")"
_PARTS = """pl AS (SELECT file, unnest(regexp_extract_all(text, 'Rank [0-9]+: Loaded [0-9]+ vertices and [0-9]+ edges')) AS line FROM g),
p AS (SELECT file, regexp_extract(line, 'Rank ([0-9]+)', 1)::BIGINT AS rank, regexp_extract(line, 'Loaded ([0-9]+)', 1)::BIGINT AS vertices, regexp_extract(line, 'and ([0-9]+)', 1)::BIGINT AS edges FROM pl),
t AS (SELECT file, sum(DISTINCT vertices)::BIGINT AS total_vertices, sum(edges)::BIGINT AS total_edges, sum(vertices)::BIGINT AS slots_total, sum(edges)::BIGINT AS edges_total FROM p GROUP BY file)"""
_DATASET = "coalesce(nullif(regexp_extract(file, '^(.+?)_(?:cpu|gpu|gpu_stf)\\.out', 1), ''), file)"
_IMPLEMENTATION = "CASE WHEN ends_with(file, '_gpu_stf.out') THEN 'GPU_STF' WHEN ends_with(file, '_gpu.out') THEN 'GPU' WHEN ends_with(file, '_cpu.out') THEN 'CPU' END"
_VALUES = ", ".join(f"nullif(regexp_extract(text, {_quoted(pattern)}, {group}), '')::{kind} AS {name}" for pattern, group, name, kind in FIELDS)
_RECORDS = f"WITH {_LOGS}, {_PARTS}, x AS (SELECT file, {_DATASET} AS dataset, {_IMPLEMENTATION} AS implementation, {_VALUES}, total_vertices, total_edges, edges_total FROM g LEFT JOIN t USING (file))"


def _grid(steps: int, nx: int, ny: int) -> str:
    parts = [f"WITH g0 AS (SELECT i // {nx} AS y, i % {nx} AS x, CASE WHEN i % {nx} IN (0, {nx - 1}) THEN sin(2 * pi() * (i // {nx}) / {ny - 1}) ELSE 0.0 END AS value FROM range({nx * ny}) t(i))"]
    for k in range(1, steps + 1):
        near = " + ".join(f"(SELECT value FROM g{k - 1} b WHERE b.y = {y} AND b.x = {x})" for y, x in (("a.y", "a.x + 1"), ("a.y", "a.x - 1"), (f"(a.y + 1) % {ny}", "a.x"), (f"(a.y + {ny - 1}) % {ny}", "a.x")))
        parts.append(f"g{k} AS MATERIALIZED (SELECT y, x, CASE WHEN x IN (0, {nx - 1}) THEN value ELSE ({near}) / 4 END AS value FROM g{k - 1} a)")
    return ",\n".join(parts)


# The wording of the report lines.
PERFORMANCE = (
    "Total execution time: 2.500000 s",
    "Graph loading/init time: 2.000000 s (80.00%)",
    "BFS traversal time: 0.500000 s (20.00%)",
    "Communication time: 0.125000 s (25.00% of BFS time)",
    "Computation time: 0.375000 s (75.00% of BFS time)",
    "Number of BFS levels: 4",
    "Average time per level: 0.125000 s",
)


def oracles() -> dict[str, str]:
    """One statement per query."""
    e1, times = _CHAIN, _TIMELINE
    degree = f"{_BOTH}, {_N}, {_IDS}, d AS (SELECT ids.vertex, count(u.dst)::BIGINT AS degree FROM ids LEFT JOIN u ON u.src = ids.vertex GROUP BY ids.vertex)"
    owners = "o AS (SELECT unnest(range(0, 4))::INTEGER AS owner)"
    deep = _bfs(times, str(S), 40)
    full = _bfs(e1, str(S), 12)
    found = {
        "graph_size": f"WITH {e1} SELECT max(greatest(src, dst)) + 1 AS num_vertices, count(*) AS num_edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS num_seen FROM e",
        "out_degree_all": f"WITH {e1}, {_N}, {_IDS} SELECT vertex, count(src)::BIGINT AS degree FROM ids LEFT JOIN e ON src = vertex GROUP BY vertex",
        "in_degree_all": f"WITH {e1}, {_N}, {_IDS} SELECT vertex, count(dst)::BIGINT AS degree FROM ids LEFT JOIN e ON dst = vertex GROUP BY vertex",
        "csr_offsets": f"""WITH {e1}, {_N}, {_IDS}, d AS (SELECT vertex, count(src) AS degree FROM ids LEFT JOIN e ON src = vertex GROUP BY vertex)
SELECT vertex, coalesce(sum(degree) OVER (ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d""",
        "adjacency_list": f"WITH {e1} SELECT src, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts, count(*) AS out_degree FROM e GROUP BY src",
        "undirected_edges": f"WITH {e1}, {_BOTH} SELECT src, dst FROM u",
        "undirected_edge_total": f"WITH {_COPURCHASE}, {_BOTH} SELECT count(*) AS total FROM u",
        "copurchase_size": f"WITH {_COPURCHASE} SELECT max(greatest(src, dst)) + 1 AS num_vertices, count(*) AS num_edges FROM e",
        "csr_literal": f"WITH {_SAMPLE} SELECT src, dst FROM e",
        "partition_stats": f"WITH {e1}, {_N}, {owners} SELECT owner, ((SELECT n FROM n) // 4 + 1)::BIGINT AS slots, count(src) AS edges FROM o LEFT JOIN e ON src % 4 = owner GROUP BY owner",
        "owner_map": f"WITH {e1}, {_N}, {_IDS} SELECT vertex, (vertex % 4)::INTEGER AS owner, vertex // 4 AS local_id, vertex AS global_id FROM ids",
        "counts_by_owner": f"WITH {e1}, {owners}, v AS (SELECT src AS vertex FROM e UNION SELECT dst FROM e) SELECT owner, count(vertex) AS count FROM o LEFT JOIN v ON vertex % 4 = owner GROUP BY owner",
        "count_matrix": f"WITH {e1} SELECT (src % 4)::INTEGER AS from_owner, " + ", ".join(f"count(*) FILTER (dst % 4 = {r}) AS to_{r}" for r in range(4)) + " FROM e GROUP BY 1",
        "send_offsets": f"""WITH {e1}, c AS (SELECT (src % 4)::INTEGER AS from_owner, (dst % 4)::INTEGER AS to_owner, count(*) AS count FROM e GROUP BY 1, 2)
SELECT from_owner, to_owner, count, coalesce(sum(count) OVER (PARTITION BY from_owner ORDER BY to_owner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM c""",
        "send_buffer": f"""WITH {e1}, v AS (SELECT src AS vertex FROM e UNION SELECT dst FROM e)
SELECT (vertex % 4)::INTEGER AS owner, vertex, (row_number() OVER (PARTITION BY vertex % 4 ORDER BY vertex) - 1)::BIGINT AS place FROM v""",
        "packed_vertices": f"""WITH {e1}, v AS (SELECT src AS vertex FROM e UNION SELECT dst FROM e)
SELECT (vertex % 4)::INTEGER AS owner, vertex, lead(vertex) OVER (PARTITION BY vertex % 4 ORDER BY vertex) AS later FROM v""",
        "local_remote_split": f"WITH {e1}, v AS (SELECT src AS vertex FROM e UNION SELECT dst FROM e) SELECT vertex, vertex % 4 = 1 AS local FROM v",
        "all_reduce": "SELECT l_linenumber::BIGINT AS index, sum(l_suppkey)::BIGINT AS value FROM lineitem GROUP BY 1",
        "all_reduce_max": "SELECT l_linenumber::BIGINT AS index, max(l_partkey) AS value FROM lineitem GROUP BY 1",
        "all_gather": """SELECT rank, (SELECT string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_regionkey, n_nationkey) FROM nation) AS gathered
FROM (SELECT DISTINCT n_regionkey::INTEGER AS rank FROM nation)""",
        "axpy": "SELECT i AS index, (i % 7) + 3.5::DOUBLE * i AS value FROM range(1000) t(i)",
        "sine_wave": "SELECT i AS index, round(sin(i::DOUBLE), 9) AS value FROM range(500) t(i)",
        "degrees": f"WITH {e1}, {degree} SELECT vertex, degree FROM d",
        "top_degrees": f"WITH {e1}, {degree} SELECT vertex, degree FROM d ORDER BY degree DESC, vertex LIMIT 10",
        "bottom_degrees": f"WITH {e1}, {degree} SELECT vertex, degree FROM d ORDER BY degree, vertex LIMIT 10",
        "degree_lookup": f"WITH {e1}, {degree} SELECT vertex, degree FROM d WHERE vertex = {S}",
        "neighbors_of": f"WITH {e1}, {_BOTH} SELECT dst AS neighbor, (dst % 4)::INTEGER AS owner FROM u WHERE src = {S}",
        "neighbors_by_owner": f"WITH {e1}, {_BOTH}, {owners} SELECT owner, count(dst) AS neighbors FROM o LEFT JOIN u ON dst % 4 = owner AND src = {S} GROUP BY owner",
        "bfs_hops": f"{full} SELECT vertex, hop FROM h",
        "bfs_ref_distance": f"{full} SELECT vertex, {_SHOWN} AS ref_distance FROM h",
        "bfs_unreached": f"{deep}, {_N}, {_IDS}, a AS (SELECT vertex, coalesce(hop, -1)::INTEGER AS hop FROM ids LEFT JOIN h USING (vertex)) SELECT vertex, hop, {_SHOWN} AS ref_distance FROM a",
        "bfs_levels": f"{full}, {_histogram('SELECT hop AS level FROM h')}",
        "bfs_ref_levels": f"{deep}, {_histogram(f'SELECT {_SHOWN} AS level FROM h')}",
        "bfs_summary": f"""{full}, {_N} SELECT {S}::BIGINT AS source, count(*) AS visited, round(100.0 * count(*) / (SELECT n FROM n), 6)::DOUBLE AS visited_percent,
max({_SHOWN}) AS max_distance, round(avg({_SHOWN}), 6) AS avg_distance, max(hop) AS eccentricity, max(hop) + 2 AS ref_levels FROM h""",
        "bfs_deep": f"{deep} SELECT vertex, hop FROM h",
        "bfs_fallback_source": f"{_bfs(e1, '1', 12)} SELECT 1::BIGINT AS source, count(*) AS visited FROM h",
        "bfs_frontier_step": f"""WITH {e1}, a AS (SELECT DISTINCT dst AS vertex FROM e WHERE src = {S} AND dst <> {S})
SELECT DISTINCT dst AS vertex FROM e JOIN a ON src = a.vertex WHERE dst <> {S} AND NOT EXISTS (SELECT 1 FROM a b WHERE b.vertex = e.dst)""",
        "bfs_undirected": f"{_bfs(f'{times}, {_BOTH}', str(S), 60, 'u')} SELECT vertex, hop FROM h",
        "bfs_max_hops": f"{_bfs(e1, str(S), 2)} SELECT vertex, hop FROM h",
        "bfs_copurchase": f"{_bfs(_COPURCHASE, str(S), 12)}, {_histogram('SELECT hop AS level FROM h')}",
        "bfs_sample_graph": f"{_bfs(_SAMPLE, '0', 8)} SELECT vertex, hop, {_SHOWN} AS ref_distance FROM h",
        "pagerank_10": f"{_pagerank(e1, 10)} SELECT vertex, round(rank, 12) AS rank FROM p10",
        "pagerank_20": f"{_pagerank(e1, 20)} SELECT vertex, round(rank, 12) AS rank FROM p20",
        "pagerank_top10": f"{_pagerank(e1, 10)} SELECT vertex, round(rank, 12) AS rank FROM p10 ORDER BY 2 DESC, 1 LIMIT 10",
        "pagerank_l1_history": f"{_pagerank(e1, 10)} " + " UNION ALL ".join(f"SELECT {k} AS iteration, round(sum(abs(a.rank - b.rank)), 12) AS l1_diff FROM p{k} a JOIN p{k - 1} b USING (vertex)" for k in range(1, 11)),
        "pagerank_mass": f"{_pagerank(e1, 10)} SELECT round(sum(rank), 12) AS mass FROM p10",
        "pagerank_converged": f"{_pagerank(e1, 60)},\nl AS ("
        + " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.rank - b.rank)) AS d FROM p{k} a JOIN p{k - 1} b USING (vertex)" for k in range(1, 61))
        + "),\ns AS (SELECT min(k) AS k FROM l WHERE d <= 1e-5)\n"
        + " UNION ALL ".join(f"SELECT vertex, round(rank, 12) AS rank FROM p{k} WHERE (SELECT k FROM s) = {k}" for k in range(1, 61)),
        "pagerank_sample_linf": f"{_pagerank(_SAMPLE, 41)} SELECT vertex, round(rank, 12) AS rank FROM p41",
        "components": f"{_components(e1)} SELECT vertex, component FROM c",
        "component_sizes_top20": f"""{_components(times)}, k AS (SELECT row_number() OVER (ORDER BY size DESC, component) AS rank, component, size FROM z)
SELECT rank::INTEGER AS rank, component, size, round(100.0 * size / (SELECT sum(size) FROM z), 6)::DOUBLE AS percent FROM k WHERE rank <= 20""",
        "component_buckets": f"""{_components(times)}, b(bucket) AS (VALUES ('single'), ('2-10'), ('11-100'), ('>100')),
k AS (SELECT CASE WHEN size = 1 THEN 'single' WHEN size <= 10 THEN '2-10' WHEN size <= 100 THEN '11-100' ELSE '>100' END AS bucket FROM z)
SELECT bucket, count(k.bucket) AS components, round(100.0 * count(k.bucket) / (SELECT count(*) FROM z), 6)::DOUBLE AS percent FROM b LEFT JOIN k USING (bucket) GROUP BY bucket""",
        "component_counts": f"{_components(times)} SELECT count(*) AS vertices, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM z) AS components, greatest((SELECT count(*) FROM z) - 20, 0) AS remainder FROM c",
        "log_partitions": f"WITH {_LOGS}, {_PARTS} SELECT file, rank, vertices, edges FROM p",
        "log_partition_totals": f"WITH {_LOGS}, {_PARTS} SELECT file, total_vertices, total_edges, slots_total, edges_total FROM t",
        "log_records": f"{_RECORDS} SELECT * EXCLUDE (edges_total) FROM x",
        "log_union": f"{_RECORDS} SELECT dataset, max_distance, NULL::VARCHAR AS file, NULL::BIGINT AS edges_total FROM x UNION ALL SELECT NULL, NULL, file, edges_total FROM t",
        "result_datasets": f"{_RECORDS} SELECT DISTINCT trim(dataset) AS dataset FROM x",
        "result_series": f"{_RECORDS} SELECT implementation, total_edges AS x, traversal_time AS y FROM x WHERE total_edges IS NOT NULL AND traversal_time IS NOT NULL",
        "result_comparison": f"{_RECORDS} SELECT CASE WHEN dataset LIKE '%g500-scale%' THEN 'S' || split_part(trim(dataset), 'scale', -1) ELSE trim(dataset) END AS label, implementation, computation_time, communication_time FROM x",
        "result_axis_limit": f"{_RECORDS} SELECT round(greatest(max(computation_time), max(communication_time)) * 1.1, 9) AS axis_limit FROM x",
        "result_cluster_bounds": f"""{_RECORDS} SELECT round(greatest(0, min(computation_time) - 0.05), 9) AS x_min, round(max(computation_time) + 0.05, 9) AS x_max,
round(greatest(0, min(communication_time) - 0.05), 9) AS y_min, round(max(communication_time) + 0.05, 9) AS y_max, count(*) AS points FROM x WHERE computation_time < 0.5 AND communication_time < 0.5""",
        "result_ratios": f"{_RECORDS} SELECT trim(dataset) AS dataset, implementation, round(CASE WHEN computation_time > 0 THEN communication_time / computation_time ELSE 0 END, 9) AS ratio FROM x",
        "result_normalised": f"{_RECORDS} SELECT dataset, implementation, total_edges, round((total_edges - min(total_edges) OVER ())::DOUBLE / (max(total_edges) OVER () - min(total_edges) OVER ()), 9) AS scaled FROM x",
        "result_distance_table": f"""{_RECORDS}, v AS (SELECT lower(trim(dataset)) AS dataset, implementation AS i, coalesce(avg_distance, max_distance::DOUBLE, 0.0) AS v FROM x)
SELECT dataset, coalesce(max(v) FILTER (i = 'CPU'), 0.0) AS cpu, coalesce(max(v) FILTER (i = 'GPU'), 0.0) AS gpu, coalesce(max(v) FILTER (i = 'GPU_STF'), 0.0) AS gpu_stf FROM v GROUP BY dataset""",
        "result_speedup": f"""{_RECORDS} SELECT a.dataset, a.implementation, round(b.traversal_time / a.traversal_time, 6) AS speedup, round(a.total_edges / a.traversal_time, 6) AS edges_per_second
FROM x a JOIN x b ON a.dataset = b.dataset AND b.implementation = 'CPU'""",
        "result_series_vertices": f"{_RECORDS} SELECT implementation, total_vertices AS x, traversal_time AS y FROM x WHERE total_vertices IS NOT NULL AND traversal_time IS NOT NULL",
        "result_series_level_edges": f"{_RECORDS} SELECT implementation, total_edges AS x, avg_time_per_level AS y FROM x WHERE total_edges IS NOT NULL AND avg_time_per_level IS NOT NULL",
        "result_series_level_vertices": f"{_RECORDS} SELECT implementation, total_vertices AS x, avg_time_per_level AS y FROM x WHERE total_vertices IS NOT NULL AND avg_time_per_level IS NOT NULL",
        "result_efficiency": f"""{_RECORDS} SELECT a.dataset, a.implementation, round(b.traversal_time / a.traversal_time, 6) AS speedup, round(b.traversal_time / a.traversal_time / 4, 6) AS efficiency
FROM x a JOIN x b ON a.dataset = b.dataset AND b.implementation = 'CPU'""",
        "read_edge_list": f"WITH {e1} SELECT src, dst FROM e",
        "read_token_stream": f"WITH {e1} SELECT src, dst FROM e",
        "read_matrix_market": f"WITH {e1} SELECT src, dst FROM e",
        "read_matrix_header": f"WITH {e1}, {_N} SELECT (SELECT n FROM n) AS rows, (SELECT n FROM n) AS columns, count(*) AS entries FROM e",
        "read_bad_lines": f"WITH {e1} SELECT 'x ' || src AS line, count(*) AS times FROM e WHERE dst % 50 = 0 GROUP BY src",
        "read_logs": f"WITH {_LOGS} SELECT file, text FROM g",
        "read_results": f"{_RECORDS} SELECT * EXCLUDE (file, edges_total) FROM x",
        "report_statistics": f"""{full}, {_N}, s AS (SELECT count(*) AS visited, max({_SHOWN}) AS far, avg({_SHOWN}) AS mean FROM h)
SELECT 0 AS line_number, 'Source vertex: {S}' AS line UNION ALL
SELECT 1, 'Visited vertices: ' || visited || printf(' (%.2f%% of graph)', 100.0 * visited / (SELECT n FROM n)) FROM s UNION ALL
SELECT 2, 'Maximum distance from source: ' || far FROM s UNION ALL SELECT 3, printf('Average distance from source: %.2f', mean) FROM s""",
        "report_levels": f"""{full}, c AS (SELECT {_SHOWN} AS level, count(*) AS n FROM h GROUP BY 1), a AS (SELECT unnest(range(0, (SELECT max(level) + 1 FROM c)))::INTEGER AS level)
SELECT 0 AS line_number, 'Level | Count | Percent' AS line UNION ALL
SELECT level + 1, level || ' | ' || coalesce(n, 0) || printf(' | %.2f%%', 100.0 * coalesce(n, 0) / (SELECT sum(n) FROM c)) FROM a LEFT JOIN c USING (level)""",
        "report_performance": "SELECT * FROM (VALUES "
        + ", ".join(f"({i}, '{line}')" for i, line in enumerate(PERFORMANCE))
        + ") t(line_number, line)",
        "report_partitions": f"""WITH {e1}, {_N}, {owners} SELECT owner AS line_number,
'Rank ' || owner || ': Loaded ' || ((SELECT n FROM n) // 4 + 1) || ' vertices and ' || count(src) || ' edges in local partition' AS line FROM o LEFT JOIN e ON src % 4 = owner GROUP BY owner""",
        "report_pagerank": f"""{_pagerank(e1, 10)}, k AS (SELECT row_number() OVER (ORDER BY round(rank, 9) DESC, vertex) AS i, vertex, rank FROM p10)
SELECT (i - 1)::INTEGER AS line_number, i || '. Vertex ' || vertex || printf(': %.9f', rank) AS line FROM k WHERE i <= 10 UNION ALL
SELECT 10, 'Iterations: 10' UNION ALL SELECT 11, 'Converged: No' UNION ALL SELECT 12, 'Average iteration time: 0.000000 s'""",
        "report_degrees": f"""WITH {e1}, {degree}, k AS (SELECT vertex, degree, row_number() OVER (ORDER BY degree DESC, vertex) AS high, row_number() OVER (ORDER BY degree, vertex) AS low FROM d)
SELECT 0 AS line_number, 'Highest degrees' AS line UNION ALL SELECT high::INTEGER, vertex || ' | ' || degree FROM k WHERE high <= 10 UNION ALL
SELECT 11, 'Lowest degrees' UNION ALL SELECT 11 + low::INTEGER, vertex || ' | ' || degree FROM k WHERE low <= 10""",
        "report_components": f"""{_components(times)}, k AS (SELECT row_number() OVER (ORDER BY size DESC, component) AS rank, size FROM z),
t AS (SELECT sum(size) AS vertices, count(*) AS components FROM z),
b(i, bucket) AS (VALUES (0, 'single'), (1, '2-10'), (2, '11-100'), (3, '>100')),
q AS (SELECT CASE WHEN size = 1 THEN 'single' WHEN size <= 10 THEN '2-10' WHEN size <= 100 THEN '11-100' ELSE '>100' END AS bucket FROM z)
SELECT 0 AS line_number, 'Vertices: ' || vertices AS line FROM t UNION ALL SELECT 1, 'Edges: ' || (SELECT count(*) FROM e) UNION ALL SELECT 2, 'Components: ' || components FROM t UNION ALL
SELECT 2 + rank::INTEGER, rank || ' | ' || size || printf(' | %.2f%%', 100.0 * size / (SELECT vertices FROM t)) FROM k WHERE rank <= 20 UNION ALL
SELECT 23, '... and ' || (components - 20) || ' more' FROM t UNION ALL
SELECT 24 + i, bucket || ': ' || count(q.bucket) || printf(' (%.2f%%)', 100.0 * count(q.bucket) / (SELECT components FROM t)) FROM b LEFT JOIN q USING (bucket) GROUP BY i, bucket""",
        "report_neighbors": f"""WITH {e1}, {_BOTH}, {owners}, m AS (SELECT dst, (row_number() OVER (ORDER BY dst) - 1) // 5 AS row FROM u WHERE src = {S})
SELECT owner AS line_number, 'Owner ' || owner || ': ' || count(dst) AS line FROM o LEFT JOIN u ON dst % 4 = owner AND src = {S} GROUP BY owner UNION ALL
SELECT (4 + row)::INTEGER, string_agg(dst || '@' || dst % 4, ' ' ORDER BY dst) FROM m GROUP BY row""",
        "pagerank_pull": f"{_pagerank(e1, 10, 'dst', 'src')} SELECT vertex, round(rank, 12) AS rank FROM p10",
        "row_blocks": "SELECT r::INTEGER AS rank, (1 + 12 * r + greatest(r - 3, 0))::INTEGER AS first_row, (CASE WHEN r < 3 THEN 12 ELSE 13 END)::INTEGER AS rows FROM range(8) t(r)",
        "shown_distances": f"SELECT hop, {_SHOWN} AS ref_distance FROM range(-1, 50) t(hop)",
        "relaxation": f"{_grid(3, 16, 12)} SELECT y, x, round(value, 9) AS value FROM g3",
    }
    same = ("bfs_hops", "bfs_levels", "bfs_deep", "bfs_unreached", "bfs_summary", "pagerank_10", "pagerank_pull", "pagerank_converged", "components")
    return found | {f"{name}_distributed": found[name] for name in same} | {"component_sizes_distributed": found["component_sizes_top20"]}
