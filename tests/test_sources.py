import pytest

from vertexloom.operators import results
from vertexloom.plans import graphs
from vertexloom.sources import edges, runlogs
from tests.test_graph import M2, values


def test_edge_list_skips_comments_and_text(spark, tmp_path):
    f = tmp_path / "a.edges"
    f.write_text("# head\n% more\n\n  1   2 \n3\t4\nx y\n5\n7 8 0.5\n")
    assert values(edges.read_edge_list(spark, str(f)).edges, "src", "dst") == [(1, 2), (3, 4), (7, 8)]
    with pytest.raises(Exception, match="not an edge"):
        edges.read_edge_list(spark, str(f), strict=True).edges.collect()


def test_empty_file(spark, tmp_path):
    f = tmp_path / "e.edges"
    f.write_text("")
    assert edges.read_edge_list(spark, str(f)).num_vertices == 0


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        edges.read_edge_list(spark, str(tmp_path / "none"))


def test_matrix_market_size_line_is_no_edge(spark, tmp_path):
    f = tmp_path / "m.mtx"
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n% c\n10 10 8\n" + "".join(f"{a} {b}\n" for a, b in M2))
    graph, header = edges.read_matrix_market(spark, str(f))
    assert (header.rows, header.columns, header.entries) == (10, 10, 8)
    assert values(graph.edges, "src", "dst") == sorted(M2)
    assert edges.read_graph(spark, str(f)).edges.count() == 8


def test_banner_marks_matrix_market_under_any_name(spark, tmp_path):
    f = tmp_path / "graph.txt"
    f.write_text("%%MatrixMarket matrix coordinate pattern general\n4 4 2\n1 2\n2 3\n")
    assert values(edges.read_graph(spark, str(f)).edges, "src", "dst") == [(1, 2), (2, 3)]


def test_suite_runs_every_file(spark, tmp_path):
    from vertexloom.plans.suite import run_suite

    for name, pairs in (("one.edges", M2), ("two.edges", [(i, i + 1) for i in range(12)])):
        (tmp_path / name).write_text("".join(f"{a} {b}\n" for a, b in pairs))
    rows = run_suite(spark, [str(tmp_path / n) for n in ("one.edges", "two.edges")], source=1).collect()
    assert sorted((r["dataset"], r["implementation"]) for r in rows) == [(n, i) for n in ("one.edges", "two.edges") for i in ("ROUNDS", "TASK")]
    assert all(0 <= r["communication_time"] <= r["traversal_time"] for r in rows) and any(r["communication_time"] > 0 for r in rows)
    by = [{r["dataset"]: r for r in rows if r["implementation"] == i} for i in ("TASK", "ROUNDS")]
    for name in ("one.edges", "two.edges"):
        assert len({tuple(b[name][c] for c in ("visited_vertices", "max_distance", "bfs_levels", "total_edges", "avg_distance")) for b in by}) == 1
    found = by[0]
    assert (found["one.edges"]["visited_vertices"], found["one.edges"]["max_distance"]) == (4, 4)
    assert (found["two.edges"]["visited_vertices"], found["two.edges"]["bfs_levels"], found["two.edges"]["edges_total"]) == (12, 12, 12)


def test_parquet_graph(spark, tmp_path):
    path = str(tmp_path / "g.parquet")
    graphs.from_pairs(spark, M2).edges.write.parquet(path)
    assert edges.read_graph(spark, path, strict=True).edges.count() == 8


def test_large_ids(spark, tmp_path):
    f = tmp_path / "l.edges"
    f.write_text("4294967295 0\n4294967296 1\n9223372036854775806 2\n")
    assert values(edges.read_edge_list(spark, str(f)).edges, "src", "dst") == [(4294967295, 0), (4294967296, 1), (2**63 - 2, 2)]
    for bad in ("-1 2\n", "1 9223372036854775807\n"):
        f.write_text("1 2\n" + bad)
        with pytest.raises(Exception, match="vertex id out of range"):
            edges.read_edge_list(spark, str(f)).edges.collect()


def test_size_line_after_any_number_of_comments_and_dropped_once(spark, tmp_path):
    f = tmp_path / "c.mtx"
    f.write_text("%%MatrixMarket matrix coordinate integer general\n" + "% c\n" * 5000 + "3 3 2\n1 2 7\n3 3 2\n")
    graph, header = edges.read_matrix_market(spark, str(f))
    assert (header.rows, header.columns, header.entries) == (3, 3, 2)
    assert values(graph.edges, "src", "dst") == [(1, 2), (3, 3)]


def test_skipped_lines_are_listed(spark, tmp_path):
    f = tmp_path / "b.edges"
    f.write_text("1 2\nx y\n# c\n3\n4 5\n")
    assert values(edges.bad_lines(spark, str(f)), "line") == [("3",), ("x y",)]


def test_token_stream_reads_pairs_over_line_ends(spark, tmp_path):
    f = tmp_path / "t.edges"
    f.write_text("1 2 3\n4\n\n5 6 7 8 9\n")
    assert values(edges.read_token_stream(spark, str(f)).edges, "src", "dst") == [(1, 2), (3, 4), (5, 6), (7, 8)]


def test_graph_files_round_trip(spark, tmp_path):
    graph = graphs.power_law(spark, 6, 300)
    edges.write_edge_list(graph, str(tmp_path / "g.edges"))
    edges.write_matrix_market(graph, str(tmp_path / "g.mtx"))
    wanted = values(graph.edges, "src", "dst")
    assert values(edges.read_graph(spark, str(tmp_path / "g.edges")).edges, "src", "dst") == wanted
    assert values(edges.read_graph(spark, str(tmp_path / "g.mtx"), strict=True).edges, "src", "dst") == wanted


def test_matrix_market_head_comes_first(spark, tmp_path):
    # Shuffled edges have preferred places and the head has none: of a union, one task reads the edges first.
    full = graphs.power_law(spark, 8, 2000).partitioned(3)
    for name, graph, entries in (("full", full, 2000), ("empty", type(full)(full.edges.where("src < 0")), 0)):
        edges.write_matrix_market(graph, str(tmp_path / name))
        (file,) = (tmp_path / name).glob("part-*")
        n = graph.num_vertices
        assert file.read_text().splitlines()[:2] == ["%%MatrixMarket matrix coordinate pattern general", f"{n} {n} {entries}"]
        assert edges.read_header(spark, str(tmp_path / name)) == edges.GraphHeader(n, n, entries)


def test_matrix_market_of_shuffled_edges_has_no_further_edge(spark, tmp_path):
    graph = graphs.power_law(spark, 8, 2000).partitioned(3)
    edges.write_matrix_market(graph, str(tmp_path / "g"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # so that the file is read in several blocks
    try:
        read, header = edges.read_matrix_market(spark, str(tmp_path / "g"), strict=True)
        assert header.entries == 2000 and values(read.edges, "src", "dst") == values(graph.edges, "src", "dst")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_logs_round_trip_through_csv(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, text in graphs.example_logs():
        (logs / name).write_text(text)
    (logs / "bad_cpu.out").write_text("nothing here")
    records = runlogs.run_records(runlogs.read_logs(spark, str(logs)))
    assert [r["file"] for r in runlogs.unparsed(records).collect()] == ["bad_cpu.out"]
    known = records.where("source_vertex is not null").drop("file")
    runlogs.write_results(known, str(tmp_path / "csv"))
    back = runlogs.read_results(spark, str(tmp_path / "csv"))
    assert back.columns == sorted(known.columns)
    by = {(r["dataset"], r["implementation"]): r for r in back.collect()}
    assert by["g500-scale18", "CPU"]["total_vertices"] == 251
    assert by["g500-scale18", "CPU"]["slots_total"] == "1004"
    assert by["web-small", "GPU_STF"]["avg_distance"] is None
    table = {r["dataset"]: r for r in results.distance_table(back, ["CPU", "GPU", "GPU_STF"]).collect()}
    assert table["web-small"]["gpu_stf"] == 7.0
    assert table["web-small"]["cpu"] == 0.0
