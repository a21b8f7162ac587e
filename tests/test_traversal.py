import random

import pytest

from vertexloom.operators import bfs as B
from vertexloom.operators import components as C
from vertexloom.operators import pagerank as P
from vertexloom.operators import reports, stencil
from vertexloom.plans import graphs
from vertexloom.sources import runlogs
from tests.test_graph import M2, values


def hops(search, **kw):
    return {r["vertex"]: r["hop"] for r in B.distances(search, **kw).collect()}


def plain_bfs(pairs, source):
    seen, frontier, level = {source: 0}, [source], 0
    while frontier:
        level += 1
        frontier = sorted({b for a, b in pairs if a in frontier and b not in seen})
        seen.update(dict.fromkeys(frontier, level))
    return seen


@pytest.fixture(params=[None, 0], ids=["one task", "distributed"])
def small(request):
    return request.param


def test_sample_distances(spark, small):
    search = B.bfs(graphs.sample(spark), 0, small_edges=small)
    assert hops(search) == {0: 0, 1: 1, 2: 1, 3: 1, 6: 1, 4: 2, 5: 2, 7: 2, 8: 2}
    s = B.summary(search).first()
    assert (s["visited"], s["visited_percent"], s["max_distance"], s["eccentricity"]) == (9, 100.0, 3, 2)
    assert s["avg_distance"] == pytest.approx(2.222222, abs=1e-6)
    assert values(B.level_histogram(search.hops), "level", "count") == [(0, 1), (1, 4), (2, 4)]


def test_corner_distances(spark, small):
    search = B.bfs(graphs.from_pairs(spark, M2), 1, small_edges=small)
    assert hops(search) == {1: 0, 2: 1, 3: 2, 4: 3}
    assert hops(search, include_unreached=True)[9] == -1
    shown = B.distances(search)
    assert values(B.level_histogram(shown, "ref_distance"), "level", "count") == [(0, 1), (1, 0), (2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize(("broadcast_rows", "small_edges"), [(0, 0), (3, 0), (10**6, 0), (0, None)])
def test_random_graph_under_all_strategies(spark, broadcast_rows, small_edges):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    assert hops(B.bfs(graphs.from_pairs(spark, pairs), 7, broadcast_rows=broadcast_rows, small_edges=small_edges)) == plain_bfs(pairs, 7)


def test_star_with_many_leaves(spark, small):
    pairs = [(0, i) for i in range(1, 2001)] + [(i, 0) for i in range(1, 2001)]
    assert B.bfs(graphs.from_pairs(spark, pairs), 5, small_edges=small).level_sizes == [1, 1, 1999]


def test_max_hops(spark, small):
    assert hops(B.bfs(graphs.from_pairs(spark, [(i, i + 1) for i in range(9)]), 0, max_hops=3, small_edges=small)) == {0: 0, 1: 1, 2: 2, 3: 3}


def test_source_rules():
    assert B.choose_source(10, 10) == 1
    assert B.choose_source(10, -1) == 1
    assert B.choose_source(10, "x") == 0
    assert B.choose_source(10, 3) == 3
    assert B.choose_source(10, None, seed=1) == B.choose_source(10, None, seed=1)
    assert B.choose_source(1, 5) == 0


def test_pagerank_sample(spark, small):
    r = P.pagerank(graphs.sample(spark), small_edges=small)
    assert r.converged and r.iterations == 36
    assert tuple(P.summary(graphs.sample(spark), r, 3.6).first())[:2] == (36, True)
    expected = [0.18765228, 0.33325162, 0.05654287, 0.09700967, 0.05713347, 0.05713347, 0.09700967, 0.05713347, 0.05713347]
    assert [x for _, x in values(r.ranks, "vertex", "rank")] == pytest.approx(expected, abs=1e-7)
    assert P.mass(r.ranks).first()["mass"] == pytest.approx(1)
    assert [v["vertex"] for v in P.top_k(r.ranks, 4, 7).collect()] == [1, 0, 3, 6]


def test_pagerank_dangling(spark, small):
    r = P.pagerank(graphs.from_pairs(spark, M2), small_edges=small)
    assert r.iterations == 25
    expected = [0.015, 0.0386684, 0.04787099, 0.05569034, 0.25777027, 0.015, 0.015, 0.02775, 0.015, 0.1]
    assert [x for _, x in values(r.ranks, "vertex", "rank")] == pytest.approx(expected, abs=1e-7)
    assert P.mass(r.ranks).first()["mass"] == pytest.approx(0.58775, abs=1e-5)


def test_pagerank_signed_rule_stops_earlier(spark):
    assert P.pagerank(graphs.sample(spark), tol=1e-6, norm="signed_max", max_iter=40).iterations == 36


def test_components_corner(spark, small):
    g = graphs.from_pairs(spark, M2)
    found = C.connected_components(g, small)
    assert values(found, "vertex", "component") == [(1, 1), (2, 1), (3, 1), (4, 1), (6, 6), (7, 6), (9, 9)]
    assert {r["bucket"]: r["components"] for r in C.size_buckets(found).collect()} == {"single": 1, "2-10": 2, "11-100": 0, ">100": 0}
    top = C.largest_components(found, 2).orderBy("rank").collect()
    assert [(r["rank"], r["component"], r["size"]) for r in top] == [(1, 1, 4), (2, 6, 2)]
    assert tuple(C.counts(g, found, 2).first()) == (7, 8, 3, 1)


def test_components_long_path(spark, small):
    found = C.connected_components(graphs.from_pairs(spark, [(i, i + 1) for i in range(1000)]), small)
    assert found.where("component <> 0").count() == 0
    assert found.count() == 1001


def test_empty_graph_has_no_ranks_or_components(spark, small):
    g = graphs.from_pairs(spark, [])
    assert P.pagerank(g, small_edges=small).ranks.count() == 0
    assert C.connected_components(g, small).count() == 0
    assert hops(B.bfs(g, 0, small_edges=small)) == {0: 0}


def test_reports_are_read_by_the_log_reader(spark, tmp_path):
    g = graphs.sample(spark)
    search = B.bfs(g, 0)
    perf = reports.PerfRecord(2.0, 1.0, 0.5, 4)
    text = "\n".join([reports.partitions(g.partition_stats()), reports.statistics(search), reports.performance(perf), reports.levels(search)])
    (tmp_path / "tiny_cpu.out").write_text(text)
    r = runlogs.run_records(runlogs.read_logs(spark, str(tmp_path))).first()
    assert (r["dataset"], r["implementation"], r["visited_vertices"], r["slots_total"], r["edges_total"]) == ("tiny", "CPU", 9, 12, 20)
    assert (r["total_time"], r["traversal_percentage"], r["max_distance"]) == (2.0, 25.0, 3)
    assert "Vertex 1" in reports.pagerank(P.pagerank(g, tol=None, max_iter=3), 1.0)
    assert reports.components(g, C.connected_components(g)).startswith("Vertices: 9")
    assert reports.degrees(g, 2).splitlines()[1] == "1 | 7"
    assert reports.neighbor_list(g, 0).splitlines()[0] == "Owner 0: 0"
    assert perf.frame(spark).count() == 1


def test_relaxation_against_a_plain_grid(spark):
    import math

    nx, ny = 6, 5
    grid = [[math.sin(2 * math.pi * y / (ny - 1)) if x in (0, nx - 1) else 0.0 for x in range(nx)] for y in range(ny)]
    for _ in range(3):
        grid = [[grid[y][x] if x in (0, nx - 1) else (grid[y][x - 1] + grid[y][x + 1] + grid[y - 1][x] + grid[(y + 1) % ny][x]) / 4 for x in range(nx)] for y in range(ny)]
    done = stencil.relax(stencil.boundary_grid(spark, nx, ny), nx, ny, steps=3)
    assert len(done.norms) == 3
    for y, x, v in values(done.cells, "y", "x", "value"):
        assert v == pytest.approx(grid[y][x])
    assert stencil.differing(done.cells, done.cells, 1e-12).first()["cells"] == 0
