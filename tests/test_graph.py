import pytest

from vertexloom.graph import Graph
from vertexloom.operators import degree, exchange
from vertexloom.plans import graphs

M2 = [(1, 2), (1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (6, 7), (9, 9)]


@pytest.fixture(scope="module")
def sample(spark):
    return graphs.sample(spark).staged()


@pytest.fixture(scope="module")
def corner(spark):
    return graphs.from_pairs(spark, M2).staged()


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def test_sample_graph(sample):
    assert sample.num_vertices == 9
    assert sample.edges.count() == 20
    assert [d for _, d in values(degree.degrees(sample), "vertex", "degree")] == [4, 7, 1, 2, 1, 1, 2, 1, 1]
    assert values(sample.partition_stats(), "owner", "slots", "edges") == [(0, 3, 6), (1, 3, 8), (2, 3, 3), (3, 3, 3)]
    assert [o for _, o in values(sample.row_offsets(range_size=4), "vertex", "offset")] == graphs.SAMPLE_OFFSETS[:-1]


def test_corner_cases(corner):
    assert corner.num_vertices == 10
    assert corner.edges.count() == 8
    assert corner.adjacency_sets().count() == 12
    assert [d for _, d in values(degree.degrees(corner), "vertex", "degree")] == [0, 2, 2, 3, 2, 0, 1, 1, 0, 1]
    assert [tuple(r) for r in degree.bottom_degrees(corner, 6).collect()] == [(0, 0), (5, 0), (8, 0), (6, 1), (7, 1), (9, 1)]
    assert [e for _, e in values(corner.partition_stats(), "owner", "edges")] == [1, 3, 2, 2]


def test_adjacency_lists_are_sorted(corner):
    lists = {r["src"]: r["dsts"] for r in corner.adjacency_lists().collect()}
    assert lists[1] == [2, 2]
    assert lists[3] == [1, 4]


def test_degree_of_unknown_vertex_is_zero(corner):
    assert degree.degree_of(corner, 77).first()["degree"] == 0
    assert degree.degree_of(corner, 4).first()["degree"] == 2


def test_neighbors_out_of_range_raise(corner):
    with pytest.raises(ValueError):
        degree.neighbors(corner, 10)


def test_neighbors_keep_empty_owners(corner):
    assert values(degree.neighbors_by_owner(corner, 1), "owner", "neighbors") == [(0, 0), (1, 0), (2, 1), (3, 1)]


def test_null_ends_are_no_edges(spark):
    df = spark.createDataFrame([(1, 2), (None, 3), (4, None)], "src long, dst long")
    assert Graph.from_edges(df).edges.count() == 1


def test_ids_are_validated(spark):
    assert Graph.from_edges(spark.createDataFrame([(1, 2**32)], "src long, dst long"), validate=True).num_vertices == 2**32 + 1
    for bad in (-1, 2**63 - 1):
        with pytest.raises(ValueError):
            Graph.from_edges(spark.createDataFrame([(1, bad)], "src long, dst long"), validate=True)


def test_ids_beyond_31_bits_survive(spark):
    g = graphs.from_pairs(spark, [(4294967295, 3), (3, 2147483648)])
    assert g.num_vertices == 4294967296
    assert values(g.vertices(), "vertex") == [(3,), (2147483648,), (4294967295,)]


def test_empty_graph(spark):
    g = graphs.from_pairs(spark, [])
    assert g.num_vertices == 0
    assert degree.degrees(g).count() == 0


def test_count_matrix_and_offsets(sample):
    matrix = {r["from_owner"]: [r[f"to_{i}"] for i in range(4)] for r in exchange.count_matrix(sample).collect()}
    assert sum(map(sum, matrix.values())) == 20
    for r in exchange.send_offsets(sample).collect():
        assert r["count"] == matrix[r["from_owner"]][r["to_owner"]]
        assert r["offset"] == sum(matrix[r["from_owner"]][: r["to_owner"]])
