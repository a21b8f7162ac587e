import pytest

from tests.test_graph import M2
from vertexloom.__main__ import main


@pytest.fixture
def path(tmp_path):
    f = tmp_path / "m.edges"
    f.write_text("".join(f"{a} {b}\n" for a, b in M2))
    return str(f)


def said(spark, capsys, *arguments):
    main(list(arguments), spark)
    return capsys.readouterr().out


def test_bfs_prints_both_reports(spark, capsys, path):
    for more in ([], ["--small-edges", "0"]):
        out = said(spark, capsys, "bfs", path, "--source", "1", *more)
        assert "Source vertex: 1\nVisited vertices: 4 " in out and "Number of BFS levels: 4" in out and "Rank 3: Loaded " in out


def test_other_commands(spark, capsys, path):
    assert said(spark, capsys, "pagerank", path, "--top", "3").startswith("1. Vertex ")
    assert "Components: " in said(spark, capsys, "components", path)
    assert said(spark, capsys, "degrees", path, "--top", "2").count("|") == 4
    assert "Owner 3: " in said(spark, capsys, "neighbors", path, "1")


def test_suite_writes_logs_and_results(spark, capsys, path, tmp_path):
    out = said(spark, capsys, "suite", path, "--source", "1", "--logs", str(tmp_path / "logs"), "--results", str(tmp_path / "csv"))
    assert out.startswith("2 runs") and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_wrong_arguments_end_with_a_message(capsys):
    with pytest.raises(SystemExit):
        main(["unknown"])
    assert "usage" in capsys.readouterr().err
