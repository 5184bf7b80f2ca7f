import pytest

from vertexflow import Graph, algorithms, cli
from vertexflow.sources import line_numbers, read_edge_list, read_metis, show_graph, write_adjacency, write_edge_list, write_edges, write_vertices


def rows(graph, *columns):
    return sorted((tuple(r) for r in graph.edges.select(*columns).collect()), key=str)


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_edge_list(spark, tmp_path):
    f = tmp_path / "g.txt"
    f.write_text("# Weighted\n#\n\n4 4\n2 0 9\n0 1 5\n0\t1\n1   3 2\n")
    g = read_edge_list(spark, str(f))
    assert g.n == 4
    assert rows(g, "src", "dst", "weight") == sorted([(0, 1, 5), (0, 1, None), (1, 3, 2), (2, 0, 9)], key=str)
    assert {r[2] for r in rows(read_edge_list(spark, str(f), unit_weights=True), "src", "dst", "weight")} == {1}
    write_edge_list(g, str(tmp_path / "out"))
    again = read_edge_list(spark, str(tmp_path / "out"))
    assert rows(again, "src", "dst") == rows(g, "src", "dst")


@pytest.mark.parametrize("text", ["", "# only\n", "x y\n", "3 1\n0\n", "3 1\n0 7\n", "3 2\n0 1\n", "3 1\na b\n"])
def test_bad_edge_lists(spark, tmp_path, text):
    f = tmp_path / "bad.txt"
    f.write_text(text)
    with pytest.raises(ValueError):
        read_edge_list(spark, str(f))


def test_missing_file_and_no_header(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_edge_list(spark, str(tmp_path / "none")).edge_count()
    with pytest.raises(ValueError):
        read_edge_list(spark, "x", header=False)
    f = tmp_path / "h.txt"
    f.write_text("0 1\n1 2\n")
    assert rows(read_edge_list(spark, str(f), n=3, header=False), "src", "dst") == [(0, 1), (1, 2)]


def test_many_splits_and_files(spark, tmp_path):
    n = 4000
    edges = [(i, (i * 7 + 1) % n) for i in range(n)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text(f"# c\n{n} {n}\n" + "".join(f"{s} {d}\n" for s, d in edges[:500]))
    (tmp_path / "d" / "b.txt").write_text("".join(f"{s} {d}\n" for s, d in edges[500:]))
    (tmp_path / "m.graph").write_text(f"{n} {n // 2}\n" + "".join(f"{d + 1}\n" for _, d in edges))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert rows(read_edge_list(spark, str(tmp_path / "d")), "src", "dst") == sorted(edges, key=str)
        assert rows(read_metis(spark, str(tmp_path / "m.graph")), "src", "dst") == sorted(edges, key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_edges(spark, tmp_path):
    f = tmp_path / "iso.txt"
    f.write_text("# isolated\n5 0\n")
    g = read_edge_list(spark, str(f))
    assert (g.n, g.edge_count()) == (5, 0)
    assert [r["level"] for r in algorithms.bfs(g).graph.vertices.orderBy("id").collect()] == [0, None, None, None, None]


def test_metis(spark, tmp_path):
    f = tmp_path / "m.graph"
    f.write_text("# c\n% c\n5 3\n2\n1 3 4\n2\n2 # end\n")
    g = read_metis(spark, str(f))
    assert g.n == 5
    assert rows(g, "src", "dst") == [(0, 1), (1, 0), (1, 2), (1, 3), (2, 1), (3, 1)]
    f.write_text("4 1\n\n3\n2\n\n")
    assert rows(read_metis(spark, str(f)), "src", "dst") == [(1, 2), (2, 1)]


@pytest.mark.parametrize("text", ["", "2 1 1\n2\n1\n", "2 1\n2\n", "2 1\n2\n1\n1\n", "2 1\n2\n3\n", "x\n"])
def test_bad_metis(spark, tmp_path, text):
    f = tmp_path / "bad.graph"
    f.write_text(text)
    with pytest.raises(ValueError):
        read_metis(spark, str(f))


def test_sinks(spark, tmp_path, capsys):
    f = tmp_path / "g.txt"
    f.write_text("3 2\n0 1 4\n1 2 6\n")
    g = read_edge_list(spark, str(f))
    write_vertices(algorithms.printed(algorithms.bfs(g, source=1), "level"), "level", str(tmp_path / "bfs"))
    assert lines(tmp_path / "bfs") == ["2147483647", "0", "1"]
    write_vertices(algorithms.pagerank(g, epsilon=None, max_passes=1).graph.vertices, "rank", str(tmp_path / "pr"))
    assert lines(tmp_path / "pr") == ["0.050000", "0.333333", "0.333333"]
    write_edges(g.edges, "weight", str(tmp_path / "e"))
    assert lines(tmp_path / "e") == ["4", "6"]
    write_adjacency(g, str(tmp_path / "a"))
    assert lines(tmp_path / "a") == ["0 1", "1 2", "2 "]
    show_graph(g, verbose=True)
    assert "Nodes: 3, edges: 2" in capsys.readouterr().out


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "g.txt"
    f.write_text("3 2\n0 1 4\n1 2 6\n")
    assert cli.main(["sssp", str(f), "--output", str(tmp_path / "o"), "--verbose"]) == 0
    assert lines(tmp_path / "o") == ["0", "4", "10"]
    assert cli.main(["stats", str(f)]) == 0
    assert "passes" in capsys.readouterr().out


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_numbers_need_no_sort_and_count_blank_lines(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_text("a\n\nb\n")
    (tmp_path / "d" / "part-1").write_text("c\n#d\n" * 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = line_numbers(spark, str(tmp_path / "d"))
        assert sorted(map(tuple, numbered.collect())) == list(enumerate(["a", "", "b"] + ["c", "#d"] * 3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Window" not in physical(numbered) and "Sort" not in physical(numbered)


@pytest.mark.parametrize("reader, text", [(read_edge_list, "3 2\n0 1\n1 2\n"), (read_metis, "2 1\n2\n1\n")])
def test_lines_are_split_once(spark, tmp_path, monkeypatch, reader, text):
    f = tmp_path / "g"
    f.write_text(text)
    given, of = [], Graph.of
    monkeypatch.setattr(Graph, "of", lambda edges, n, **options: given.append(physical(edges)) or of(edges, n, **options))
    assert reader(spark, str(f)).edges.count() == 2
    assert "InMemoryTableScan" in given[0]
