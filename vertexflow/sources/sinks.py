"""Text dumps of vertex and edge state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def _printed(df: DataFrame, column: str) -> Column:
    """Integers as they are, floating point with six decimals."""
    kind = dict(df.dtypes)[column]
    return F.format_string("%.6f", column) if kind in ("double", "float") else F.col(column).cast("string")


def write_vertices(vertices: DataFrame, column: str, path: str) -> None:
    """One line per vertex in the order of ids: range-sorted files of the folder `path`, in name order."""
    vertices.select("id", _printed(vertices, column).alias("value")).orderBy("id").select("value").write.text(path)


def write_edges(edges: DataFrame, column: str, path: str) -> None:
    """One line per edge, by source and end."""
    edges.select("src", "dst", _printed(edges, column).alias("value")).orderBy("src", "dst", "value").select("value").write.text(path)


def write_adjacency(graph: Graph, path: str) -> None:
    """One line per vertex: its id and sorted out-neighbours."""
    lists = graph.adjacency()
    text = F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.col("neighbours").cast("array<string>"), " "))
    graph.write_in_order(lists.select("id", text.alias("value")), path)


def graph_lines(graph: Graph) -> DataFrame:
    """(line, text): the counts, then the out-degree histogram, a slot a line."""
    slots = graph.degree_histogram().select((F.col("slot") + 1).cast("long").alias("line"), F.concat(F.lit("slot "), F.col("slot").cast("string"), F.lit(": "), F.col("vertices").cast("string")).alias("text"))
    return graph.spark.createDataFrame([(0, f"Nodes: {graph.vertex_count()}, edges: {graph.edge_count()}")], "line long, text string").union(slots)


def show_graph(graph: Graph, verbose: bool = False) -> None:
    """Counts, and the out-degree histogram if verbose."""
    lines = graph_lines(graph).orderBy("line")
    for row in (lines if verbose else lines.limit(1)).collect():  # 65 lines at most
        print(row["text"])
