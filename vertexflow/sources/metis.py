"""Adjacency files of the DIMACS / METIS kind: `n m`, then line k lists the 1-based neighbours of vertex k."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from .edge_list import after, first_line, numbered_lines, single_spaced, with_numbers


def read_metis(spark: SparkSession, path: str, check: bool = True) -> Graph:
    """The directed graph of an adjacency file; m counts undirected edges, so 2 m neighbours are expected.

    A blank line is a vertex without neighbours, missing lines at the end are such vertices, `#` and `%` start comment
    lines, `#` also ends a line. Weighted formats (a third number in the header) are refused. Lines are numbered
    from counts per split of the file, which are few, and positions within them; no partition holds all lines.
    """
    lines = numbered_lines(spark, path, blank=True).withColumn("value", F.when(F.contains("value", F.lit("#")), F.regexp_replace("value", "#.*$", "")).otherwise(F.col("value")))
    first = first_line(lines.where(F.trim("value") != ""))
    if first is None:
        raise ValueError(f"{path} has no header")
    head = first["value"].split()
    if len(head) > 2 and head[2].strip("0"):
        raise ValueError("weighted formats are not supported")
    if len(head) < 2 or not all(h.isdigit() for h in head[:2]):
        raise ValueError(f"malformed header {first['value']!r}")
    n, m = int(head[0]), int(head[1])
    rows = lines.where(after(first))
    vertex = with_numbers(rows).select(F.col("line").alias("src"), "value")
    edges = vertex.where(F.trim("value") != "").select("src", F.explode(F.split(single_spaced("value"), " ")).alias("x"))
    edges = edges.select("src", (F.col("x").try_cast("long") - 1).alias("dst"))
    if not check:
        return Graph.of(edges, n)
    edges = edges.persist()  # the lines are read and split once: the check and the graph share what it keeps
    try:
        wrong = F.col("dst").isNull() | (F.col("dst") < 0) | (F.col("dst") >= n)
        found = edges.agg(F.count("*").alias("m"), F.count(F.when(wrong, 1)).alias("wrong"), F.max("src").alias("last")).first()
        if found["m"] and found["last"] >= n:
            raise ValueError(f"more than {n} lines of neighbours")
        if found["wrong"]:
            raise ValueError(f"{found['wrong']} neighbours are malformed or outside 1..{n}")
        if found["m"] != 2 * m:
            raise ValueError(f"{found['m']} neighbours, but the header says 2 x {m}")
        return Graph.of(edges, n, stage=False)
    finally:
        edges.unpersist()


def write_metis(graph: Graph, path: str) -> None:
    """The adjacency file of a symmetric graph without loops as range-sorted files in the folder `path`, in name order."""
    header = graph.spark.createDataFrame([(-1, f"{graph.n} {graph.edge_count() // 2}")], "id long, value string")
    texts = graph.adjacency(1).select("id", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("value"))
    graph.write_in_order(header.union(texts), path)
