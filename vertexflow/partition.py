"""Partition strategies and what they cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import hash_code
from .graph import Graph

Strategy = Callable[[Column, int], Column]


def random_edge_cut(vertex: Column, parts: int) -> Column:
    """The part of a vertex: its hash code modulo the number of parts."""
    return F.pmod(hash_code(vertex), F.lit(parts)).cast("int")


def assign(graph: Graph, parts: int, strategy: Strategy = random_edge_cut) -> DataFrame:
    """(id, part) of all vertices."""
    return graph.vertices.select("id", strategy(F.col("id"), parts).alias("part"))


def part_sizes(graph: Graph, parts: int, strategy: Strategy = random_edge_cut) -> DataFrame:
    """(part, vertices)."""
    return assign(graph, parts, strategy).groupBy("part").agg(F.count("*").alias("vertices"))


def cut_edges(graph: Graph, parts: int, strategy: Strategy = random_edge_cut) -> DataFrame:
    """(src_part, dst_part, edges) of edges between different parts: the sizes that message boxes would need."""
    ends = graph.edges.select(strategy(F.col("src"), parts).alias("src_part"), strategy(F.col("dst"), parts).alias("dst_part"))
    return ends.where("src_part <> dst_part").groupBy("src_part", "dst_part").agg(F.count("*").alias("edges"))


#: The most edges of one part that one task gets.
DEALT_EDGES = 2_000_000


def deal(graph: Graph, parts: int, strategy: Strategy = random_edge_cut, most: int = DEALT_EDGES) -> Graph:
    """The graph with its edges dealt to Spark partitions by the part of their source.

    No partition holds edges of two parts. Where a part's even share is more than `most` edges, each part has several partitions, dealt by both ends.
    """
    pieces = max(1, -(-graph.edge_count() // (parts * most)))
    at = F.coalesce(strategy(F.col("src"), parts), F.lit(0)) * pieces + F.pmod(F.xxhash64("src", "dst"), F.lit(pieces)).cast("int")
    return graph.with_edges(lambda edges: edges.repartitionById(parts * pieces, at))
