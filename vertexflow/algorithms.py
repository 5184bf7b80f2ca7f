"""Breadth-first search, shortest paths, PageRank and maximum propagation as loops of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .loop import Run, iterate
from .operators import edge_filter, edge_map, vertex_filter, vertex_map, vertex_reduce
from .operators.vertices import HIT, frontier_of

#: Printed for what no path reaches; inside, it is null.
INFINITY = 2147483647


def capped(max_rounds: int | None) -> int | None:
    """The passes that a cap of so many rounds allows: the cap is tested after a pass, so one more than its number."""
    return None if max_rounds is None else max_rounds + 1


def _frontier_done(graph: Graph) -> tuple[bool, int]:
    size = graph.vertices.where(HIT).count()
    return size == 0, size


def _from_source(graph: Graph, source: int, column: str, kind: str) -> Graph:
    if not 0 <= source < graph.n:
        raise ValueError(f"source {source} is not in 0..{graph.n - 1}")
    at = F.col("id") == source
    return graph.with_state(**{column: F.when(at, F.lit(0)).cast(kind), HIT: at})


def bfs(graph: Graph, source: int = 0, max_rounds: int | None = None) -> Run:
    """level: the number of edges from the source, null where it does not reach. Uncapped by default."""

    def step(g: Graph, size) -> Graph:
        messages = edge_filter(g, frontier_of(g, 1 if size is None else size), lambda s, e: s["level"] + 1, F.min)
        return vertex_filter(g, messages, lambda v: v["level"].isNull(), lambda v: {"level": v["acc"]})

    return iterate(_from_source(graph, source, "level", "int"), step, _frontier_done, capped(max_rounds))


def sssp(graph: Graph, source: int = 0, unit_weights: bool = False, max_rounds: int | None = None) -> Run:
    """distance: the least sum of weights from the source, null where it does not reach.

    unit_weights counts edges instead; a null weight counts 1. A frontier that is left after n passes has a cycle of negative weight: raises.
    """
    weight = (lambda e: F.lit(1)) if unit_weights or "weight" not in graph.light.columns else (lambda e: F.coalesce(e["weight"], F.lit(1)))

    def step(g: Graph, size) -> Graph:
        messages = edge_filter(g, frontier_of(g, 1 if size is None else size), lambda s, e: s["distance"] + weight(e), F.min)
        return vertex_filter(g, messages, lambda v: v["distance"].isNull() | (v["distance"] > v["acc"]), lambda v: {"distance": v["acc"]})

    passes = 0

    def done(g: Graph) -> tuple[bool, int]:
        nonlocal passes
        passes += 1
        stop, size = _frontier_done(g)
        if not stop and passes >= graph.n:
            raise ValueError("a cycle of negative weight is reachable")
        return stop, size

    return iterate(_from_source(graph, source, "distance", "long"), step, done, capped(max_rounds))


def pagerank(graph: Graph, damping: float = 0.85, epsilon: float | None = 1e-7, max_passes: int | None = None) -> Run:
    """rank and delta. Ranks of vertices without out-edges are not passed on. Ends when the sum of |delta| is below epsilon."""
    if epsilon is None and max_passes is None:
        raise ValueError("give epsilon, max_passes or both")
    start = F.lit(1.0 / max(graph.n, 1))

    def step(g: Graph, _) -> Graph:
        messages = edge_map(g, lambda s, e: s["rank"] / s["outdeg"], F.sum)
        new = lambda v: damping * v["acc"] + F.lit((1.0 - damping) / g.n)
        return vertex_map(g, lambda v: {"rank": new(v), "delta": new(v) - v["rank"]}, messages=messages, default=F.lit(0.0))

    def done(g: Graph) -> tuple[bool, float]:
        if epsilon is None:
            return False, None
        error = vertex_reduce(g, F.sum(F.abs("delta"))).first()["acc"] or 0.0
        return error < epsilon, error

    return iterate(graph.with_state(rank=start, delta=start), step, done, max_passes)


def max_propagation(graph: Graph, value: Column | None = None, max_rounds: int | None = None) -> Run:
    """value: the largest of the values of the vertices that reach a vertex, its own included."""

    def step(g: Graph, size) -> Graph:
        messages = edge_filter(g, frontier_of(g, size), lambda s, e: s["value"], F.max)
        return vertex_filter(g, messages, lambda v: v["value"] < v["acc"], lambda v: {"value": v["acc"]})

    start = value if value is not None else F.col("id")
    return iterate(graph.with_state(value=start, **{HIT: F.lit(True)}), step, _frontier_done, capped(max_rounds))


def printed(run: Run, column: str) -> DataFrame:
    """(id, column) with the printed infinity for what is not reached."""
    return run.graph.vertices.select("id", F.coalesce(F.col(column), F.lit(INFINITY)).alias(column))
