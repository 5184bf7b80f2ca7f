"""Expansion along edges."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import OUT_DEGREE, Graph
from ..subset import VertexSubset

_SOURCE = "_s_"


class Columns(Mapping):
    """Names to columns, with a prefix where both sides have the name."""

    def __init__(self, names: dict[str, str]):
        self._names = names

    def __getitem__(self, name: str) -> Column:
        return F.col(self._names[name])

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


Gather = Callable[[Columns, Columns], Column]
Reduce = Callable[[Column], Column] | dict[str, Callable[[Column], Column]]


#: A frontier of at most so many vertices is sent to the edges, a larger one meets them in the partitions of their sources.
BROADCAST_ROWS = 100_000


def _expanded(graph: Graph, subset: VertexSubset | None) -> tuple[DataFrame, Columns, Columns]:
    """Edges whose source is in the subset, with the state of the source."""
    active = subset.restrict(graph.vertices) if subset else graph.vertices
    state = active.select(F.col("id").alias("src"), *(F.col(c).alias(_SOURCE + c) for c in active.columns if c != "id"))
    few = subset is not None and subset.known_size is not None and subset.known_size <= BROADCAST_ROWS
    joined = graph.light.join(F.broadcast(state) if few else state, "src")
    if graph.heavy is not None:
        hub_state = state.join(F.broadcast(graph.hubs.select("src")), "src", "left_semi")
        joined = joined.unionByName(graph.heavy.join(F.broadcast(hub_state), "src"))
    source = Columns({c: _SOURCE + c for c in active.columns if c != "id"} | {"id": "src", OUT_DEGREE: OUT_DEGREE})
    return joined, source, Columns({c: c for c in graph.light.columns})


def _accumulate(expanded: DataFrame, value: Column, reduce: Reduce) -> DataFrame:
    aggregates = reduce if isinstance(reduce, dict) else {"acc": reduce}
    sent = expanded.select(F.col("dst").alias("id"), value.alias("_value"))
    return sent.groupBy("id").agg(*(f(F.col("_value")).alias(k) for k, f in aggregates.items()))


def edge_filter(graph: Graph, frontier: VertexSubset, gather: Gather, reduce: Reduce) -> DataFrame:
    """Messages (id, acc) to all out-neighbours of the frontier: gather along each edge, reduce at its end.

    The frontier joins the edges, so the work follows the edges that leave it. Reduce is an aggregate function, combined
    before the shuffle where Spark can (all built-in ones; grouped Python aggregates cannot), or several by name.
    """
    expanded, source, edge = _expanded(graph, frontier)
    return _accumulate(expanded, gather(source, edge), reduce)


def edge_map(graph: Graph, gather: Gather, reduce: Reduce, subset: VertexSubset | None = None) -> DataFrame:
    """Messages along all edges that leave the subset (all vertices by default); no new subset is made."""
    expanded, source, edge = _expanded(graph, subset)
    return _accumulate(expanded, gather(source, edge), reduce)


def edge_update(graph: Graph, changes: Callable[[Columns, Columns], dict[str, Column]], subset: VertexSubset | None = None) -> Graph:
    """New attributes for the edges that leave the subset; other edges keep theirs (null where they had none)."""
    vertices, edges = graph.vertices, graph.light
    if subset is not None:
        vertices = subset.flag(vertices, "_member")
    state = vertices.select(F.col("id").alias("src"), *(F.col(c).alias(_SOURCE + c) for c in vertices.columns if c != "id"))
    source = Columns({c: _SOURCE + c for c in vertices.columns if c != "id"} | {"id": "src", OUT_DEGREE: OUT_DEGREE})
    new = changes(source, Columns({c: c for c in edges.columns}))
    if subset is not None:
        new = {k: F.when(F.col(_SOURCE + "_member"), v).otherwise(F.col(k) if k in edges.columns else F.lit(None)) for k, v in new.items()}
    kept = [F.col(c) for c in edges.columns if c not in new]

    def change(part: DataFrame) -> DataFrame:
        met = state if part is graph.light else F.broadcast(state.join(F.broadcast(graph.hubs.select("src")), "src", "left_semi"))
        joined = part.join(met, "src").withColumns({"_new_" + k: v for k, v in new.items()})
        return joined.select(*kept, *(F.col("_new_" + k).alias(k) for k in new))

    return graph.with_edges(change)
