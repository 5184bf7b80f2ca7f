"""Contraction into vertex state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..graph import Graph
from ..subset import VertexSubset
from .edges import Columns

HIT = "_hit"
Update = Callable[[Columns], dict[str, Column]]


def _with_messages(graph: Graph, messages: DataFrame | None, default: Column | None) -> tuple[DataFrame, list[str], Columns]:
    """Vertices with acc (the default where no message came) and _got."""
    state = [c for c in graph.vertices.columns if c not in ("id", HIT)]
    df = graph.vertices.select("id", *state)
    if messages is None:
        df = df.withColumn("acc", default if default is not None else F.lit(None)).withColumn("_got", F.lit(False))
    else:
        df = df.join(messages.withColumn("_got", F.lit(True)), "id", "left").withColumn("_got", F.coalesce("_got", F.lit(False)))
        if default is not None:
            df = df.withColumn("acc", F.coalesce("acc", default))
    return df, state, Columns({c: c for c in df.columns})


def _changed(df: DataFrame, state: list[str], where: Column, new: dict[str, Column], keep_hit: bool) -> DataFrame:
    df = df.withColumn(HIT, F.coalesce(where, F.lit(False)))
    columns = [F.when(F.col(HIT), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in state]
    added = [F.when(F.col(HIT), v).alias(k) for k, v in new.items() if k not in state]
    return df.select("id", *columns, *added, *([HIT] if keep_hit else []))


def vertex_filter(graph: Graph, messages: DataFrame, cond: Callable[[Columns], Column], update: Update) -> Graph:
    """Vertices that got a message and meet cond are updated; they are the next frontier (`frontier_of`)."""
    df, state, v = _with_messages(graph, messages, None)
    return graph.with_vertices(_changed(df, state, F.col("_got") & cond(v), update(v), True))


def activate(graph: Graph, cond: Callable[[Columns], Column], update: Update) -> Graph:
    """All vertices that meet cond are updated, without messages; they are the next frontier."""
    df, state, v = _with_messages(graph, None, None)
    return graph.with_vertices(_changed(df, state, cond(v), update(v), True))


def frontier_of(graph: Graph, size: int | None = None) -> VertexSubset:
    """The vertices that the last step updated; size, where it is known, lets a small frontier be sent to the edges."""
    return VertexSubset(graph.vertices.where(HIT).select("id"), graph.n, size)


def vertex_map(graph: Graph, update: Update, subset: VertexSubset | None = None, messages: DataFrame | None = None, default: Column | None = None) -> Graph:
    """Updates the vertices of the subset (all by default: a projection); acc is the default where no message came."""
    df, state, v = _with_messages(graph, messages, default)
    where = F.lit(True)
    if subset is not None:
        df, where = subset.flag(df, "_member"), F.col("_member")
    return graph.with_vertices(_changed(df, state, where, update(v), False))


def vertex_reduce(graph: Graph, aggregate: Column) -> DataFrame:
    """One row (acc) over all vertices, as a partial and a final aggregate."""
    return graph.vertices.agg(aggregate.alias("acc"))


def vertex_transform(graph: Graph, visit: Callable[[Row], object] | None = None) -> Iterator:
    """Visits the state of all vertices on the driver, a partition at a time."""
    rows = graph.vertices.drop(HIT).toLocalIterator()
    return map(visit, rows) if visit else rows
