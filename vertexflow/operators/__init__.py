"""Edge and vertex operators.

Functions over edges get two accessors: of the source vertex's state (`s["level"]`, and `s["outdeg"]`) and of the edge's attributes
(`e["weight"]`). Functions over vertices get one: state columns, `v["id"]`, and `v["acc"]`, the accumulated message.
"""

from .edges import edge_filter, edge_map, edge_update
from .vertices import activate, vertex_filter, vertex_map, vertex_reduce, vertex_transform

__all__ = ["activate", "edge_filter", "edge_map", "edge_update", "vertex_filter", "vertex_map", "vertex_reduce", "vertex_transform"]
