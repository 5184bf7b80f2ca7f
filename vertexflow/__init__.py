"""Frontier-based graph analytics on Spark DataFrames."""

from .graph import Graph
from .subset import VertexSubset

__all__ = ["Graph", "VertexSubset"]
