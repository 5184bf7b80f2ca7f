"""Readers and writers of graph files."""

from .edge_list import line_numbers, read_edge_list, write_edge_list
from .metis import read_metis, write_metis
from .sinks import graph_lines, show_graph, write_adjacency, write_edges, write_vertices

__all__ = ["graph_lines", "line_numbers", "read_edge_list", "read_metis", "show_graph", "write_adjacency", "write_edge_list", "write_edges", "write_metis", "write_vertices"]
