"""Command line: python -m vertexflow.cli bfs FILE --source 0"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import SparkSession

from . import algorithms
from .sources import read_edge_list, read_metis, show_graph, write_vertices

LEVELS = ["CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vertexflow")
    p.add_argument("command", choices=["bfs", "sssp", "pagerank", "max", "stats"])
    p.add_argument("file")
    p.add_argument("--source", type=int, default=0)
    p.add_argument("--rounds", type=int, default=None, help="cap; one more pass than this is made")
    p.add_argument("--damping", type=float, default=0.85)
    p.add_argument("--epsilon", type=float, default=1e-7)
    p.add_argument("--metis", action="store_true", help="the file lists neighbours by vertex")
    p.add_argument("--unit-weights", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--output", help="folder for the vertex values")
    p.add_argument("--log", choices=LEVELS, default="INFO")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log)
    spark = SparkSession.builder.appName(f"vertexflow {a.command}").getOrCreate()
    graph = read_metis(spark, a.file) if a.metis else read_edge_list(spark, a.file, unit_weights=a.unit_weights)
    if a.command == "stats":
        show_graph(graph, a.verbose)
        return 0
    began = time.perf_counter()
    run, column = {
        "bfs": lambda: (algorithms.bfs(graph, a.source, a.rounds), "level"),
        "sssp": lambda: (algorithms.sssp(graph, a.source, a.unit_weights, a.rounds), "distance"),
        "pagerank": lambda: (algorithms.pagerank(graph, a.damping, a.epsilon, algorithms.capped(a.rounds)), "rank"),
        "max": lambda: (algorithms.max_propagation(graph, max_rounds=a.rounds), "value"),
    }[a.command]()
    print(f"{a.command}: {run.passes} passes, {run.iterations} iterations, {time.perf_counter() - began:.2f} s")
    if a.verbose:
        for step in run.steps:
            print(f"  pass {step['pass']}: {step['measure']}, {step['seconds']:.2f} s")
    result = run.graph.vertices if column == "rank" else algorithms.printed(run, column)
    if a.output:
        write_vertices(result, column, a.output)
    else:
        result.select("id", column).orderBy("id").show(20)
    graph.release()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
