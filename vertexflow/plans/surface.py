"""Queries over the rest of the engine's surface: files, dumps, subsets, loads, guards and the command line, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import algorithms, cli
from ..barrier import shared_folder
from ..functions import is_numeric
from ..graph import Graph
from ..operators import edge_filter, vertex_transform
from ..partition import deal
from ..sources import graph_lines, line_numbers, read_edge_list, read_metis, write_adjacency, write_edge_list, write_edges, write_metis, write_vertices
from ..subset import VertexSubset
from .catalog import CHAIN, SEQUENCE, SUPPLY, _levels, every_third, order_chain, part_sequence, supply, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of this application in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- files and dumps ------------------------------------------------------------------------------


def read_edge_list_round_trip(spark, d):
    g, path = part_sequence(spark, d), folder(spark, "edges")
    write_edge_list(g, path)
    back = read_edge_list(spark, path)
    g.release()
    return back.edges.select("src", "dst", "weight")


def read_edge_list_unsorted(spark, d):
    """Lines in the order of their ends, comments between them, no weights."""
    g, path = supply(spark, d), folder(spark, "unsorted")
    lines = g.edges.select("dst", F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    remarks = spark.createDataFrame([(-2, "# suppliers of parts"), (-1, f"{g.n} {g.edge_count()}"), (10**6, "# half way")], "dst long, value string")
    lines.unionByName(remarks).orderBy("dst").select("value").write.text(path)
    g.release()
    return read_edge_list(spark, path).edges.select("src", "dst", F.col("weight").isNull().alias("unweighted"))


def read_metis_round_trip(spark, d):
    """Adjacency file of the undirected supply graph; parts without lines are blank."""
    g = supply(spark, d)
    both, path = Graph.of(g.edges.select("src", "dst").union(g.edges.select("dst", "src")), g.n), folder(spark, "metis")
    write_metis(both, path)
    back = read_metis(spark, path)
    g.release()
    both.release()
    return back.edges.select("src", "dst")


def vertex_dump(spark, d):
    g, path = part_sequence(spark, d), folder(spark, "vertices")
    write_vertices(algorithms.printed(algorithms.bfs(g), "level"), "level", path)
    g.release()
    return line_numbers(spark, path)


def edge_dump(spark, d):
    g, path = part_sequence(spark, d), folder(spark, "edge-values")
    write_edges(g.edges, "weight", path)
    g.release()
    return line_numbers(spark, path)


def adjacency_dump(spark, d):
    g, path = supply(spark, d), folder(spark, "adjacency")
    write_adjacency(g, path)
    g.release()
    return line_numbers(spark, path)


def debug_dump(spark, d):
    return graph_lines(supply(spark, d))


def vertex_visit(spark, d):
    """The state of all vertices, visited on the driver a partition at a time."""
    n = total = most = 0
    for value in vertex_transform(part_sequence(spark, d).with_state(value=F.col("id") * 3), lambda row: row["value"]):
        n, total, most = n + 1, total + value, max(most, value)
    return spark.createDataFrame([(n, total, most)], "visited long, total long, most long")


# --- subsets and loads ----------------------------------------------------------------------------


def subset_empty(spark, d):
    n = table(spark, d, "part").count()
    return VertexSubset.empty(spark, n).flag(spark.range(n), "member")


def subset_universal(spark, d):
    return VertexSubset.universal(spark, table(spark, d, "part").count()).ids


def subset_sizes(spark, d):
    """Size, capacity and emptiness of subsets made in each way."""
    n = table(spark, d, "part").count()
    third = VertexSubset.of(spark.range(n).where("id % 3 = 0"), n).check()
    made = {"empty": VertexSubset.empty(spark, n), "universal": VertexSubset.universal(spark, n), "singleton": VertexSubset.singleton(spark, n, 7), "third": third, "cleared": third.clear()}
    return spark.createDataFrame([(k, s.size(), s.capacity(), s.is_empty()) for k, s in made.items()], "name string, size long, capacity long, is_empty boolean")


def subset_edit(spark, d):
    """Members after setting and unsetting; the original stays as it was."""
    n = table(spark, d, "part").count()
    old = VertexSubset(spark.range(n).where("id % 10 = 0"), n)
    new = old.add(7).add(20).remove(30)
    marked = old.flag(new.flag(spark.range(n), "after"), "before")
    held = [(7, new.contains(7)), (30, new.contains(30)), (20, new.contains(20))]
    return marked.join(F.broadcast(spark.createDataFrame(held, "id long, contained boolean")), "id", "left")


def dealt_step(spark, d):
    """A step over edges that were dealt by a partition strategy."""
    g = deal(part_sequence(spark, d), 4)
    return edge_filter(g, every_third(spark, g), lambda s, e: e["weight"], F.sum)


def graph_release(spark, d):
    """Edges held in memory before and after the release."""
    g = part_sequence(spark, d)
    held = [g.light.is_cached]
    g.release()
    return spark.createDataFrame([(held[0], g.light.is_cached, g.edge_count())], "held boolean, held_after boolean, edges long")


# --- loops, guards, functions, command line --------------------------------------------------------


def bfs_frontiers(spark, d):
    """What each pass of the search measured: the size of the frontier that it left."""
    g = part_sequence(spark, d)
    run = algorithms.bfs(g)
    g.release()
    return spark.createDataFrame([(s["pass"], s["measure"]) for s in run.steps], "pass long, frontier long")


def negative_cycle(spark, d):
    """Rings and chains of the regions with negative weights: a ring is refused, a chain has distances."""
    n = table(spark, d, "region").count()
    rows = []
    for name, m in (("chain", n - 1), ("ring", n)):
        g = Graph.of(spark.range(m).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), (F.col("id") - 3).cast("int").alias("weight")), n)
        try:
            last = algorithms.sssp(g).graph.vertices.agg(F.min("distance")).first()[0]
        except ValueError:
            last = None
        rows.append((name, last is None, last))
        g.release()
    return spark.createDataFrame(rows, "graph string, refused boolean, least long")


def numeric_strings(spark, d):
    parts = [F.col("c_name"), F.substring("c_name", -3, 3), F.col("c_custkey").cast("string"), F.lit("")]
    return table(spark, d, "customer").select("c_custkey", *(is_numeric(p).alias(f"n{k}") for k, p in enumerate(parts)))


def cli_bfs(spark, d):
    """The command line over a written edge list, its output read back."""
    g, path = part_sequence(spark, d), folder(spark, "cli")
    write_edge_list(g, path)
    g.release()
    cli.main(["bfs", path, "--output", f"{path}-levels", "--log", "ERROR"])
    return line_numbers(spark, f"{path}-levels")


def max_propagation_round_cap(spark, d):
    return algorithms.max_propagation(order_chain(spark, d), max_rounds=2).graph.vertices.select("id", "value")


QUERIES = {
    f.__name__: f
    for f in (
        read_edge_list_round_trip, read_edge_list_unsorted, read_metis_round_trip, vertex_dump, edge_dump, adjacency_dump, debug_dump, vertex_visit,
        subset_empty, subset_universal, subset_sizes, subset_edit, dealt_step, graph_release, bfs_frontiers, negative_cycle, numeric_strings, cli_bfs,
        max_propagation_round_cap,
    )
}

_DUMPED = _levels(SEQUENCE, 0, 12)
ORACLES = {
    "read_edge_list_round_trip": f"WITH {SEQUENCE} SELECT src, dst, w AS weight FROM e",
    "read_edge_list_unsorted": f"WITH {SUPPLY} SELECT src, dst, true AS unweighted FROM e",
    "read_metis_round_trip": f"WITH {SUPPLY} SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e",
    "vertex_dump": f"SELECT id AS line, CAST(level AS VARCHAR) AS value FROM ({_DUMPED})",
    "edge_dump": f"WITH {SEQUENCE} SELECT row_number() OVER (ORDER BY src, dst, CAST(w AS VARCHAR)) - 1 AS line, CAST(w AS VARCHAR) AS value FROM e",
    "adjacency_dump": f"""
WITH {SUPPLY} SELECT id AS line, concat_ws(' ', CAST(id AS VARCHAR), coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst), '')) AS value FROM v LEFT JOIN e ON src = id GROUP BY id
""",
    "debug_dump": f"""
WITH {SUPPLY}, d AS (SELECT CASE WHEN od IS NULL THEN 0 ELSE CAST(floor(log2(od)) AS BIGINT) + 1 END AS slot FROM v LEFT JOIN od ON src = id),
s AS (SELECT unnest(range((SELECT max(slot) + 1 FROM d))) AS slot)
SELECT CAST(0 AS BIGINT) AS line, 'Nodes: ' || (SELECT count(*) FROM v) || ', edges: ' || (SELECT count(*) FROM e) AS text
UNION ALL SELECT s.slot + 1, 'slot ' || s.slot || ': ' || count(d.slot) FROM s LEFT JOIN d USING (slot) GROUP BY s.slot
""",
    "vertex_visit": "SELECT count(*) AS visited, CAST(sum(p_partkey * 3) AS BIGINT) AS total, CAST(max(p_partkey * 3) AS BIGINT) AS most FROM part",
    "subset_empty": "SELECT p_partkey AS id, false AS member FROM part",
    "subset_universal": "SELECT p_partkey AS id FROM part",
    "subset_sizes": """
WITH n AS (SELECT count(*) AS n, count(CASE WHEN p_partkey % 3 = 0 THEN 1 END) AS third FROM part)
SELECT name, CAST(size AS BIGINT) AS size, n AS capacity, size = 0 AS is_empty FROM n,
LATERAL (VALUES ('empty', 0), ('universal', n), ('singleton', 1), ('third', third), ('cleared', 0)) x(name, size)
""",
    "subset_edit": """
SELECT p_partkey AS id, p_partkey % 10 = 0 AS before, p_partkey = 7 OR p_partkey % 10 = 0 AND p_partkey <> 30 AS after,
CASE p_partkey WHEN 7 THEN true WHEN 20 THEN true WHEN 30 THEN false END AS contained FROM part
""",
    "dealt_step": f"WITH {SEQUENCE} SELECT dst AS id, CAST(sum(w) AS BIGINT) AS acc FROM e WHERE src % 3 = 0 GROUP BY dst",
    "graph_release": f"WITH {SEQUENCE} SELECT true AS held, false AS held_after, count(*) AS edges FROM e",
    "bfs_frontiers": f"""
WITH l AS ({_DUMPED}), k AS (SELECT CAST(unnest(range(1, (SELECT max(level) + 2 FROM l WHERE level < 2147483647))) AS BIGINT) AS pass)
SELECT pass, (SELECT count(*) FROM l WHERE level = pass) AS frontier FROM k
""",
    "negative_cycle": """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM region), p(id, d) AS (SELECT 0, 0 UNION ALL SELECT id + 1, d + id - 3 FROM p, n WHERE id < n.n - 1)
SELECT 'chain' AS graph, false AS refused, CAST(min(d) AS BIGINT) AS least FROM p
UNION ALL SELECT 'ring', sum(r_regionkey - 3) < 0, NULL FROM region
""",
    "numeric_strings": """
SELECT c_custkey, regexp_full_match(c_name, '[0-9]*') AS n0, regexp_full_match(right(c_name, 3), '[0-9]*') AS n1,
regexp_full_match(CAST(c_custkey AS VARCHAR), '[0-9]*') AS n2, true AS n3 FROM customer
""",
    "max_propagation_round_cap": f"""
WITH RECURSIVE {CHAIN}, r(src, id, k) AS (SELECT id, id, 0 FROM v UNION ALL SELECT r.src, e.dst, k + 1 FROM r JOIN e ON e.src = r.id WHERE k < 3)
SELECT id, max(src) AS value FROM r GROUP BY id
""",
    "cli_bfs": f"SELECT id AS line, CAST(level AS VARCHAR) AS value FROM ({_DUMPED})",
}
