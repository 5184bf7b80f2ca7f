"""Named queries of the engine over graphs derived from the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import algorithms, partition
from ..functions import hash_code
from ..graph import Graph
from ..operators import activate, edge_filter, edge_map, edge_update, vertex_filter, vertex_map, vertex_reduce
from ..operators.vertices import HIT
from ..subset import VertexSubset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- graphs ---------------------------------------------------------------------------------------


def part_sequence(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts; an edge from each line of an order to the next one, weighted by the quantity. Loops and parallel edges occur."""
    lines = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    edges = lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").cast("int").alias("weight"))
    return Graph.of(edges.where("dst IS NOT NULL"), table(spark, sf_dir, "part").count())


SEQUENCE = """
e AS (SELECT l_partkey AS src, dst, CAST(l_quantity AS INTEGER) AS w FROM (
  SELECT l_partkey, l_quantity, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst
  FROM lineitem) WHERE dst IS NOT NULL),
v AS (SELECT p_partkey AS id FROM part),
od AS (SELECT src, count(*) AS od FROM e GROUP BY src)
"""


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, then suppliers; distinct edges from parts to their suppliers. Suppliers have no out-edges, parts no in-edges."""
    n = table(spark, sf_dir, "part").count()
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst")).distinct()
    return Graph.of(edges, n + table(spark, sf_dir, "supplier").count())


SUPPLY = """
p AS (SELECT count(*) AS n FROM part),
e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + p.n AS dst FROM lineitem, p),
v AS (SELECT p_partkey AS id FROM part UNION ALL SELECT s_suppkey + p.n FROM supplier, p),
od AS (SELECT src, count(*) AS od FROM e GROUP BY src)
"""


def order_chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders; an edge from each to the same customer's next one."""
    orders = table(spark, sf_dir, "orders")
    after = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    edges = orders.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(after).alias("dst")).where("dst IS NOT NULL")
    return Graph.of(edges, orders.count())


CHAIN = """
e AS (SELECT src, dst FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL),
v AS (SELECT o_orderkey AS id FROM orders),
od AS (SELECT src, count(*) AS od FROM e GROUP BY src)
"""


def every_third(spark: SparkSession, graph: Graph, rest: int = 0) -> VertexSubset:
    return VertexSubset(spark.range(graph.n).where(F.col("id") % 3 == rest), graph.n)


# --- graph statistics -----------------------------------------------------------------------------


def load_edges(spark, d):
    return part_sequence(spark, d).edges.select("src", "dst", "weight")


def graph_counts(spark, d):
    g = part_sequence(spark, d)
    return g.edges.agg(F.count("*").alias("edges")).select(F.lit(g.vertex_count()).cast("long").alias("vertices"), "edges")


def out_degree(spark, d):
    return supply(spark, d).out_degrees()


def degree_histogram(spark, d):
    h = supply(spark, d).degree_histogram()
    return h.select("slot", "vertices", F.round("percent", 9).alias("percent"))


def adjacency(spark, d):
    g = supply(spark, d)
    return g.adjacency().select("id", F.concat_ws(",", F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours"))


# --- operators ------------------------------------------------------------------------------------


def edge_filter_step(spark, d):
    g = part_sequence(spark, d)
    reduces = {"least": F.min, "total": F.sum, "most": F.max}
    return edge_filter(g, every_third(spark, g), lambda s, e: s["id"] + e["weight"], reduces)


def vertex_filter_step(spark, d):
    g = part_sequence(spark, d).with_state(value=F.col("id"))
    messages = edge_filter(g, every_third(spark, g), lambda s, e: s["value"] + e["weight"], F.min)
    out = vertex_filter(g, messages, lambda v: v["acc"] < v["value"], lambda v: {"value": v["acc"]})
    return out.vertices.select("id", "value", F.col(HIT).alias("active"))


def edge_map_sum(spark, d):
    g = supply(spark, d).with_state(rank=F.lit(1.0))
    sums = edge_map(g, lambda s, e: s["rank"] / s["outdeg"], F.sum)
    return sums.select("id", F.round("acc", 9).alias("acc"))


def edge_map_set_weight(spark, d):
    g = part_sequence(spark, d).with_state(bonus=F.col("id") % 5)
    out = edge_update(g, lambda s, e: {"weight": (e["weight"] * 2 + s["bonus"]).cast("int")}, every_third(spark, g, 1))
    return out.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def vertex_map_all(spark, d):
    g = part_sequence(spark, d).with_state(value=F.col("id"))
    messages = edge_map(g, lambda s, e: e["weight"], F.max, every_third(spark, g))
    return vertex_map(g, lambda v: {"value": v["value"] * 10 + v["acc"]}, messages=messages, default=F.lit(-1)).vertices


def vertex_map_subset(spark, d):
    g = part_sequence(spark, d).with_state(value=F.col("id"))
    return vertex_map(g, lambda v: {"value": -v["value"]}, every_third(spark, g, 2)).vertices


def vertex_activate(spark, d):
    g = part_sequence(spark, d).with_state(value=F.col("id"))
    return activate(g, lambda v: v["value"] % 7 == 0, lambda v: {"value": v["value"] + 1}).vertices.select("id", "value", F.col(HIT).alias("active"))


def vertex_sum(spark, d):
    g = part_sequence(spark, d).with_state(value=F.col("id"))
    return vertex_reduce(g, F.sum(F.abs(F.col("value") - 50)))


def subset_pair(spark, d):
    n = table(spark, d, "part").count()
    return VertexSubset(spark.range(n).where("id % 2 = 0"), n), VertexSubset(spark.range(n).where("id % 3 = 0"), n)


def subset_and(spark, d):
    a, b = subset_pair(spark, d)
    return (a & b).ids


def subset_or(spark, d):
    a, b = subset_pair(spark, d)
    return (a | b).ids


def subset_xor(spark, d):
    a, b = subset_pair(spark, d)
    return (a ^ b).ids


def subset_singleton(spark, d):
    n = table(spark, d, "part").count()
    return VertexSubset.singleton(spark, n, 7).flag(spark.range(n), "member")


def hash_partition(spark, d):
    g = part_sequence(spark, d)
    return g.vertices.select("id", hash_code("id").alias("code"), partition.random_edge_cut(F.col("id"), 4).alias("part"))


def partition_sizes(spark, d):
    return partition.part_sizes(part_sequence(spark, d), 4)


def edge_cut_stats(spark, d):
    return partition.cut_edges(part_sequence(spark, d), 4)


# --- algorithms -----------------------------------------------------------------------------------


def bfs(spark, d):
    return algorithms.printed(algorithms.bfs(part_sequence(spark, d)), "level")


def bfs_round_cap(spark, d):
    return algorithms.printed(algorithms.bfs(part_sequence(spark, d), max_rounds=1), "level")


def bfs_bipartite(spark, d):
    return algorithms.printed(algorithms.bfs(supply(spark, d), source=3), "level")


def sssp_weighted(spark, d):
    return algorithms.printed(algorithms.sssp(part_sequence(spark, d)), "distance")


def sssp_unit(spark, d):
    return algorithms.printed(algorithms.sssp(part_sequence(spark, d), unit_weights=True), "distance")


def _ranks(run):
    return run.graph.vertices.select("id", F.round("rank", 9).alias("rank"))


def pagerank_10(spark, d):
    return _ranks(algorithms.pagerank(part_sequence(spark, d), epsilon=None, max_passes=10))


def pagerank_dangling(spark, d):
    return _ranks(algorithms.pagerank(supply(spark, d), epsilon=None, max_passes=4))


def pagerank_converged(spark, d):
    return run_ranks(algorithms.pagerank(part_sequence(spark, d)))


def run_ranks(run):
    """Six decimals: the passes of an oracle that runs on differ by less than the tolerance."""
    return run.graph.vertices.select("id", F.round("rank", 6).alias("rank"))


def max_propagation(spark, d):
    g = order_chain(spark, d)
    found = algorithms.max_propagation(g).graph.vertices.select("id", "value")
    g.release()
    return found


def max_propagation_fixpoint(spark, d):
    return algorithms.max_propagation(part_sequence(spark, d), value=(F.col("id") * 37) % 1000).graph.vertices.select("id", "value")


QUERIES = {
    f.__name__: f
    for f in (
        load_edges, graph_counts, out_degree, degree_histogram, adjacency, edge_filter_step, vertex_filter_step, edge_map_sum,
        edge_map_set_weight, vertex_map_all, vertex_map_subset, vertex_activate, vertex_sum, subset_and, subset_or, subset_xor, subset_singleton,
        hash_partition, partition_sizes, edge_cut_stats, bfs, bfs_round_cap, bfs_bipartite, sssp_weighted, sssp_unit, pagerank_10, pagerank_dangling,
        pagerank_converged, max_propagation, max_propagation_fixpoint,
    )
}

# --- SQL ------------------------------------------------------------------------------------------

_CODE = """
h1 AS (SELECT id, xor(id, id << 13) AS x FROM v), h2 AS (SELECT id, xor(x, x >> 17) AS x FROM h1), h AS (SELECT id, xor(x, x << 5) AS code FROM h2)
"""


def _levels(graph: str, source: int, bound: int) -> str:
    """Breadth-first levels; the recursion keeps distinct (vertex, level) rows up to a bound."""
    return f"""
WITH RECURSIVE {graph}, r(id, l) AS (SELECT CAST({source} AS BIGINT), 0 UNION SELECT e.dst, l + 1 FROM r JOIN e ON e.src = r.id WHERE l < {bound})
SELECT v.id, CAST(coalesce(min(l), 2147483647) AS INTEGER) AS level FROM v LEFT JOIN r USING (id) GROUP BY v.id
"""


def _distances(weight: str) -> str:
    """Least distances; a vertex keeps its best row by key."""
    return f"""
WITH RECURSIVE {SEQUENCE}, r(id, d) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT x.id, x.d FROM (SELECT e.dst AS id, CAST(min(r.d + {weight}) AS BIGINT) AS d FROM r JOIN e ON e.src = r.id GROUP BY e.dst) x
  LEFT JOIN recurring.r o ON o.id = x.id WHERE o.id IS NULL OR x.d < o.d)
SELECT v.id, coalesce(d, 2147483647) AS distance FROM v LEFT JOIN r USING (id)
"""


def _pagerank(graph: str, passes: int, digits: int) -> str:
    return f"""
WITH RECURSIVE {graph}, n AS (SELECT count(*) AS n FROM v),
r(i, id, rank) AS (SELECT 0, id, 1.0::DOUBLE / n.n FROM v, n UNION ALL
  SELECT k.i + 1, v.id, 0.85 * coalesce(s.s, 0) + 0.15::DOUBLE / n.n FROM v CROSS JOIN n CROSS JOIN (SELECT max(i) AS i FROM r) k
  LEFT JOIN (SELECT e.dst, sum(r.rank / od.od) AS s FROM r JOIN e ON e.src = r.id JOIN od ON od.src = e.src GROUP BY e.dst) s ON s.dst = v.id
  WHERE k.i < {passes})
SELECT id, round(rank, {digits}) AS rank FROM r WHERE i = {passes}
"""


ORACLES = {
    "load_edges": f"WITH {SEQUENCE} SELECT src, dst, w AS weight FROM e",
    "graph_counts": f"WITH {SEQUENCE} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges",
    "out_degree": f"WITH {SUPPLY} SELECT id, coalesce(od, 0) AS outdeg FROM v LEFT JOIN od ON src = id",
    "degree_histogram": f"""
WITH {SUPPLY}, d AS (SELECT CASE WHEN od IS NULL THEN 0 ELSE CAST(floor(log2(od)) AS INTEGER) + 1 END AS slot FROM v LEFT JOIN od ON src = id),
s AS (SELECT CAST(unnest(range((SELECT max(slot) + 1 FROM d))) AS INTEGER) AS slot)
SELECT s.slot, count(d.slot) AS vertices, round(100.0 * count(d.slot) / (SELECT count(*) FROM v), 9) AS percent FROM s LEFT JOIN d USING (slot) GROUP BY s.slot
""",
    "adjacency": f"WITH {SUPPLY} SELECT id, coalesce(string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst), '') AS neighbours FROM v LEFT JOIN e ON src = id GROUP BY id",
    "edge_filter_step": f"WITH {SEQUENCE} SELECT dst AS id, min(src + w) AS least, CAST(sum(src + w) AS BIGINT) AS total, max(src + w) AS most FROM e WHERE src % 3 = 0 GROUP BY dst",
    "vertex_filter_step": f"""
WITH {SEQUENCE}, m AS (SELECT dst AS id, min(src + w) AS acc FROM e WHERE src % 3 = 0 GROUP BY dst)
SELECT v.id, CASE WHEN acc < v.id THEN acc ELSE v.id END AS value, coalesce(acc < v.id, false) AS active FROM v LEFT JOIN m USING (id)
""",
    "edge_map_sum": f"WITH {SUPPLY} SELECT dst AS id, round(sum(1.0::DOUBLE / od), 9) AS acc FROM e JOIN od USING (src) GROUP BY dst",
    "edge_map_set_weight": f"""
WITH {SEQUENCE} SELECT src, dst, count(*) AS n, CAST(sum(CASE WHEN src % 3 = 1 THEN w * 2 + src % 5 ELSE w END) AS BIGINT) AS weight FROM e GROUP BY src, dst
""",
    "vertex_map_all": f"WITH {SEQUENCE}, m AS (SELECT dst AS id, max(w) AS acc FROM e WHERE src % 3 = 0 GROUP BY dst) SELECT v.id, v.id * 10 + coalesce(acc, -1) AS value FROM v LEFT JOIN m USING (id)",
    "vertex_map_subset": "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN -p_partkey ELSE p_partkey END AS value FROM part",
    "vertex_activate": "SELECT p_partkey AS id, p_partkey + (CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END) AS value, p_partkey % 7 = 0 AS active FROM part",
    "vertex_sum": "SELECT CAST(sum(abs(p_partkey - 50)) AS BIGINT) AS acc FROM part",
    "subset_and": "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_partkey FROM part WHERE p_partkey % 3 = 0",
    "subset_or": "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 3 = 0",
    "subset_xor": "SELECT p_partkey AS id FROM part WHERE (p_partkey % 2 = 0) <> (p_partkey % 3 = 0)",
    "subset_singleton": "SELECT p_partkey AS id, p_partkey = 7 AS member FROM part",
    "hash_partition": f"WITH v AS (SELECT p_partkey AS id FROM part), {_CODE} SELECT id, code, CAST(code % 4 AS INTEGER) AS part FROM h",
    "partition_sizes": f"WITH v AS (SELECT p_partkey AS id FROM part), {_CODE} SELECT CAST(code % 4 AS INTEGER) AS part, count(*) AS vertices FROM h GROUP BY 1",
    "edge_cut_stats": f"""
WITH {SEQUENCE}, {_CODE} SELECT CAST(a.code % 4 AS INTEGER) AS src_part, CAST(b.code % 4 AS INTEGER) AS dst_part, count(*) AS edges
FROM e JOIN h a ON a.id = src JOIN h b ON b.id = dst WHERE a.code % 4 <> b.code % 4 GROUP BY 1, 2
""",
    "bfs": _levels(SEQUENCE, 0, 12),
    "bfs_round_cap": _levels(SEQUENCE, 0, 2),
    "bfs_bipartite": _levels(SUPPLY, 3, 3),
    "sssp_weighted": _distances("e.w"),
    "sssp_unit": _distances("1"),
    "pagerank_10": _pagerank(SEQUENCE, 10, 9),
    "pagerank_dangling": _pagerank(SUPPLY, 4, 9),
    "pagerank_converged": _pagerank(SEQUENCE, 40, 6),
    "max_propagation": "SELECT o_orderkey AS id, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS value FROM orders",
    "max_propagation_fixpoint": f"""
WITH RECURSIVE {SEQUENCE}, r(id, m) USING KEY (id) AS (SELECT id, (id * 37) % 1000 FROM v UNION
  SELECT x.id, x.m FROM (SELECT e.dst AS id, max(r.m) AS m FROM r JOIN e ON e.src = r.id GROUP BY e.dst) x JOIN recurring.r o ON o.id = x.id WHERE x.m > o.m)
SELECT id, m AS value FROM r
""",
}
