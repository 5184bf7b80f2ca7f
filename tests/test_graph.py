import random

import pytest
from pyspark.sql import functions as F

import oracles
from vertexflow import Graph, VertexSubset, algorithms, partition
from vertexflow.functions import hash_code, is_numeric
from vertexflow.operators import activate, edge_filter, edge_map, edge_update, vertex_filter, vertex_map, vertex_reduce, vertex_transform
from vertexflow.operators.vertices import HIT, frontier_of

CHAIN = (12, [(i, j, None) for a in range(11) for i, j in ((a, a + 1), (a + 1, a))])
STAR = (20, [(i, j, None) for a in range(1, 20) for i, j in ((0, a), (a, 0))])
GRID = (15, [(i, j, abs(i - j) * 3 + i % 4 + 1) for r in range(3) for c in range(5) for i in [5 * r + c] for j in ([i + 1] if c < 4 else []) + ([i + 5] if r < 2 else []) + ([i - 1] if c else []) + ([i - 5] if r else [])])
DAG = (10, [(i, j, (i * 7 + j * 3) % 11 + 1) for i in range(10) for j in range(i + 1, 10)])
EMPTY = (6, [])
SINGLE = (1, [])
LOOPS = (5, [(0, 0, 2), (0, 1, 5), (0, 1, 3), (1, 2, 1), (2, 1, 1), (3, 3, 1)])
rng = random.Random(3)
RANDOM = (30, [(rng.randrange(30), rng.randrange(30), rng.randrange(1, 20)) for _ in range(90)])
GRAPHS = {"chain": CHAIN, "star": STAR, "grid": GRID, "dag": DAG, "empty": EMPTY, "single": SINGLE, "loops": LOOPS, "random": RANDOM}


def make(spark, spec, cache=False):
    n, edges = spec
    return Graph.of(spark.createDataFrame(edges, "src long, dst long, weight int"), n, cache=cache)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name", GRAPHS)
def test_bfs_and_unit_sssp(spark, name):
    g = make(spark, GRAPHS[name])
    expected = oracles.bfs(*GRAPHS[name])
    run = algorithms.bfs(g)
    assert column(run.graph.vertices, "level") == expected
    assert column(algorithms.printed(run, "level"), "level") == [algorithms.INFINITY if x is None else x for x in expected]
    assert run.passes == max(x for x in expected if x is not None) + 1
    if name in ("grid", "random"):
        assert column(algorithms.sssp(g, unit_weights=True).graph.vertices, "distance") == expected


@pytest.mark.parametrize("name", ["grid", "dag", "loops", "random", "empty"])
def test_sssp(spark, name):
    n, edges = GRAPHS[name]
    assert column(algorithms.sssp(make(spark, (n, edges))).graph.vertices, "distance") == oracles.sssp(n, edges)


@pytest.mark.parametrize("name", ["star", "grid", "dag", "empty", "loops"])
def test_pagerank(spark, name):
    n, edges = GRAPHS[name]
    g = make(spark, (n, edges))
    fixed = algorithms.pagerank(g, epsilon=None, max_passes=5)
    assert column(fixed.graph.vertices, "rank") == pytest.approx(oracles.pagerank(n, edges, 5)[0], abs=1e-12)
    if name in ("dag", "empty"):
        rank, passes = oracles.pagerank(n, edges)
        run = algorithms.pagerank(g)
        assert (run.passes, run.converged, run.iterations) == (passes, True, passes - 1)
        assert column(run.graph.vertices, "rank") == pytest.approx(rank, abs=1e-12)
        assert sum(rank) < 1  # vertices without out-edges keep their mass from the others


@pytest.mark.parametrize("name", ["star", "dag", "loops"])
def test_max_propagation(spark, name):
    n, edges = GRAPHS[name]
    assert column(algorithms.max_propagation(make(spark, (n, edges))).graph.vertices, "value") == oracles.reach_max(n, edges, range(n))


def test_round_cap_makes_one_more_pass(spark):
    run = algorithms.bfs(make(spark, CHAIN), max_rounds=3)
    assert run.passes == 4 and not run.converged
    assert column(run.graph.vertices, "level") == [0, 1, 2, 3, 4] + [None] * 7


def test_edge_order_does_not_matter(spark):
    n, edges = RANDOM
    shuffled = edges[:]
    random.Random(8).shuffle(shuffled)
    assert column(algorithms.sssp(make(spark, (n, shuffled))).graph.vertices, "distance") == oracles.sssp(n, edges)


def test_hubs_are_dealt_apart_and_change_nothing(spark):
    n, edges = STAR
    df = spark.createDataFrame([(s, d, s + d) for s, d, _ in edges], "src long, dst long, weight int")
    g, plain = Graph.of(df, n, hub_edges=3), Graph.of(df, n)
    assert plain.heavy is None and [r["src"] for r in g.hubs.collect()] == [0] and g.heavy.count() == 19 and g.edge_count() == 38
    assert column(algorithms.bfs(g, 4).graph.vertices, "level") == oracles.bfs(n, edges, 4)
    ranks = algorithms.pagerank(g, epsilon=None, max_passes=3).graph.vertices
    assert column(ranks, "rank") == pytest.approx(oracles.pagerank(n, edges, 3)[0], abs=1e-12)
    new = edge_update(g, lambda s, e: {"weight": e["weight"] + s["outdeg"]}, VertexSubset.singleton(spark, n, 0))
    assert sorted(r["weight"] for r in new.edges.where("src = 0").collect()) == [d + 19 for d in range(1, 20)]
    assert column(g.out_degrees(), "outdeg") == column(plain.out_degrees(), "outdeg") == [19] + [1] * 19


def test_state_is_not_shuffled_again(spark):
    g = make(spark, RANDOM)
    state = algorithms.bfs(g, max_rounds=1).graph
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        messages = edge_filter(state, frontier_of(state, 5), lambda s, e: s["level"] + 1, F.min)
        plan = vertex_filter(state, messages, lambda v: v["level"].isNull(), lambda v: {"level": v["acc"]}).vertices._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    above = plan.split("Scan ExistingRDD")[0]
    assert "Exchange" not in above and "BroadcastHashJoin" in plan


def test_negative_cycle_and_bad_source(spark):
    with pytest.raises(ValueError, match="negative"):
        algorithms.sssp(make(spark, (3, [(0, 1, 1), (1, 2, -3), (2, 0, 1)])))
    with pytest.raises(ValueError, match="not in"):
        algorithms.bfs(make(spark, CHAIN), source=12)
    with pytest.raises(ValueError):
        algorithms.pagerank(make(spark, CHAIN), epsilon=None)


def test_operators_on_loops_and_parallel_edges(spark):
    g = make(spark, LOOPS).with_state(value=F.col("id") * 10)
    frontier = VertexSubset.singleton(spark, 5, 0)
    sent = edge_filter(g, frontier, lambda s, e: s["value"] + e["weight"], {"least": F.min, "many": F.count})
    assert sorted(map(tuple, sent.collect())) == [(0, 2, 1), (1, 3, 2)]
    assert sorted(map(tuple, edge_map(g, lambda s, e: s["outdeg"], F.sum).collect())) == [(0, 3), (1, 7), (2, 1), (3, 1)]
    messages = edge_filter(g, frontier, lambda s, e: s["value"] + e["weight"], F.min)
    new = vertex_filter(g, messages, lambda v: v["acc"] < v["value"], lambda v: {"value": v["acc"]})
    assert column(new.vertices, "value") == [0, 3, 20, 30, 40]
    assert column(frontier_of(new).ids, "id") == [1]
    mapped = vertex_map(g, lambda v: {"value": v["acc"]}, VertexSubset.of(spark.createDataFrame([(1,), (4,), (4,)], "id long"), 5), messages, F.lit(-1))
    assert column(mapped.vertices, "value") == [0, 3, 20, 30, -1]
    assert column(activate(g, lambda v: v["id"] > 2, lambda v: {"value": F.lit(0)}).vertices, HIT) == [False] * 3 + [True] * 2
    assert vertex_reduce(g, F.sum("value")).first()["acc"] == 100
    assert list(vertex_transform(vertex_map(g, lambda v: {"value": v["value"] + 1}), lambda r: r["value"]))[:1] != []
    changed = edge_update(g, lambda s, e: {"weight": e["weight"] + 100}, frontier)
    assert sorted(r["weight"] for r in changed.edges.collect()) == [1, 1, 1, 102, 103, 105]
    marked = edge_update(g, lambda s, e: {"mark": F.lit(7)}, frontier)
    assert sorted(str(r["mark"]) for r in marked.edges.collect()) == ["7", "7", "7", "None", "None", "None"]


def test_statistics(spark):
    g = make(spark, STAR)
    assert (g.vertex_count(), g.edge_count()) == (20, 38)
    h = {r["slot"]: (r["vertices"], r["percent"]) for r in g.degree_histogram().collect()}
    assert h == {0: (0, 0.0), 1: (19, 95.0), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (1, 5.0)}
    assert [tuple(r) for r in make(spark, EMPTY).degree_histogram().collect()] == [(0, 6, 100.0)]
    assert column(make(spark, LOOPS).adjacency(), "neighbours") == [[0, 1, 1], [2], [1], [3], []]
    with pytest.raises(ValueError, match="leaves"):
        make(spark, (2, [(0, 5, 1)])).validate()


def test_subsets(spark):
    of = lambda *ids: VertexSubset.of(spark.createDataFrame([(i,) for i in ids], "id long"), 8)
    a, b = of(1, 2, 2, 3), of(3, 4)
    ids = lambda s: column(s.ids, "id")
    assert (ids(a & b), ids(a | b), ids(a ^ b)) == ([3], [1, 2, 3, 4], [1, 2, 4])
    assert (a.size(), a.capacity(), a.clear().is_empty(), a.contains(2), a.contains(4)) == (3, 8, True, True, False)
    assert ids(a.add(7).remove(1)) == [2, 3, 7]
    assert VertexSubset.universal(spark, 4).size() == 4 and VertexSubset.empty(spark, 4).is_empty()
    with pytest.raises(ValueError):
        VertexSubset.singleton(spark, 4, 4)
    with pytest.raises(ValueError):
        of(9).check()


def test_partitions(spark):
    codes = [r[0] for r in spark.range(9).select(hash_code("id")).collect()]
    assert codes == [0, 270369, 540738, 811107, 1081476, 1351845, 1622214, 1892583, 2162952]
    g = make(spark, CHAIN)
    assert sum(r["vertices"] for r in partition.part_sizes(g, 4).collect()) == 12
    part = {r["id"]: r["part"] for r in partition.assign(g, 4).collect()}
    cut = sum(part[s] != part[d] for s, d, _ in CHAIN[1])
    assert sum(r["edges"] for r in partition.cut_edges(g, 4).collect()) == cut
    assert partition.deal(g, 3).edges.rdd.getNumPartitions() == 3


def test_is_numeric(spark):
    rows = spark.createDataFrame([("12",), ("",), ("1.5",), ("x",)], "v string").select(is_numeric("v")).collect()
    assert [r[0] for r in rows] == [True, True, False, False]


def test_edges_are_computed_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            computed.add(b.num_rows)
            yield b

    n, edges = STAR
    df = spark.createDataFrame(edges, "src long, dst long, weight int").mapInArrow(watched, "src long, dst long, weight int")
    for hub_edges in (100, 3):
        computed.value = 0
        g = Graph.of(df, n, hub_edges=hub_edges)
        assert (g.edge_count(), g.edges.count(), computed.value) == (38, 38, 38)
        assert {(r["src"], r["outdeg"]) for r in g.edges.collect()} == {(0, 19)} | {(a, 1) for a in range(1, 20)}
        g.release()


def test_large_parts_are_dealt_to_several_partitions(spark):
    n, edges = STAR
    g = partition.deal(make(spark, STAR), 2, most=5)
    seen = g.edges.select(F.spark_partition_id().alias("p"), partition.random_edge_cut(F.col("src"), 2).alias("part"), "src", "dst").collect()
    assert g.edges.rdd.getNumPartitions() == 8 and len({r["p"] for r in seen}) > 4
    assert len({(r["p"], r["part"]) for r in seen}) == len({r["p"] for r in seen})
    assert sorted((r["src"], r["dst"]) for r in seen) == sorted((s, d) for s, d, _ in edges)
