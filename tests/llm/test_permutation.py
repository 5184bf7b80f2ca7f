import numpy as np
from pyspark.sql import functions as F

from vertexflow.llm import permutation


def rows(spark, vectors, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    found = permutation.nearest(df, F.col("vec_id") % 10 == 0, **options).collect()
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}


def brute(vectors, k=10):
    x = {i: np.array(v, np.float32).astype(float) for i, v in vectors}
    out = {}
    for q in x:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:k]
            out |= {(q, r + 1): (i, d) for r, (d, i) in enumerate(near)}
    return out


def test_small_tables_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8)) for i in range(200)]
    vectors += [(200 + i, vectors[5][1]) for i in range(40)]  # copies: ties go to the smaller id
    found = rows(spark, vectors, block=100, query_block=7)
    expected = brute(vectors)
    assert found.keys() == expected.keys()
    assert all(found[k][0] == expected[k][0] and abs(found[k][1] - expected[k][1]) < 1e-9 for k in expected)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=32)) for i in range(4000)]
    dense = rng.normal(size=32)
    vectors += [(4000 + i, dense + 0.05 * rng.normal(size=32)) for i in range(1500)]  # a cluster that pivots can't tell apart
    found = rows(spark, vectors)
    expected = brute(vectors)
    hits = {q: {v for (p, _), (v, _) in found.items() if p == q} for q, _ in expected}
    recall = np.mean([v in hits[q] for (q, _), (v, _) in expected.items()])
    assert recall >= 0.95


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1, 0]), (1, None), (2, [0, 0]), (3, [nan, 1]), (4, [inf, 1]), (5, [None, 1]), (6, [1, 2, 3]), (7, [2, 0]), (10, [0, 0]), (7, [2, 0]), (20, [])]
    assert rows(spark, vectors) == {(0, 1): (7, 1.0)}
    assert rows(spark, [(1, None)]) == {} and rows(spark, [(10, [1, 1])]) == {}


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(3)
    pivots, x = rng.normal(size=(12, 4)), rng.normal(size=(30, 4))
    order = permutation.orders(x, pivots, 5)
    files = permutation.InvertedFiles(order, 12)
    position = np.full((30, 12), 5)
    np.put_along_axis(position, order, np.arange(5)[None], axis=1)
    for q in range(30):
        plain = np.abs(position - position[q]).sum(axis=1)
        found = files.footrule(order[q])
        assert (np.diff(plain[np.argsort(found, kind="stable")]) >= 0).all() and len(set(plain - found)) == 1
