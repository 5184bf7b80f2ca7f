import random
import re

import numpy as np
import pytest

from vertexflow.llm import minhash


def brute(docs, width, percent=80):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    docs = [None, "", "one", "ONE", "two words here", "Two words here", "É a b c", "é a b c", " \n "]
    base = [word() for _ in range(120)]
    for k in range(60):  # a family of near copies around the threshold
        w = base[:]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(120)] = word()
        docs.append(" ".join(w))
    passage = [word() for _ in range(50)]
    docs += [" ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)]) for _ in range(25)]
    docs += [docs[20]] * 15 + [" ".join(word() for _ in range(3000))]
    return list(enumerate(docs))


@pytest.mark.parametrize("width", [4, 5])
def test_components_equal_brute_force(spark, width):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, keys string, rep long")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width).collect()}
    assert found == brute(docs, width)


def test_late_links_are_found_without_the_centre():
    """Rows that are near each other but not the bucket's centre."""
    rng = np.random.default_rng(1)
    common = rng.integers(1, 1 << 62, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[: 100 - k], rng.integers(1, 1 << 62, k).astype(np.uint64)])) for k in (0, 10, 9, 60, 61)]
    sets.append(np.unique(np.concatenate([sets[3][:-2], rng.integers(1, 1 << 62, 2).astype(np.uint64)])))
    bits = np.array([(minhash.mixed(minhash.sketch(s, 240)) & np.uint64(255)).astype(np.uint8) for s in sets])
    ids = np.arange(6) + 10
    links = minhash.joining_links(ids, ids.copy(), sets, bits, None, 80)
    assert sorted(links) == [(11, 10), (12, 10), (15, 13)]
    assert minhash.joining_links(ids, np.array([1, 1, 1, 2, 3, 2]), sets, bits, None, 80) == []
    assert sorted(minhash.joining_links(ids, ids.copy(), sets, bits, np.array([0, 0, 1, 0, 0, 0]), 80)) == [(12, 10), (12, 11)]


def test_sketch_estimates_and_fills():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 40, 300, 5000):
        items = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        s = minhash.sketch(items, 240)
        assert (s != np.uint64(minhash._FULL)).all()
        assert (minhash.sketch(items[::-1].copy(), 240) == s).all()
    a = rng.integers(1, 1 << 62, 1000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        cut = int(2000 * share / (1 + share))
        x, y = np.unique(a), np.unique(np.concatenate([a[:cut], rng.integers(1, 1 << 62, 1000 - cut).astype(np.uint64)]))
        assert abs((minhash.sketch(x, 1200) == minhash.sketch(y, 1200)).mean() - share) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(1, 40)] + [(500, 501), (501, 500), (7, 7)]
    found = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(31)}, **{100 + k: 100 for k in range(40)}, 500: 500, 501: 500}


def test_few_edges_take_no_rounds_and_rounds_agree(spark, monkeypatch):
    """The plans of the rounds filled the driver's memory when the pipeline ran again and again."""
    written, stash = [], minhash.stash
    monkeypatch.setattr(minhash, "stash", lambda df, name, *more: written.append(name) or stash(df, name, *more))
    rng = np.random.default_rng(9)
    edges = spark.createDataFrame([*map(tuple, rng.integers(0, 90, (70, 2)).tolist()), *((k, k + 1) for k in range(200, 240))], "a long, b long")
    few, rounds = (sorted(map(tuple, minhash.components(edges, *most).collect())) for most in ((), (0,)))
    assert few == rounds and len({x for x, _ in few}) == len(few)
    assert minhash.components(edges.limit(0)).count() == 0
    written.clear()
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(words[:38] + [f"v{k}"])) for k in range(6)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(docs).collect()} == {0}
    assert "edges" in written and "stars" not in written


def test_keep_one_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (3, "x y z", 7), (3, "x y z", 7), (None, "n", 8), (4, None, 9)], "doc_id long, text string, component_id int")
    rows = [tuple(r) for r in minhash.keep_one(docs).collect()]
    assert sorted(rows, key=str) == sorted([(1, "a b c d e f", 5), (3, "x y z", 7), (None, "n", 8), (4, None, 9)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
