import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vertexflow.llm import hpylm

WORDS = [f"w{i}" for i in range(300)]


def corpus():
    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(300)]
    docs = []
    for i in range(300):
        half = WORDS[:150] if i % 2 else WORDS[150:]
        docs.append((i, " ".join(rng.choices(half, weights[:150], k=rng.randrange(5, 80)))))
    return docs + [(1000, None), (1001, ""), (1002, "W1 É É unseen" + " x" * 3), (1003, "y " * 70000), (7, docs[7][1]), (None, "w1 w2")]


@pytest.fixture(scope="module")
def scored(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    return docs, hpylm.score(df).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_base_columns(scored):
    docs, rows = scored
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in docs if not held(i) for w in [*words(t), "</end>"])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t in docs:
        toks = [*words(t), "</end>"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in toks)
        expected[i, held(i), len(toks), sum(counts[w] > 0 for w in toks), n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == expected


def test_model_beats_the_base_on_held_out_texts(scored):
    docs, rows = scored
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 20
    per_token = lambda c: sum(r[c] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token("score") > per_token("base_score")
    assert all(r["score"] < 0 for r in rows)


def test_scores_do_not_depend_on_the_deal(spark, scored):
    docs, rows = scored
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    first = sorted(rows, key=key)
    try:
        for partitions, size in (("3", 20_000), ("7", 60_000)):  # several buckets, and contexts that are split
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            again = sorted(hpylm.score(df.repartition(int(partitions)), bucket_bytes=size).collect(), key=key)
            assert [(r["doc_id"], r["n_known"]) for r in again] == [(r["doc_id"], r["n_known"]) for r in first]
            assert np.allclose([r["score"] for r in again], [r["score"] for r in first], rtol=1e-6)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def locally(texts, buckets, sweeps, hot=()):
    """The steps of score() without Spark: the samples, as (states, seats, roots, sums)."""
    vocab = hpylm.Numbered()
    found = [words(t) for t in texts]
    ids = [np.fromiter(map(vocab.__getitem__, w), np.int32, len(w)) for w in found]
    spread = hpylm.Hot({hpylm.xxhash.xxh64_intdigest(w): 3 for w in hot})
    rows = [r for r in hpylm.chunk_rows("0-0", list(range(len(texts))), [False] * len(texts), [len(w) + 1 for w in found], ids, vocab, buckets, spread)]
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(dict(zip(hpylm._CHUNK.names, r)))
    merged = {b: hpylm.merge(hpylm.pa.Table.from_pylist(x, hpylm._CHUNK), buckets).to_pylist() for b, x in by.items() if b >= 0}
    states = {b: x[0] for b, x in merged.items()}
    seated = {b: hpylm.first_seats(x, buckets).to_pylist() for b, x in states.items()}
    s, root, kept = {"d1": 0.6, "d0": 0.4, "words": 0.0, "c0": 0.0, "t0": 0.0, "tokens": 0.0}, None, []
    for sweep in range(sweeps):
        if sweep:
            seated = {b: hpylm.seat_contexts(x, [r for o in root.values() for r in o[1:] if r["bucket"] == b], seated[b][0], s, sweep, buckets).to_pylist() for b, x in states.items()}
        root = {
            o: hpylm.seat_root(x, [r for b in seated.values() for r in b[1:] if r["owner"] == o], root and root[o][0], hpylm.numbers(seated[o][0]["less_own"], 6), s, sweep, buckets).to_pylist()
            for o, x in states.items()
        }
        s = s | {"c0": sum(r[0]["c0_sum"] for r in root.values()), "t0": sum(r[0]["t0_sum"] for r in root.values()), "words": sum(r[0]["words"] for r in root.values())}
        kept.append((seated, root, s))
    return vocab, states, kept


def predictions(states, sample, buckets):
    """(context hash, dish) -> prediction of the pairs that repeat, and by word hash: count, tables as a context, root prediction."""
    seated, root, s = sample
    of_word = {}
    for o, x in states.items():
        b, r = hpylm.Bucket(x, buckets), root[o][0]
        p = hpylm.root_prediction(b.served - hpylm.numbers(r["less"], 6), hpylm.numbers(r["t0"], 6), s)
        of_word |= {int(h): (int(c), int(c - less), float(q)) for h, c, less, q in zip(b.words, b.c, hpylm.numbers(r["less_context"], 6), p)}
    of_pair = {}
    for b_, x in states.items():
        b, t = hpylm.Bucket(x, buckets), hpylm.numbers(seated[b_][0]["tables"], 6)
        of_pair |= {(int(h), int(d)): int(n) - s["d1"] * int(k) for h, d, n, k in zip(b.contexts[b.at], b.dishes, b.n, t)}
    return of_word, of_pair


@pytest.mark.parametrize("buckets", [1, 3, 7])
def test_predictions_sum_to_one(buckets):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS[:40], [1 / (i + 1) for i in range(40)], k=60)) for _ in range(40)]
    vocab, states, kept = locally(texts, buckets, 4, WORDS[:2])
    pairs = Counter()
    for t in texts:
        w = words(t)
        pairs.update(zip(["<s>", *w], [*w, "</s>"]))
    hashes = {w: hpylm.xxhash.xxh64_intdigest(w) for w in vocab} | {"<s>": int(hpylm.START_HASH), "</s>": int(hpylm.END_HASH)}
    for sample in kept:
        s = sample[2]
        of_word, of_pair = predictions(states, sample, buckets)
        unknown = hpylm.root_prediction(0, 0, s)
        dishes = [w for w in hashes if w != "<s>"]
        assert math.isclose(sum(of_word[hashes[w]][2] for w in dishes) + unknown, 1, rel_tol=1e-9)
        for u in ("<s>", *vocab):
            c, tables, _ = of_word[hashes[u]]
            assert c == sum(n for (x, _), n in pairs.items() if x == u) and tables <= c
            mass = hpylm.prediction(0.0, c, tables, unknown, s["d1"])
            for w in dishes:
                n = pairs[u, w]
                e = of_pair[hashes[u], hashes[w] & (1 << 48) - 1] if n > 1 else n * (1 - s["d1"])
                mass += hpylm.prediction(e, c, tables, of_word[hashes[w]][2], s["d1"])
            assert math.isclose(mass, 1, rel_tol=1e-6), u


def test_agrees_with_plain_gibbs_on_a_tiny_corpus():
    """Mean tables of each pair against a customer-by-customer Chinese restaurant sampler under the same discounts."""
    texts = ["a b a b a b", "a b a c a b", "b a a a b", "a a b a b a b"]
    _, states, kept = locally(texts, 1, 400)
    b = hpylm.Bucket(states[0], 1)
    mean = np.mean([hpylm.numbers(x[0][0][0]["tables"], 6) for x in kept[50:]], axis=0)
    d1, d0, theta, rng = 0.6, 0.4, hpylm.STRENGTH, random.Random(1)
    served = {(int(h), int(d)): int(n) for h, d, n in zip(b.contexts[b.at], b.dishes, b.n)}
    single = Counter()  # pairs that occur once have one table
    for t in texts:
        w = words(t)
        single.update(zip(["<s>", *w], [*w, "</s>"]))
    mask = (1 << 48) - 1
    code = lambda w: {"<s>": int(hpylm.START_HASH), "</s>": int(hpylm.END_HASH)}.get(w) or hpylm.xxhash.xxh64_intdigest(w)
    pairs = {(code(u), code(w) & mask): n for (u, w), n in single.items()}
    assert {k: n for k, n in pairs.items() if n > 1} == served
    v = len({w for _, w in pairs})
    seats = {k: [n] for k, n in pairs.items()}
    rooms: dict = {}
    for (_, w), t in seats.items():
        rooms.setdefault(w, [0])[0] += len(t)

    def root(w):
        c0, t0 = sum(map(sum, rooms.values())), sum(map(len, rooms.values()))
        mine = rooms.get(w, [])
        return (sum(mine) - d0 * len(mine) + (theta + d0 * t0) / (v + 1)) / (theta + c0)

    def leave(tables):
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def enter(tables, new, d):
        k = rng.choices(range(len(tables) + 1), [*(x - d for x in tables), new])[0]
        if k == len(tables):
            tables.append(1)
            return True
        tables[k] += 1
        return False

    total, rounds = Counter(), 3000
    for r in range(rounds + 200):
        for (u, w), tables in seats.items():
            for _ in range(pairs[u, w]):
                if leave(tables):
                    leave(rooms[w])
                open_ = theta + d1 * sum(len(t) for (x, _), t in seats.items() if x == u)
                if enter(tables, open_ * root(w), d1):
                    t0 = sum(map(len, rooms.values()))
                    enter(rooms[w], (theta + d0 * t0) / (v + 1), d0)
            if r >= 200:
                total[u, w] += len(tables)
    exact = np.array([total[int(h), int(d)] / rounds for h, d in zip(b.contexts[b.at], b.dishes)])
    assert np.abs(mean - exact).max() < 0.25, (mean, exact)


def test_reseating_follows_the_table_counts_of_one_dish():
    """The share of table counts of three customers against the exact posterior, proposals weighted by acceptance."""
    d, prior, n = 0.5, 0.3, 4000
    exact = {}
    for t, ways in ((1, (1 - d) * (2 - d)), (2, 3 * (1 - d)), (3, 1)):
        exact[t] = ways * math.prod((hpylm.STRENGTH + d * k) * prior for k in range(t))
    total = sum(exact.values())
    t, weight, ids = np.ones(n), np.full(n, -np.inf), hpylm.mixed(np.arange(1, n + 1, dtype=np.uint64))
    for sweep in range(30):
        t, weight = hpylm.sweep_dishes(np.full(n, 3), t, weight, np.full(n, prior), d, np.zeros(n), ids, sweep)
    for k in exact:
        assert abs((t == k).mean() - exact[k] / total) < 0.03


def test_large_counts_and_planes():
    tables, weight = hpylm.reseat(np.array([1e6, 300.0, 1.0]), np.array([0.9, 0.9, 0.9]), 0.8, np.zeros(3), np.array([1, 2, 3], np.uint64), 0)
    assert 1 < tables[1] <= 300 and tables[1] < tables[0] < 1e6 and tables[2] == 1 and np.isfinite(weight).all()
    x = np.array([0, 1, 255, 256, 70000, 2**40 - 1])
    assert (hpylm.numbers(hpylm.planes(x, 5), 5) == x).all()


def test_nothing_to_learn(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    df = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    rows = hpylm.score(df).collect()
    assert [(r["train_tokens"], r["base_score"], r["score"], r["n_known"]) for r in rows] == [(0, 0.0, 0.0, 0)] * 2
    assert hpylm.score(df.limit(0)).count() == 0
