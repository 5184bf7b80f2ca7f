import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vertexflow.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "word"] + [" ".join(rng.choice("alpha beta gamma delta é 中 12".split()) for _ in range(rng.randrange(1, 90))) for _ in range(150)] + ["long " * 500]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(7, texts[7], 1, 2)], "doc_id long, text string, length int, piece int")
    rows = packing.pack_documents(docs, PATH, capacity=64).collect()
    tok = Tokenizer.from_file(PATH)
    expected = Counter()
    for i in [*range(len(texts)), 7]:
        ids = tok.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            expected[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    used = check(rows, 64)
    assert used <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_plan_places_every_length_once_and_nearly_fills():
    rng = random.Random(5)
    for n, top in ((1, 9), (40, 100), (3000, 100), (20000, 2048)):
        counts = Counter(min(top, 1 + int(rng.expovariate(3 / top))) for _ in range(n))
        plan = packing.best_plan(counts, top)
        placed = Counter()
        for many, room, content in plan.classes:
            assert room == top - sum(a * b for a, b in content) >= 0
            for length, copies in content:
                placed[length] += many * copies
        assert placed == counts
        least = -(-sum(k * v for k, v in counts.items()) // top)
        assert plan.sequences <= least * 1.02 + 2


def test_few_large_sizes_reach_the_optimum():
    counts = {60: 50, 40: 50, 35: 20, 30: 20}  # 60 + 40 and 35 + 35 + 30, 35 + 30 + 30 ...
    assert 63 <= packing.best_plan(counts, 100).sequences <= 65


def test_one_length_for_all_rows(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "30L AS length")
    assert check(packing.pack(pieces, 100, rows_per_salt=100).collect(), 100) == 1000
