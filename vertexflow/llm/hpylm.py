"""Scoring by a hierarchical Pitman-Yor language model.

Every word that precedes another has a restaurant of its own (and so has the start of a text); the restaurants share one parent, that of
all words, whose base is uniform over the training words and one unknown. Tables of a context are customers of the parent.
Seating is sampled by Gibbs: all customers of one dish in one restaurant leave and are seated anew (a table of the dish by its
customers less the discount, a new one by strength, discount and the parent's prediction), and the new seating is accepted by the
ratio of its weights (Metropolis within Gibbs). Customers beyond the first 64 choose in groups of 1/32 of those seated.
All dishes move at once under the totals before them; random numbers are hashes of (dish, restaurant, sweep), so the result does
not depend on how the work is dealt. Predictions are averaged over samples, each under its own totals, so they sum to one. Discounts come from
counts of counts, the root's from its first customers.

A dish that a context has once has one table: only pairs that occur twice or more are ever sampled, and
tables(context) = customers - sum(customers - tables) over these. That makes the exchange small. Work is dealt to buckets, whose number follows
the bytes of text. A bucket owns words by hash, with their counts and root seating, and the pairs of the contexts it owns.
Contexts that may hold more pairs than a bucket should are split by their dishes over several buckets; a sample of texts tells which (it decides
where pairs lie, not what comes out).

1. Chunks of documents count words and pairs by bucket and keep their token streams. 2. Buckets merge them, number what each chunk had, and
keep the pairs that repeat. 3. Rounds: owners seat the root's customers and answer with them; buckets sample tables and send
customers - tables by dish. 4. Buckets answer each chunk word by word and pair by pair; chunks add up along their streams.

Null texts count as empty (the end token only). Rows are scored one by one, repeated rows each for itself; a null id is
held out. With no training tokens both scores are 0. Words are told apart by 64-bit hashes, dishes within a bucket by 48 bits. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, arrow_batch, arrow_rows, drop, free_shuffles, kind_of, lean, lower_az, stash, stash_parts

END_HASH, START_HASH = np.uint64(0x5EED0F5E9D3A7C11), np.uint64(0x57A27C0DE0F7E471)
STRENGTH = 1.0
CHUNK_TOKENS = 2_500_000
BUCKET_BYTES = 12_000_000
_48 = np.uint64((1 << 48) - 1)
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def pair_ids(contexts: np.ndarray, dishes: np.ndarray) -> np.ndarray:
    return mixed(contexts * _STEP + dishes)


def uniform(ids: np.ndarray, sweep: int, step: int) -> np.ndarray:
    """Numbers in [0, 1) that only the arguments decide."""
    return (mixed(ids ^ np.uint64((sweep * 1_000_003 + step) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) >> np.uint64(11)) * 2.0**-53


def planes(values: np.ndarray, width: int) -> bytes:
    """Unsigned numbers of `width` bytes, all low bytes first: planes of zeros compress to nothing."""
    return np.ascontiguousarray(np.asarray(values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros(parts.shape[1], np.uint64)
    for k in range(width):
        out |= parts[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def numbers(data: bytes, width: int) -> np.ndarray:
    return from_planes(data, width).astype(np.int64)


class Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def held_out(doc_id, mod: int, rest: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % mod == rest


def owners(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & _48) % np.uint64(buckets)).astype(np.int64)


def _schema(**kinds) -> pa.Schema:
    return pa.schema([(k, {"i": pa.int32(), "l": pa.int64(), "s": pa.string(), "b": pa.binary(), "d": pa.float64()}[v]) for k, v in kinds.items()])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([arrow_batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))], schema)


_CHUNK = _schema(chunk="s", bucket="i", words="b", counts="b", sizes="b", dishes="b", dish_at="b", pairs="b", ids="b", lengths="b", held="b", stream="b")


class Hot:
    """Contexts that are split over several buckets, and over how many."""

    def __init__(self, spread: dict[int, int]):
        self.hashes = np.array(sorted(spread), np.uint64)
        self.many = np.array([spread[h] for h in sorted(spread)], np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.many[at], np.uint64(1))


def chunk_rows(name: str, ids: list, held: list, lengths: list, words: list, vocab: Numbered, buckets: int, hot: Hot):
    """A row per bucket: words and contexts, training counts of owned words, number of pairs of each, their dishes and training counts;
    and one with the streams (bucket -1): in `words` the owned words by bucket, in `counts` the end and the start, in `sizes` the hot contexts,
    in `dishes` the buckets of their pairs."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), np.uint64, len(vocab))
    hashes = np.append(hashes, [END_HASH, START_HASH])
    n = len(hashes)
    bucket = owners(hashes, buckets)
    order = np.lexsort((hashes, bucket))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    hashes, bucket = hashes[order], bucket[order]
    end, start = rank[n - 2], rank[n - 1]

    lengths_ = np.array(lengths, np.int64)
    ends = np.cumsum(lengths_) - 1
    tokens = np.full(int(lengths_.sum()), end, np.int64)
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = rank[np.concatenate(words)] if words else []
    words.clear()
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.r_[0, ends[:-1] + 1]] = start
    train = np.repeat(~np.array(held, bool), lengths_)
    counts = np.bincount(tokens[train], minlength=n)
    counts[start] = int((~np.array(held, bool)).sum())
    key = before * n + tokens
    del before, inner
    unique, at = np.unique(key, return_inverse=True)
    del key
    pair_counts = np.bincount(at[train], minlength=len(unique))
    del at, train
    context, dish = unique // n, hashes[unique % n] & _48
    spread = hot.of(hashes)
    split = spread[context] > 1
    of_pair = bucket[context]
    of_pair[split] = ((hashes[context[split]] + dish[split] % spread[context[split]]) & _48) % np.uint64(buckets)
    by = np.argsort(of_pair, kind="stable")
    first_pair, first_word = np.searchsorted(of_pair[by], np.arange(buckets + 1)), np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        own, mine = np.arange(first_word[b], first_word[b + 1]), by[first_pair[b] : first_pair[b + 1]]
        if not len(own) and not len(mine):
            continue
        listed, sizes = np.unique(context[mine], return_counts=True)
        foreign = np.setdiff1d(listed, own, assume_unique=True)
        every = np.sort(np.concatenate([own, foreign]))
        size = np.zeros(len(every), np.int64)
        size[np.searchsorted(every, listed)] = sizes
        count = np.where(bucket[every] == b, counts[every], (1 << 40) - 1)  # the largest number marks words of other owners
        dishes, dish_at = np.unique(dish[mine], return_inverse=True)
        yield name, b, hashes[every].tobytes(), planes(count, 5), planes(size, 3), planes(dishes, 6), planes(dish_at, 4), planes(pair_counts[mine], 5), None, None, None, None
    known_ids = np.array([0 if i is None else i for i in ids], np.int64)
    flags = np.array(held, np.uint8) + 2 * np.array([i is None for i in ids], np.uint8)
    yield (
        name, -1, planes(np.diff(first_word), 4), np.array([end, start]).tobytes(), np.flatnonzero(spread > 1).tobytes(), planes(of_pair[split], 4), None, None,
        known_ids.tobytes(), lengths_.tobytes(), flags.tobytes(), planes(tokens, 4),
    )


def chunks(docs: DataFrame, buckets: int, hot: Hot, mod: int, rest: int) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        fresh = lambda: ([], [], [], [], Numbered())
        state, tokens = fresh(), 0

        def rows():
            for row in chunk_rows(f"{part}-{made}", *state, buckets, hot):
                yield arrow_batch(_CHUNK, *([x] for x in row))

        for keys, texts in arrow_rows(batches, "doc_id", "text"):
            for doc_id, text in zip(keys, texts):
                ids, held, lengths, words, vocab = state
                found = WORD.findall(lower_az(text or ""))
                ids.append(doc_id)
                held.append(held_out(doc_id, mod, rest))
                lengths.append(len(found) + 1)
                words.append(np.fromiter(map(vocab.__getitem__, found), np.int32, len(found)))
                tokens += len(found) + 1
                if tokens >= CHUNK_TOKENS:
                    yield from rows()
                    state, tokens, made = fresh(), 0, made + 1
        if state[0]:
            yield from rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), kind_of(_CHUNK))


def hot_contexts(docs: DataFrame, total: int, buckets: int, sample: int) -> Hot:
    """Words that may open more than half of a bucket's pairs, by their share of a sample of about `sample` bytes."""
    if buckets < 4:
        return Hot({})
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for (texts,) in arrow_rows(batches, "text"):
            seen: dict[str, int] = {}
            for text in texts:
                for w in WORD.findall(lower_az(text or "")):
                    seen[w] = seen.get(w, 0) + 1
            yield arrow_batch(schema, [xxhash.xxh64_intdigest(w) - (1 << 63) for w in seen], list(seen.values()))

    whole = 1 << 30
    drawn = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(whole)) < int(whole * min(1.0, sample * max(1, buckets / 1000) / max(1, total))))
    counted = drawn.mapInArrow(lean(run), kind_of(schema)).groupBy("word").agg(F.sum("n").alias("n"))
    counted = stash(counted, "sampled-words")
    tokens = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") > max(20, tokens / (2 * buckets))).collect()  # fewer than 2 * buckets words
    drop(counted)
    return Hot({r["word"] + (1 << 63): int(min(buckets, -(-4 * r["n"] * buckets // tokens))) for r in found})


# --- buckets ----------------------------------------------------------------------------------------

#: words, c: owned words by hash, and training counts. contexts, sizes, dishes, counts: the pairs that occur twice or more, by context.
#: asked: the dishes and foreign contexts of these pairs by owner, `owner` how many of each. ones, twos: pairs with one and two customers.
_STATE = _schema(bucket="i", words="b", c="b", contexts="b", sizes="b", dishes="b", counts="b", asked="b", owner="b", ones="l", twos="l")
#: What each chunk had in the bucket: places of its owned words, and of its pairs (0: no training count, 1: one, else 2 + place).
_MAP = _schema(bucket="i", chunk="s", word_at="b", pair_at="b")
_MERGED = pa.schema([*_STATE, *list(_MAP)[1:]])


def merge(group: pa.Table, buckets: int) -> pa.Table:
    """The state of a bucket and a row for each of its chunks."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    bucket = rows[0]["bucket"]
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    counts = [numbers(r["counts"], 5) for r in rows]
    own = [c != (1 << 40) - 1 for c in counts]
    sizes = [numbers(r["sizes"], 3) for r in rows]
    dishes = np.concatenate([from_planes(r["dishes"], 6)[numbers(r["dish_at"], 4)] for r in rows])
    pair_c = np.concatenate([numbers(r["pairs"], 5) for r in rows])
    many = [int(s.sum()) for s in sizes]
    known, word_at = np.unique(np.concatenate([w[o] for w, o in zip(words, own)]), return_inverse=True)
    c = np.bincount(word_at, np.concatenate([x[o] for x, o in zip(counts, own)]), len(known)).astype(np.int64)
    contexts = np.concatenate([np.repeat(w, s) for w, s in zip(words, sizes)])
    _, first, at = np.unique(pair_ids(contexts, dishes), return_index=True, return_inverse=True)
    total = np.bincount(at, pair_c, len(first)).astype(np.int64)
    twice = np.flatnonzero(total > 1)
    twice = twice[np.lexsort((dishes[first[twice]], contexts[first[twice]]))]
    code = np.minimum(total, 1)
    code[twice] = 2 + np.arange(len(twice))
    listed, size = np.unique(contexts[first[twice]], return_counts=True)
    dish = dishes[first[twice]]
    asked = np.unique(np.concatenate([dish, listed[owners(listed, buckets) != bucket] & _48]))
    owner = owners(asked, buckets)
    asked = asked[np.lexsort((asked, owner))]
    state = (
        bucket, known.tobytes(), planes(c, 6), listed.tobytes(), planes(size, 4), planes(dish, 6), planes(total[twice], 6), planes(asked, 6),
        planes(np.bincount(owner, minlength=buckets), 4), int((total == 1).sum()), int((total == 2).sum()),
    )
    out = [(*state, None, None, None)]
    word_end, pair_end = np.cumsum([int(o.sum()) for o in own]), np.cumsum(many)
    for r, we, o, pe, p in zip(rows, word_end, own, pair_end, many):
        out.append((bucket, *[None] * 10, r["chunk"], planes(word_at[we - int(o.sum()) : we], 4), planes(code[at[pe - p : pe]], 4)))
    return _table(_MERGED, out)


class Bucket:
    def __init__(self, row: dict, buckets: int):
        self.bucket, self.words, self.c = row["bucket"], np.frombuffer(row["words"], np.uint64), numbers(row["c"], 6)
        self.served = np.where(self.words == START_HASH, 0, self.c)  # the start is no dish
        self.contexts, sizes = np.frombuffer(row["contexts"], np.uint64), numbers(row["sizes"], 4)
        self.at = np.repeat(np.arange(len(sizes)), sizes)
        self.dishes, self.n = from_planes(row["dishes"], 6), numbers(row["counts"], 6)
        self.asked, self.owner = from_planes(row["asked"], 6), numbers(row["owner"], 4)
        order = np.argsort(self.asked)
        find = lambda x: order[np.minimum(np.searchsorted(self.asked, x, sorter=order), max(0, len(order) - 1))] if len(order) else np.zeros(len(x), np.int64)
        self.dish_at, self.context_at = find(self.dishes), find(self.contexts & _48)
        self.mine = owners(self.contexts, buckets) == self.bucket
        at = np.searchsorted(self.words, self.contexts)
        self.word_at = np.where(self.mine, np.minimum(at, max(0, len(self.words) - 1)), 0)

    def of_words(self, fingerprints: np.ndarray) -> np.ndarray:
        """Places of owned words by 48 bits of their hashes."""
        low = self.words & _48
        order = np.argsort(low, kind="stable")
        return order[np.searchsorted(low, fingerprints, sorter=order)]


def reseat(customers: np.ndarray, prior: np.ndarray, discount: float, others: np.ndarray, ids: np.ndarray, sweep: int):
    """Seats all customers of each dish anew: table counts and log weights. prior: the parent's prediction; others: tables of other dishes."""
    order = np.argsort(-customers, kind="stable")
    c, p, key = customers[order], prior[order], ids[order]
    new, step = (STRENGTH + discount * others[order]) * p, discount * p
    tables, weight = np.ones(len(c)), np.zeros(len(c))
    most, n = int(c[0]) if len(c) else 0, 1
    ascending = -c
    while n < most:
        k = int(np.searchsorted(ascending, -n))  # those with more than n customers
        group = max(1, n // 32)
        many = np.minimum(group, c[:k] - n)
        fresh = new[:k] + step[:k] * tables[:k]
        total = fresh + n - discount * tables[:k]
        tables[:k] += np.floor(many * fresh / total + uniform(key[:k], sweep, n))
        weight[:k] += many * np.log(total)
        n += group
    out = np.empty((2, len(c)))
    out[0, order], out[1, order] = np.minimum(tables, c), weight
    return out


def sweep_dishes(customers, tables, weight, prior, discount, others, ids, sweep):
    """One Metropolis-within-Gibbs move of each dish with two customers or more."""
    at = np.flatnonzero(customers > 1)
    proposed, new_weight = reseat(customers[at], prior[at], discount, others[at], ids[at], 2 * sweep)
    taken = np.log(uniform(ids[at], 2 * sweep + 1, 0) + 1e-300) < new_weight - weight[at]
    tables, weight = tables.copy(), weight.copy()
    tables[at], weight[at] = np.where(taken, proposed, tables[at]), np.where(taken, new_weight, weight[at])
    return tables, weight


def root_prediction(customers, tables, s: dict):
    """Of dishes of the root: s has its customers, tables, discount and the number of training words."""
    return (customers - s["d0"] * tables + (STRENGTH + s["d0"] * s["t0"]) / (s["words"] + 1)) / (STRENGTH + s["c0"])


# rows between buckets: from, to, and for each asked word (customers - tables) as a dish and as a context, or the owner's answer
_SENT = _schema(bucket="i", owner="i", asked="b", less="b", less_context="b")
_ANSWER = _schema(bucket="i", owner="i", c0="b", t0="b", tables="b")
_ROOT = _schema(owner="i", t0="b", weight="b", less="b", less_context="b", c0_sum="d", t0_sum="d", ones="d", twos="d", words="d", tokens="d", bucket="i", a_c0="b", a_t0="b", a_tables="b")
_SEATED = _schema(bucket="i", tables="b", weight="b", less_own="b", owner="i", asked="b", less="b", less_context="b")


def send(b: Bucket, tables: np.ndarray) -> list[tuple]:
    """What a bucket tells the owners of its dishes and of its foreign contexts: customers that have no table of their own."""
    spare = b.n - tables
    less = np.bincount(b.dish_at, spare, len(b.asked)).astype(np.int64)
    of_context = np.bincount(b.at, spare, len(b.contexts)).astype(np.int64)
    less_context = np.zeros(len(b.asked), np.int64)
    less_context[b.context_at[~b.mine]] = of_context[~b.mine]
    ends = np.cumsum(b.owner)
    rows = [(o, planes(b.asked[e - n : e], 6), planes(less[e - n : e], 6), planes(less_context[e - n : e], 6)) for o, (e, n) in enumerate(zip(ends, b.owner)) if n]
    return of_context, rows


def seat_root(state: dict, sent: list[dict], before: dict | None, own: np.ndarray, s: dict, sweep: int, buckets: int) -> pa.Table:
    """An owner's step: customers of its words in the root, their tables anew, and the answers to the buckets that asked."""
    b = Bucket(state, buckets)
    less, less_context = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
    sent = sorted(sent, key=lambda r: r["bucket"])
    places = [b.of_words(from_planes(r["asked"], 6)) for r in sent]
    for r, at in zip(sent, places):
        np.add.at(less, at, numbers(r["less"], 6))
        np.add.at(less_context, at, numbers(r["less_context"], 6))
    np.add.at(less_context, b.word_at[b.mine], own[b.mine])
    c0 = b.served - less
    if before is None:
        t0, weight = (c0 > 0).astype(float), np.full(len(c0), -np.inf)
    else:
        t0 = np.where(c0 > 0, np.clip(numbers(before["t0"], 6), 1, np.maximum(c0, 1)), 0).astype(float)
        weight = np.frombuffer(before["weight"], "<f4").astype(float)
        base = np.full(len(c0), 1 / (s["words"] + 1))
        for k in range(2):
            t0, weight = sweep_dishes(c0, t0, weight, base, s["d0"], np.maximum(s["t0"] - t0, 0), mixed(b.words), 2 * sweep + k)
    sums = (float(c0.sum()), float(t0.sum()), float((c0 == 1).sum()), float((c0 == 2).sum()), float((b.served > 0).sum()), float(b.served.sum()))
    out = [(b.bucket, planes(t0, 6), weight.astype("<f4").tobytes(), planes(less, 6), planes(less_context, 6), *sums, None, None, None, None)]
    tables = b.c - less_context
    out += [(b.bucket, *[None] * 10, r["bucket"], planes(c0[at], 6), planes(t0[at], 6), planes(tables[at], 6)) for r, at in zip(sent, places)]
    return _table(_ROOT, out)


def seat_contexts(state: dict, answers: list[dict], before: dict, s: dict, sweep: int, buckets: int) -> pa.Table:
    """A bucket's step: the tables of its pairs anew under the owners' answers, and what it tells them."""
    b = Bucket(state, buckets)
    answers = sorted(answers, key=lambda r: r["owner"])
    c0, t0, total = (np.concatenate([numbers(r[k], 6) for r in answers]) if answers else np.zeros(0, np.int64) for k in ("a_c0", "a_t0", "a_tables"))
    tables, weight = numbers(before["tables"], 6).astype(float), np.frombuffer(before["weight"], "<f4").astype(float) if before["weight"] else np.full(len(b.n), -np.inf)
    less_own = numbers(before["less_own"], 6)
    held = np.where(b.mine, b.c[b.word_at] - less_own, 0) if len(b.words) else np.zeros(len(b.contexts))
    if len(total):
        held = np.where(b.mine, held, total[b.context_at])
    prior = root_prediction(c0, t0, s)[b.dish_at] if len(b.n) else np.zeros(0)
    ids = pair_ids(b.contexts[b.at], b.dishes)
    for k in range(2):
        moved, weight = sweep_dishes(b.n, tables, weight, prior, s["d1"], np.maximum(held[b.at] - tables, 0), ids, 2 * sweep + k)
        held = held + np.bincount(b.at, moved - tables, len(b.contexts))
        tables = moved
    own, rows = send(b, tables)
    return _table(_SEATED, [(b.bucket, planes(tables, 6), weight.astype("<f4").tobytes(), planes(own, 6), None, None, None, None)] + [(b.bucket, None, None, None, *r) for r in rows])


def first_seats(state: dict, buckets: int) -> pa.Table:
    """One table for each pair."""
    b = Bucket(state, buckets)
    tables = np.ones(len(b.n))
    own, rows = send(b, tables)
    return _table(_SEATED, [(b.bucket, planes(tables, 6), b"", planes(own, 6), None, None, None, None)] + [(b.bucket, None, None, None, *r) for r in rows])


def prediction(e, context_c, context_tables, root, d1):
    """Of a dish in a context: e is its customers less discount times tables."""
    return (e + (STRENGTH + d1 * context_tables) * root) / (STRENGTH + context_c)


def score(docs: DataFrame, mod: int = 7, rest: int = 2, burn_in: int = 1, samples: int = 2, bucket_bytes: int = BUCKET_BYTES, sample: int = 20_000_000) -> DataFrame:
    """Learns from documents whose crc32(doc_id) modulo `mod` isn't `rest`; one row of scores per document."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    made = chunks(docs, buckets, hot_contexts(docs, total, buckets, sample), mod, rest)
    streams, pairs = stash_parts(made.withColumn("kind", (F.col("bucket") >= 0).cast("int")), "chunks", "kind", [0, 1])
    shuffled = pairs.select("chunk", "bucket", "words", "counts", "sizes", "dishes", "dish_at", "pairs").groupBy("bucket")
    merged = stash(shuffled.applyInArrow(lambda t: merge(t, buckets), kind_of(_MERGED)), "merged", "zstd")
    drop(pairs)
    del shuffled, made
    free_shuffles(docs.sparkSession)
    state = merged.where("words IS NOT NULL").select(*_STATE.names)
    mapped = merged.where("chunk IS NOT NULL").select(*_MAP.names)

    def stepped(left: DataFrame, right: DataFrame, by: str, work, schema: pa.Schema, name: str) -> DataFrame:
        """work(state, rows) of each bucket, written."""

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            rows = a.to_pylist()
            return work(rows[0], b.to_pylist()) if rows else schema.empty_table()

        return stash(left.groupBy("bucket").cogroup(right.groupBy(by)).applyInArrow(run, kind_of(schema)), name)

    seated = stash(state.groupBy("bucket").applyInArrow(lambda t: first_seats(t.to_pylist()[0], buckets), kind_of(_SEATED)), "seated")
    n1, n2 = state.agg(F.sum("ones"), F.sum("twos")).first()
    rate = lambda a, b: float(np.clip(a / (a + 2 * b), 0.05, 0.95)) if a else 0.5
    s = {"d1": rate(n1 or 0, n2 or 0), "d0": 0.5, "words": 0.0, "c0": 0.0, "t0": 0.0, "tokens": 0.0}
    root, kept = None, []
    for sweep in range(burn_in + samples + 1):
        if sweep:

            def contexts(row, rows, s=dict(s), sweep=sweep):
                mine = [r for r in rows if r["kind"] == 0]
                return seat_contexts(row, [r for r in rows if r["kind"] == 1], mine[0], s, sweep, buckets)

            before = seated.where("owner IS NULL").select("bucket", F.lit(0).alias("kind"), "tables", "weight", "less_own")
            answers = root.where("bucket IS NOT NULL").select("bucket", F.lit(1).alias("kind"), "owner", "a_c0", "a_t0", "a_tables")
            old, seated = seated, stepped(state, before.unionByName(answers, allowMissingColumns=True), "bucket", contexts, _SEATED, "seated")
            if sweep <= burn_in + 1:
                drop(old)

        def roots(row, rows, s=dict(s), sweep=sweep, first=root is None):
            own = next(numbers(r["less_own"], 6) for r in rows if r["kind"] == 0)
            before = next((r for r in rows if r["kind"] == 2), None)
            return seat_root(row, [r for r in rows if r["kind"] == 1], before, own, s, sweep, buckets)

        rows = seated.where("owner IS NULL").select(F.col("bucket").alias("to"), F.lit(0).alias("kind"), "less_own")
        rows = rows.unionByName(seated.where("owner IS NOT NULL").select(F.col("owner").alias("to"), F.lit(1).alias("kind"), "bucket", "asked", "less", "less_context"), allowMissingColumns=True)
        if root is not None:
            rows = rows.unionByName(root.where("bucket IS NULL").select(F.col("owner").alias("to"), F.lit(2).alias("kind"), "t0", "weight"), allowMissingColumns=True)
        old, root = root, stepped(state, rows, "to", roots, _ROOT, "root")
        if sweep <= burn_in + 1:
            drop(old)
        sums = root.agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in ("c0_sum", "t0_sum", "ones", "twos", "words", "tokens"))).first()
        s |= {"c0": sums[0], "t0": sums[1], "words": sums[4], "tokens": sums[5]}
        if not sweep:
            s["d0"] = rate(sums[2], sums[3])
        if sweep > burn_in:
            kept.append((seated, root, dict(s)))
        free_shuffles(docs.sparkSession)
    return _answered(streams, mapped, state, kept, buckets, s)


def _answered(streams: DataFrame, mapped: DataFrame, state: DataFrame, kept: list, buckets: int, s: dict) -> DataFrame:
    """The scores, from the samples."""
    answered = _schema(chunk="s", bucket="i", counts="b", words="b", kinds="b", pairs="b")
    d1, many = s["d1"], len(kept)

    def answer(maps: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        b = Bucket(next(r for r in rows if r["kind"] == -1), buckets)
        mean = sum(numbers(r["tables"], 6) for r in rows if r["tables"]) / many
        e = (b.n - d1 * mean).astype("<f4")
        roots = sorted((r for r in rows if r["t0"]), key=lambda r: r["kind"])
        columns = [numbers(r[k], 6) for r in roots for k in ("less", "t0", "less_context")]
        out = []
        for chunk, word_at, pair_at in zip(*(maps.column(c).to_pylist() for c in ("chunk", "word_at", "pair_at"))):
            at, code = numbers(word_at, 4), numbers(pair_at, 4)
            out.append((chunk, b.bucket, planes(b.c[at], 6), planes(np.concatenate([x[at] for x in columns]), 6), np.minimum(code, 2).astype(np.uint8).tobytes(), e[code[code > 1] - 2].tobytes()))
        return _table(answered, out)

    rows = state.withColumn("kind", F.lit(-1))
    for k, (seated, root, _) in enumerate(kept):
        rows = rows.unionByName(seated.where("owner IS NULL").select("bucket", F.lit(k).alias("kind"), "tables"), allowMissingColumns=True)
        rows = rows.unionByName(root.where("bucket IS NULL").select(F.col("owner").alias("bucket"), F.lit(k).alias("kind"), "t0", "less", "less_context"), allowMissingColumns=True)
    answers = mapped.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(answer, kind_of(answered))
    streams = streams.select("chunk", F.col("words").alias("owned"), F.col("counts").alias("ends"), F.col("sizes").alias("hot"), F.col("dishes").alias("hot_at"), "ids", "lengths", "held", "stream")
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    scalars = [x[2] for x in kept]
    vocabulary, trained = s["words"], int(s["tokens"])

    def add_up(streams: pa.Table, parts: pa.Table) -> pa.Table:
        row, parts = streams.to_pylist()[0], sorted(parts.to_pylist(), key=lambda r: r["bucket"])  # a chunk has one stream
        tokens, lengths = numbers(row["stream"], 4), np.frombuffer(row["lengths"], np.int64)
        _, start = np.frombuffer(row["ends"], np.int64)
        n = int(numbers(row["owned"], 4).sum())
        starts = np.cumsum(lengths) - lengths
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[starts] = start
        unique, at = np.unique(before * n + tokens, return_inverse=True)
        context, dish = unique // n, unique % n
        of_pair = np.repeat(np.arange(buckets), numbers(row["owned"], 4))[context]
        hot = np.zeros(n, bool)
        hot[np.frombuffer(row["hot"], np.int64)] = True
        of_pair[hot[context]] = numbers(row["hot_at"], 4)
        order = np.argsort(of_pair, kind="stable")
        kinds = np.concatenate([np.frombuffer(p["kinds"], np.uint8) for p in parts])
        e = np.where(kinds == 1, 1 - d1, 0.0)
        e[kinds > 1] = np.concatenate([np.frombuffer(p["pairs"], "<f4") for p in parts])
        excess = np.empty(len(unique))
        excess[order] = e
        count = np.concatenate([numbers(p["counts"], 6) for p in parts])
        served = count.copy()
        served[start] = 0
        columns = np.concatenate([numbers(p["words"], 6).reshape(3 * many, -1) for p in parts], axis=1)
        mean = np.zeros(len(unique))
        for k, sums in enumerate(scalars):
            less, t0, less_context = columns[3 * k : 3 * k + 3]
            root = root_prediction(served - less, t0, sums)
            mean += prediction(excess, count[context], (count - less_context)[context], root[dish], d1) / many
        logs = np.log10(mean)[at] if trained else np.zeros(len(tokens))
        base = np.log10((served + 1.0) / (trained + vocabulary + 1.0)) if trained else np.zeros(n)
        flags = np.frombuffer(row["held"], np.uint8)
        ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=flags > 1)
        known = np.add.reduceat((served > 0)[tokens].astype(np.int64), starts)
        columns = [ids, pa.array(flags % 2 == 1), lengths, known, np.full(len(lengths), trained), np.add.reduceat(base[tokens], starts), np.add.reduceat(logs, starts)]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=out)

    return streams.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, kind_of(out))
