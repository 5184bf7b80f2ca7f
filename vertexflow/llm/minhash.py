"""Near-duplicate components by fast similarity sketching, banding and exact verification.

A document's set holds the 64-bit hashes of its distinct word shingles. Its sketch has `coordinates` bins that are
filled in rounds: in round i < t every element throws itself into a bin drawn by the hash of that round, in
round t + k all elements go to bin k; an earlier round beats a later one, within a round the least hash wins, and the
rounds end when every bin is filled. After at most 2t rounds no bin is empty, one round is enough for
large sets, and the share of equal coordinates of two sketches estimates the Jaccard similarity with concentration.

1. Documents with equal sets form a class, found by the digest of the set; its least id stands for it.
2. Representatives with an equal band of `rows` coordinates share a bucket. Every member is paired with the bucket's
   centre (its least id): as many pairs as members.
3. Pairs whose sketches are far below the threshold go (at 240 coordinates, 0.15 is almost six deviations); the
   others are verified on full sets. Links give components (a bounded number of edges in one
   task, more by alternating stars, cut by written tables).
4. Where the other members of a bucket still lie in different components, the documents of all such buckets are dealt
   into families (connected by buckets) and these into blocks. Pairs of blocks compare what is not linked yet on sketches
   and verify on full sets in place; they emit only the links that join components, at most one per row. So
   no pair of a bucket stays unchecked unless its ends are already linked, and no step emits all pairs of a group.

With 40 bands of 6 rows a pair at the threshold 0.8 misses every bucket with a chance of 5e-6.

Null texts and texts without words have no set: n_shingles 0, own component, kept. Texts with fewer words than a shingle
have the whole sequence as their only shingle. doc_id names a document: rows that repeat it with the same text
repeat its row. Null ids are dropped. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Memo, arrow_batch, arrow_rows, drop, lean, lower_az, small_side, stash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15
_FULL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int, words: Memo) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of A-Z lower-cased words."""
    found = WORD.findall(lower_az(text or ""))
    if not found:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(width, len(found))
    hashed = np.full(len(found) - size + 1, np.uint64(size))
    for k in range(size):
        hashed = mixed(hashed * np.uint64(0xD6E8FEB86659FD93) + codes[k : len(codes) - size + 1 + k])
    return np.unique(hashed)


def word_codes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a non-empty set; equal coordinates come from the same element but for hash collisions (47 bits at t = 240)."""
    for_bin, for_round = (t - 1).bit_length(), (2 * t - 1).bit_length()
    high, low = np.uint64(64 - for_bin), np.uint64(64 - for_bin - for_round)
    filled = np.full(t, np.uint64(_FULL))
    empty, i = t, 0
    while empty and i < 2 * t:
        many = min(max(1, 2 * t * 3 // len(items)), t - i if i < t else 2 * t - i)
        rounds = np.arange(i, i + many, dtype=np.uint64)
        g = mixed(items[None, :] + (rounds * np.uint64(_STEP) + np.uint64(1))[:, None])
        if i < t:
            bins = ((g >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        else:
            bins = np.broadcast_to((rounds - np.uint64(t))[:, None], g.shape)
        # bin, then round, then hash: sorted, the first of each bin wins
        keys = np.sort(((bins << high) | (rounds[:, None] << low) | ((g * _M1) >> np.uint64(for_bin + for_round))).ravel())
        at = (keys >> high).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        filled[at[first]] = np.minimum(filled[at[first]], keys[first] & np.uint64((1 << int(high)) - 1))
        empty = int((filled == np.uint64(_FULL)).sum())
        i += many
    return filled


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    parts = coordinates.reshape(bands, -1)
    keys = mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP))
    for k in range(parts.shape[1]):
        keys = mixed(keys * _M2 + parts[:, k])
    return keys


def features(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, sketch) of each whole text; the sketch keeps 8 mixed bits of each coordinate."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
        codes = word_codes()
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            out = []
            for text in texts:
                items = shingle_set(text, width, codes)
                if not len(items):
                    out.append((0, None, None, None))
                    continue
                coordinates = sketch(items, bands * rows)
                bits = (mixed(coordinates) & np.uint64(255)).astype(np.uint8).tobytes()
                out.append((len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), band_keys(coordinates, bands).view(np.int64), bits))
            yield arrow_batch(schema, ids, *(zip(*out) if out else [[]] * 4))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_shingles long, digest binary, keys array<long>, sketch binary")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        codes = word_codes()
        schema = pa.schema([("doc_id", pa.int64()), ("items", pa.binary())])
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            yield arrow_batch(schema, ids, [shingle_set(t, width, codes).tobytes() for t in texts])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, items binary")


def least_reachable(edges: Iterable[tuple[int, int]]) -> dict[int, int]:
    """By end of an edge the least id reachable: union by the lesser root, with paths halved."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        above[max(a, b)] = min(a, b)
    return {x: root(x) for x in above}


def components(edges: DataFrame, few: int = 100_000) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the least id reachable.

    Edges are written and counted. At most `few` are joined in one task: the plans of the rounds took more of the driver's memory than such
    edges take of a worker's. More alternate large and small stars."""
    edges = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= few:

        def run(batches):
            schema = pa.schema([("id", pa.int64()), ("component", pa.int64())])
            found = least_reachable(edge for columns in arrow_rows(batches, "a", "b") for edge in zip(*columns))
            yield arrow_batch(schema, list(found), list(found.values()))

        return edges.coalesce(1).mapInArrow(lean(run), "id long, component long")
    seen = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        before, edges = edges, stash(small.where("a <> b").distinct(), "stars")
        drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("id"), F.col("b").alias("component"))


def _verified(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those with 100 * |intersection| >= percent * |union|, written."""
    floor = percent / 100 - 0.15

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series((x == y).mean(axis=1) >= floor)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    def sides(of: DataFrame, column: str):
        return of.select(F.col("doc_id").alias("a"), F.col(column).alias("x")), of.select(F.col("doc_id").alias("b"), F.col(column).alias("y"))

    left, right = sides(sketches, "sketch")
    likely = stash(pairs.join(left, "a").join(right, "b").where(near("x", "y")).select("a", "b"), "likely")
    ends = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    sets = stash(full_sets(docs.join(small_side(ends, "ends"), "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]), "sets")
    left, right = sides(sets, "items")
    return stash(likely.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b"), "links")


def joining_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, own: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Verified links between rows of different components, only those that join two (of different blocks, if `own` has them)."""
    sizes = np.array([len(x) for x in sets])
    kinds, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(kinds)) > 1  # what one row alone has meets nothing
    width = int(shared.sum())
    packed = None
    if len(sets) * width <= 1 << 28:  # 32 MB of bits
        at = shared[column]
        number = (np.cumsum(shared) - 1)[column[at]]
        packed = np.zeros((len(sets), -(-width // 8)), np.uint8)
        np.bitwise_or.at(packed, (row[at], number >> 3), (1 << (number & 7)).astype(np.uint8))
    _, label = np.unique(component, return_inverse=True)
    floor, links = percent / 100 - 0.15, []
    for k in range(len(ids) - 1):
        rest = np.arange(k + 1, len(ids))
        fit = (label[rest] != label[k]) & (100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k]))
        if own is not None:
            fit &= own[rest] != own[k]
        rest = rest[fit]
        rest = rest[(sketches[rest] == sketches[k]).mean(axis=1) >= floor] if len(rest) else rest
        if not len(rest):
            continue
        if packed is not None:
            both = np.bitwise_count(packed[rest] & packed[k]).sum(axis=1, dtype=np.int64)
        else:
            both = np.array([np.isin(sets[k], sets[h], assume_unique=True).sum() for h in rest])
        for h in rest[100 * both >= percent * (sizes[rest] + sizes[k] - both)]:
            if label[h] != label[k]:
                links.append((max(ids[k], ids[h]), min(ids[k], ids[h])))
                label[label == label[h]] = label[k]
    return links


def _late_links(family: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """joining_links of each family (id, family, component), dealt into pairs of blocks."""
    sized = family.join(family.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")), "family")
    at = F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int")
    lanes = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: F.struct(F.least(k, at).alias("i"), F.greatest(k, at).alias("j")))
    known = sized.join(sets.withColumnRenamed("doc_id", "id"), "id").join(sketches.withColumnRenamed("doc_id", "id"), "id")
    dealt = known.withColumn("_lane", F.explode(lanes)).select("family", "id", "component", "_lane.i", "_lane.j", at.alias("own"), "items", "sketch")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        own = group["own"].to_numpy() if group["i"].iloc[0] != group["j"].iloc[0] else None
        bits = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
        found = joining_links(group["id"].to_numpy(), group["component"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["items"]], bits, own, percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return dealt.groupBy("family", "i", "j").applyInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of links at percent / 100 or more."""
    feats = stash(features(docs, width, bands, rows), "features")
    # classes of two documents or more, usually few: a group of copies is then no key of a shuffle
    classes = feats.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    classes = small_side(classes, "classes")
    classed = feats.where("n_shingles > 0").join(classes, "digest", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    class_of = stash(classed.select("doc_id", "rep"), "class-of")
    picked = classed.where(F.col("rep") == F.col("doc_id")).select("doc_id", "n_shingles", "keys", "sketch")
    reps = stash(picked.dropDuplicates(["doc_id"]), "representatives")

    rows_ = reps.select(F.explode("keys").alias("key"), F.struct(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n")).alias("member"))
    centres = rows_.groupBy("key").agg(F.min("member").alias("centre"), F.count("*").alias("size")).where("size > 1").drop("size")
    buckets = stash(rows_.join(centres, "key").where("member.id <> centre.id").select("key", "member", "centre"), "buckets")
    fits = 100 * F.least("member.n", "centre.n") >= percent * F.greatest("member.n", "centre.n")
    pairs = buckets.where(fits).select(F.col("member.id").alias("a"), F.col("centre.id").alias("b")).distinct()
    sketches = reps.select("doc_id", "sketch")
    links = _verified(pairs, docs, sketches, width, percent)
    labels = stash(components(links), "components")

    ends = buckets.select("key", F.col("member.id").alias("id"), F.col("centre.id").alias("centre"))
    lasting = ends.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    open_keys = lasting.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    edges = stash(ends.join(open_keys, "key", "left_semi").select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "open")
    if not edges.isEmpty():
        family = components(edges).withColumnRenamed("component", "family")
        family = stash(family.join(labels, "id", "left").select("id", "family", F.coalesce("component", "id").alias("component")), "families")
        sets = full_sets(docs.join(small_side(family.select(F.col("id").alias("doc_id")), "members"), "doc_id", "left_semi"), width).dropDuplicates(["doc_id"])
        more = stash(_late_links(family, sets, sketches, percent), "late")
        labels = stash(components(links.union(more)), "components")

    parts = class_of.join(labels, F.col("rep") == F.col("id"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).dropDuplicates(["doc_id"])
    return feats.select("doc_id", "n_shingles").join(parts, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stand for their component (its least id), with all their columns; repeated rows of an id once.

    Rows without an id stay. Where no id repeats, the few documents that go are joined away without moving the texts."""
    found = stash(near_duplicates(docs, width, percent), "found")
    n, ids = found.agg(F.count("*"), F.countDistinct("doc_id")).first()
    gone = small_side(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti")
    if n != ids:
        kept = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))
    return kept.select(*docs.columns)
