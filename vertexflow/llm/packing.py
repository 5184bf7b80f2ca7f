"""Best-fit packing of token pieces into sequences by linear grouping.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut. Only the counts of
the lengths (at most `capacity` of them) come to the driver, which plans the sequences as the linear grouping scheme does:

1. lengths over `small` are sorted and dealt into groups of equal cardinality, each rounded up to its longest member;
2. configurations of the few rounded sizes are optimised by column generation (linear programme, knapsack pricing);
3. the solution is rounded down and actual lengths, each at most its rounded size, are substituted into its places,
   but for the smallest place of a configuration: it takes up what rounding had wasted and is filled by the next step;
   Some settings keep that place closed; of four settings the plan with the fewest sequences is taken;
4. whatever is left, long ones first and then the small ones, goes where it leaves the least room (best fit).

The plan is a table of intervals of (length, rank); its size depends on the capacity alone. Pieces get their
rank within their length from salted windows, so a length that a third of all rows share is no hot key.

Null texts are empty documents: one piece, the end id alone. Equal lengths are told apart by the order of
(doc_id, piece) within salts; repeated rows are packed each for itself. An empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import WordTokenizer
from .common import Memo, arrow_batch, arrow_rows, lean, stash


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each whole text's ids and the end id."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        tok = WordTokenizer(path, library=True)
        get = Memo(lambda chunk: little_endian(tok.chunk_ids(chunk)), 250_000).__getitem__
        end = little_endian([end_id])
        for keys, texts in arrow_rows(batches, "doc_id", "text"):
            rows = []
            for key, text in zip(keys, texts):
                ids = b"".join(map(get, tok.chunks(text or ""))) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield arrow_batch(schema, *(zip(*rows) if rows else [[]] * 5))

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Groups of equal cardinality, longest first: (rounded size, [[length, count], ...] longest first)."""
    total, out, room = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                room = -(-total // groups)
                out.append((length, []))
            take = min(left, room)
            out[-1][1].append([length, take])
            left, room = left - take, room - take
    return out


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The unbounded knapsack: how many of each size fill one sequence with the most worth."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gain = value[room - sizes[fits]] + worth[fits]
        k = int(gain.argmax())
        if gain[k] > value[room - 1]:
            value[room], last[room] = gain[k], fits[k]
        else:
            value[room], last[room] = value[room - 1], -2
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0 and last[room] != -1:
        if last[room] == -2:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return pattern


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Patterns of the rounded sizes and how often each is used: the linear programme's solution, rounded down."""
    sizes_, demand_ = np.array(sizes), np.array(demand, float)
    basis = np.diag((capacity // sizes_).astype(float))
    for _ in range(rounds):
        used = np.linalg.solve(basis, demand_)
        worth = np.linalg.solve(basis.T, np.ones(len(sizes_)))
        new = best_pattern(sizes_, worth, capacity)
        if new @ worth <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, new.astype(float))
        ratio = np.where(step > 1e-12, np.maximum(used, 0) / np.where(step > 1e-12, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = new
    used = np.linalg.solve(basis, demand_)
    return [(basis[:, k].astype(int), int(max(0, used[k]) + 1e-9)) for k in range(len(sizes_))]


class Plan:
    """Classes of equal sequences: [how many, room left, [(length, copies), ...]]."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = 64, small_share: float = 1 / 3, leave_open: bool = True):
        self.capacity = capacity
        left = {int(k): int(v) for k, v in counts.items() if v}
        small = int(capacity * small_share)
        self.classes: list[list] = []
        if full := left.pop(capacity, 0):
            self.classes.append([full, 0, [(capacity, 1)]])
        large = linear_groups({k: v for k, v in left.items() if k > small}, groups)
        if large:
            merged: dict[int, list] = {}
            for size, runs in large:
                merged.setdefault(size, []).extend(runs)
            large = list(merged.items())
            for pattern, times in configurations([s for s, _ in large], [sum(n for _, n in runs) for _, runs in large], capacity):
                if leave_open and pattern.sum() > 1:  # its smallest place stays open for whatever fits best
                    pattern[np.flatnonzero(pattern)[-1]] -= 1
                self._substitute(pattern, times, [runs for _, runs in large], left)
        self._best_fit(left)

    def _substitute(self, pattern: np.ndarray, times: int, runs: list, left: dict[int, int]) -> None:
        """Actual lengths take the places of the rounded ones, as long as there are any."""
        while times > 0:
            many, content = times, []
            for g in np.flatnonzero(pattern):
                if runs[g] and runs[g][0][1] >= pattern[g]:
                    many = min(many, runs[g][0][1] // int(pattern[g]))
                else:
                    many = 1
            for g in np.flatnonzero(pattern):
                places = int(pattern[g])
                while places and runs[g]:
                    length, there = runs[g][0]
                    copies = min(places, there // many)
                    content.append((length, copies))
                    runs[g][0][1] -= copies * many
                    left[length] -= copies * many
                    places -= copies
                    if not runs[g][0][1]:
                        runs[g].pop(0)
            if not content:
                return
            self.classes.append([many, self.capacity - sum(a * b for a, b in content), content])
            times -= many

    def _best_fit(self, left: dict[int, int]) -> None:
        by_room: dict[int, list[list]] = {}
        for c in self.classes:
            by_room.setdefault(c[1], []).append(c)
        for length in sorted((k for k, v in left.items() if v > 0), reverse=True):
            todo = left[length]
            for room in range(length, self.capacity):
                while todo and by_room.get(room):
                    c = by_room[room].pop()
                    copies = min(room // length, todo)
                    many = min(c[0], todo // copies)
                    if many < c[0]:  # the others stay as they are
                        rest = [c[0] - many, room, list(c[2])]
                        self.classes.append(rest)
                        by_room[room].append(rest)
                        c[0] = many
                    c[1], c[2] = room - copies * length, [*c[2], (length, copies)]
                    by_room.setdefault(c[1], []).append(c)
                    todo -= many * copies
                if not todo:
                    break
            while todo:
                copies = min(self.capacity // length, todo)
                many = todo // copies
                c = [many, self.capacity - copies * length, [(length, copies)]]
                self.classes.append(c)
                by_room.setdefault(c[1], []).append(c)
                todo -= many * copies

    @property
    def sequences(self) -> int:
        return sum(c[0] for c in self.classes)

    def intervals(self) -> dict[int, np.ndarray]:
        """By length, rows (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
        rows: dict[int, list] = {}
        ranks: dict[int, int] = {}
        base = 0
        for many, _, content in self.classes:
            at = 0
            for length, copies in content:
                rank = ranks.get(length, 0)
                rows.setdefault(length, []).append((rank, base, copies, at))
                ranks[length] = rank + many * copies
                at += length * copies
            base += many
        return {k: np.array(v, np.int64) for k, v in rows.items()}


#: Groups, share of the capacity up to which lengths are small, whether a configuration's smallest place stays open.
SETTINGS = ((64, 1 / 3, True), (64, 1 / 3, False), (64, 1 / 8, False), (32, 1 / 4, True))


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences of a few settings; one within a ten-thousandth of the sum of lengths needs no other."""
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    best = None
    for groups, share, leave_open in SETTINGS:
        plan = Plan(counts, capacity, groups, share, leave_open)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= least + least // 10_000:
            break
    return best


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_salt: int = 50_000) -> DataFrame:
    """Adds (sequence_id, offset) to rows with (doc_id, piece, length); lengths from 1 to capacity."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    table = best_plan(counts, capacity).intervals()
    salts = 16 + sum(counts.values()) // rows_per_salt
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(firsts, ["length", "_salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length_, rank_ = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(length_)), np.int64)
        for value in np.unique(length_):
            at, rows = np.flatnonzero(length_ == value), table[int(value)]
            hit = rows[np.searchsorted(rows[:, 0], rank_[at], "right") - 1]
            k = rank_[at] - hit[:, 0]
            out[0, at], out[1, at] = hit[:, 1] + k // hit[:, 2], hit[:, 3] + k % hit[:, 2] * value
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = ranked.withColumn("_at", place("length", F.col("_own") + F.col("_first")))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    """Whole documents into sequences: one row per piece. Pieces are written once, as the plan and the result need them."""
    return pack(stash(cut_pieces(docs, path, capacity), "pieces"), capacity)
