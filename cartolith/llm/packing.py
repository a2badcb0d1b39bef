"""Packing documents into sequences: a configuration linear program, solved by multiplicative weights.

A configuration is a multiset of piece lengths that fits one sequence. The program covers the histogram of lengths (at
most `capacity` bins, whatever the number of pieces) with as few configurations as possible. Every length has a weight, at first its share of a sequence.
A round prices the lengths by their weights and solves the knapsack over what is still uncovered, by a dynamic program whose table gives the best
configuration around every length; of many lengths, one for each random group of about GROUP, so that they don't all ask for the same short pieces. Those within `slack` of the best, longest piece first, are taken as often as the uncovered pieces allow (whole numbers, so the
solution is rounded as it grows), and every length's weight is multiplied by exp(-ETA * the share of it that was covered): what is covered gets cheap, what stays
gets dear. A round that can take none doubles the slack. By duality, the priced value of all pieces over the dearest configuration's is a bound below which no
packing can go; the best bound found is kept. The rounds end when at most LEFT of the pieces are left or after ROUNDS; these
go by best fit into new sequences.

Pieces get their places by rank within their length: ranks come from counts per (length, salt), so that no length's pieces are
gathered, and a table of runs (length, first rank, sequence, offset), bounded by the histogram, gives the place.

Cases: a null text is an empty document and gives one piece, its end id. A null id is kept as null. Repeated rows and ids
are packed as often as they come. A text longer than the capacity is cut. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, lean, materialise, partitions
from cartolith.llm.textkernels import slices
from cartolith.llm.tokenise import encoder

ROUNDS, ETA, LEFT, GROUP = 64, 0.05, 0.01, 256
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def _cut(path: str, spaced: bool, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, spaced)
        for part in slices(batches):
            ids, at = enc.encode(part.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            size = np.diff(at)
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            bounds = np.concatenate((at[:-1][doc] + start, at[-1:])).astype(np.int64) * 4
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id").take(pa.array(doc)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start.astype(np.int64)),
                    "length": pa.array(length.astype(np.int64)),
                    "ids": blobs.cast(pa.binary()),
                }
            )

    return cut


def token_pieces(docs: DataFrame, path: str, spaced: bool, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PIECES: each document's ids with end_id after them, cut every capacity ids; ids are little-endian unsigned 32-bit."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_cut(path, spaced, end_id, capacity), PIECES)


def copies(lengths: np.ndarray, most: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(index of length, copies), longest first, so that equal prices spare the short pieces: parts of 1, 2, 4, ... copies that sum up to any
    number up to most, or to as many as fit."""
    out = []
    for i, k in reversed(list(enumerate(np.minimum(most, capacity // lengths).tolist()))):
        part = 1
        while k > 0:
            out.append((i, min(part, k)))
            k -= part
            part *= 2
    return out


def knapsack(lengths: np.ndarray, prices: np.ndarray, parts: list[tuple[int, int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best price of any choice of parts within each capacity; whether it takes each part, given those before it (parts x capacities); the last part taken, or -1."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    takes = np.zeros((len(parts), capacity + 1), bool)
    value = np.empty(capacity + 1)
    for j, (i, k) in enumerate(parts):
        size = k * int(lengths[i])
        new = np.add(best[: capacity + 1 - size], k * prices[i], out=value[: capacity + 1 - size])
        better = np.greater(new, best[size:], out=takes[j, size:])
        np.maximum(best[size:], new, out=best[size:])
        last[size:][better] = j
    return best, takes, last


def _filling(takes: np.ndarray, last: np.ndarray, parts: list[tuple[int, int]], lengths: list[int], c: int) -> dict[int, int]:
    """Copies of each index of lengths in the best choice within capacity c."""
    out: dict[int, int] = {}
    j = len(parts)
    while c > 0 and j > 0:
        at = int(last[c])
        if at >= j:  # later parts don't count: the last one before
            column = takes[:j, c][::-1]
            at = j - 1 - int(column.argmax())
            at = at if takes[at, c] else -1
        if at < 0:
            break
        j = at
        i, k = parts[j]
        out[i] = out.get(i, 0) + k
        c -= k * lengths[i]
    return out


Configuration = tuple[tuple[int, int], ...]  # (length, times), longest first


def configuration_lp(demand: dict[int, int], capacity: int, rounds: int = ROUNDS, slack: float = 1e-3) -> tuple[dict[Configuration, int], dict[int, int], float]:
    """(how often to use each configuration, pieces left of each length, a lower bound of the sequences that any packing needs)."""
    lengths = np.array(sorted(demand), np.int64)
    total = np.array([demand[x] for x in lengths.tolist()], np.int64)
    rest, log_weight, rng = total.copy(), np.zeros(len(lengths)), np.random.default_rng(11)
    used: dict[Configuration, int] = {}
    # bounds are of the whole demand; the first come from prices of which no sequence can hold more than 1: floor((k + 1) * length / capacity) / k
    # (length / capacity, where (k + 1) * length / capacity is whole)
    bound = max(float(np.where((k + 1) * lengths % capacity == 0, lengths / capacity, (k + 1) * lengths // capacity / k) @ total) for k in range(1, 6))
    for turn in range(rounds):
        if turn % 16 == 0 or turn == rounds - 1:
            prices = lengths / capacity * np.exp(log_weight - log_weight.max())
            bound = max(bound, float(prices @ total) / float(knapsack(lengths, prices, copies(lengths, total, capacity), capacity)[0][-1]))
        if rest.sum() <= LEFT * total.sum() or slack > 0.25:
            break
        here = rng.permutation(np.flatnonzero(rest))
        price = lengths / capacity * np.exp(log_weight - log_weight[here].max())
        tables = []
        for own in np.array_split(here, max(1, len(here) // GROUP)):
            own = np.sort(own)
            parts = copies(lengths[own], rest[own], capacity)
            tables.append((own, lengths[own].tolist(), parts, *knapsack(lengths[own], price[own], parts, capacity)))
        most = max(t[3][-1] for t in tables)
        before = rest.copy()
        for own, sizes, parts, best, takes, last in tables:
            good = price[own] + best[capacity - lengths[own]] >= (1 - slack) * most
            for j in np.flatnonzero(good)[::-1].tolist():
                if not rest[own[j]]:
                    continue
                content = _filling(takes, last, parts, sizes, capacity - sizes[j])
                content[j] = content.get(j, 0) + 1
                times = min(int(rest[own[i]]) // k for i, k in content.items())
                if times:
                    key = tuple(sorted(((sizes[i], k) for i, k in content.items()), reverse=True))
                    used[key] = used.get(key, 0) + times
                    for i, k in content.items():
                        rest[own[i]] -= times * k
        log_weight -= ETA * (before - rest) / total
        if (before == rest).all():
            slack *= 2
    return used, {int(k): int(v) for k, v in zip(lengths, rest, strict=True) if v}, bound


def best_fit(items: list[int], capacity: int) -> list[list[int]]:
    """Best fit over items, longest first: each goes to the fullest sequence that has room."""
    rooms: dict[int, list[int]] = {}
    keys: list[int] = []
    bins: list[list[int]] = []
    for x in sorted(items, reverse=True):
        i = bisect.bisect_left(keys, x)
        if i < len(keys):
            room = keys[i]
            b = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        room -= x
        if room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(keys, room)
            rooms[room].append(b)
    return bins


def plan(demand: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Whole numbers of configurations that hold the demand exactly."""
    chosen, rest, _ = configuration_lp(demand, capacity) if demand else ({}, {}, 0.0)
    for content in best_fit([k for k, v in rest.items() for _ in range(v)], capacity):
        key = tuple(sorted(Counter(content).items(), reverse=True))
        chosen[key] = chosen.get(key, 0) + 1
    return list(chosen.items())


def runs(chosen: list[tuple[Configuration, int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), by length and rank: rank first + i lies in sequence + i."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for key, times in chosen:
        offset = 0
        for length, copies in key:
            for _ in range(copies):
                out.append((length, rank.get(length, 0), sequence, offset))
                rank[length] = rank.get(length, 0) + times
                offset += length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def _place(table: np.ndarray):
    key = table[:, 0] << 40 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(key, length << 40 | rank, "right") - 1] if len(table) else np.zeros((len(length), 4), np.int64)
            yield pa.record_batch({"row": batch.column("row"), "sequence_id": pa.array(at[:, 2] + rank - at[:, 1]), "offset": pa.array(at[:, 3])})

    return place


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (with length, from 1 to capacity) with sequence_id and offset. Other columns of pieces stay as they are."""
    spark = pieces.sparkSession
    salts = partitions(spark)
    names = [f"`{c}`" for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = materialise(pieces.select(F.struct(*names).alias("row")).select("row", F.col("row.length").cast("long").alias("length"), F.expr(f"pmod(xxhash64(row), {salts})").alias("salt")), "pieces")
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    demand = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = runs(plan(demand, capacity))
    # one shuffle: counts and ranks both lie by (length, salt)
    ranked = rows.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64("row"))) - 1)
    ranked = ranked.join(before, ["length", "salt"]).select("row", "length", (F.col("before") + F.col("own")).alias("rank"))
    kind = rows.schema["row"].dataType.simpleString()
    return ranked.mapInArrow(lean(_place(table)), f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")
