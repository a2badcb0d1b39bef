"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Index: postings of the items' terms (words, lower-cased, without ASCII punctuation). An item's impacts are its BM25 weights
divided by their sum, so that one threshold serves all items: the share of an item's own score that a passage must reach. Per term
the index keeps the largest impact in each block of BLOCK items, and over all items.

Search: passages are windows of twice the longest item, each half a window after the last, so that any copy of an item lies
whole in one of them. A passage whose terms' largest impacts can't sum to the threshold is left. The others go over the terms' lists of blocks: a block whose maxima
can't reach the threshold is skipped, and none of its postings is read. In a block that is left every term has a cursor. The cursors stand in order of their items; the
first of them up to which the block's maxima reach the threshold is the pivot. Cursors before it move on to the pivot's item, for none between can
reach the threshold; where all stand on it, it is scored exactly. All passages of a run of texts take these steps together. All items at or above the threshold
are retrieved. Each is verified: the word trigrams of its question and of its answer (the last quarter of its words, where the
item is one text) must both lie in the passage to the share `overlap`.

Items of much different lengths lie in different indexes (up to 64 words, 256, 1024, ...), so that a long item doesn't stretch the passages of the others;
and an index is built from at most about INDEX_BYTES of item text, dealt by a hash of the item. All indexes use the statistics of the whole benchmark (gathered first), so
the split changes no score. A worker opens one index at a time, for runs of HELD_BYTES of text. Nothing is shuffled.

Cases: null or empty texts and items match nothing. Items shorter than three words are compared as a whole. Repeated items are
reported under each id, null item ids are left out. Rows are kept as they are, repeated ones too. Empty tables on either side give no match.
Other columns travel in a struct.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, lean
from cartolith.llm.textkernels import FOLD, Words, slices, window_hash

BLOCK = 16
INDEX_BYTES = 16 << 20
HELD_BYTES = 32 << 20
SHORTEST = 64
K1, B = 1.2, 0.75


def _spread(offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of terms all places of its list: (which of terms, place)."""
    n = offsets[terms + 1] - offsets[terms]
    who = np.repeat(np.arange(len(terms)), n)
    return who, np.repeat(offsets[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Statistics(NamedTuple):
    items: int
    words: int
    terms: np.ndarray  # sorted hashes
    df: np.ndarray

    def __add__(self, other: "Statistics") -> "Statistics":
        terms, at = np.unique(np.concatenate((self.terms, other.terms)), return_inverse=True)
        df = np.bincount(at, np.concatenate((self.df, other.df)), len(terms)).astype(np.int64)
        return Statistics(self.items + other.items, self.words + other.words, terms, df)


def statistics(texts: list[str]) -> Statistics:
    """What BM25 needs to know of all items."""
    words = Words(pa.array(texts, pa.string()), fold=FOLD)
    terms, term = np.unique(words.hashes(), return_inverse=True)
    pair = np.unique(term * max(1, len(texts)) + words.text_of_word())
    counts = words.counts
    return Statistics(int((counts > 0).sum()), int(counts.sum()), terms, np.bincount(pair // max(1, len(texts)), minlength=len(terms)))


class Index:
    """Inverted index of items (ids, texts); whole: the statistics of a benchmark that these items are a part of."""

    def __init__(self, ids: list[int], texts: list[str], whole: Statistics | None = None):
        whole = whole or statistics(texts)
        words = Words(pa.array(texts, pa.string()), fold=FOLD)
        keep = np.flatnonzero(words.counts > 0)
        self.ids = np.array(ids, np.int64)[keep]
        h = words.hashes()
        self.grams = []  # (question, answer) of each item: sorted hashes of word runs, and their run length
        for d in keep.tolist():
            own = h[words.first[d] : words.first[d + 1]]
            cut = len(own) - max(1, len(own) // 4) if len(own) > 1 else 0
            parts = (own[:cut], own[cut:]) if len(own) >= 8 else (own, own)
            self.grams.append([(min(3, len(x)), np.unique(window_hash(x, min(3, len(x))))) for x in parts])
        self.longest = int(words.counts.max()) if len(words.counts) else 0
        number = np.full(len(words.counts), -1)
        number[keep] = np.arange(len(keep))
        item = number[words.text_of_word()]
        self.terms, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term * max(1, len(keep)) + item, return_counts=True)
        term, item = pair // max(1, len(keep)), pair % max(1, len(keep))
        df = np.bincount(term, minlength=len(self.terms))
        size = words.counts[keep]
        df_all = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log1p((whole.items - df_all + 0.5) / (df_all + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(1.0, whole.words / max(1, whole.items))))
        own = np.bincount(item, impact, len(keep))
        self.impact = impact / own[item]
        self.item = item
        self.offsets = np.concatenate(([0], np.cumsum(df)))
        block, new = item // BLOCK, np.ones(len(item), bool)
        new[1:] = (block[1:] != block[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        self.block = block[at]
        self.block_from = np.concatenate((at, [len(item)]))  # postings of each entry of the lists of blocks
        self.block_max = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        self.block_offsets = np.concatenate(([0], np.cumsum(np.bincount(term[at], minlength=len(self.terms)))))
        self.most = np.maximum.reduceat(self.impact, self.offsets[:-1]) if len(self.terms) else np.zeros(0)
        self.blocks = -(-len(keep) // BLOCK)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all that reach the threshold; (passage, term) pairs are distinct and sorted by passage."""
        threshold -= 1e-9
        who, entry = _spread(self.block_offsets, term)
        key, place = np.unique(passage[who] * self.blocks + self.block[entry], return_inverse=True)
        live = np.bincount(place, self.block_max[entry], len(key)) >= threshold
        near = live[place]  # the other blocks are skipped
        place, entry = place[near], entry[near]
        bound, at, end = self.block_max[entry], self.block_from[entry], self.block_from[entry + 1]
        found = []
        while len(at):
            item = self.item[at]
            order = np.lexsort((item, place))
            place, item, bound, at, end = (x[order] for x in (place, item, bound, at, end))
            first = np.concatenate(([True], place[1:] != place[:-1]))
            group = np.cumsum(first) - 1
            heads = np.flatnonzero(first)
            upto = np.cumsum(bound)
            upto -= (upto[heads] - bound[heads])[group]
            reach = np.flatnonzero(upto >= threshold)
            pivot = np.full(len(heads), -1)  # the pivot's item, where there is one
            at_group, one = np.unique(group[reach], return_index=True)
            pivot[at_group] = item[reach[one]]
            aim = pivot[group]
            scored = (item[heads] == pivot)[group] & (item == aim)
            if scored.any():
                score = np.bincount(group[scored], self.impact[at[scored]], len(heads))
                hit = np.flatnonzero(score >= threshold)
                found.append((key[place[heads[hit]]] // self.blocks, pivot[hit], score[hit]))
            at = np.where(scored, at + 1, at)
            behind = np.flatnonzero(item < aim)
            while len(behind):  # a block's list holds BLOCK postings at most
                at[behind] += 1
                behind = behind[at[behind] < end[behind]]
                behind = behind[self.item[at[behind]] < aim[behind]]
            stay = (aim >= 0) & (at < end)
            place, bound, at, end = (x[stay] for x in (place, bound, at, end))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def verified(self, item: int, passage: np.ndarray, overlap: float) -> bool:
        """Whether the hashes of a passage's words hold enough of the item's question and of its answer."""
        return all(len(g) > 0 and np.isin(g, window_hash(passage, k)).mean() >= overlap for k, g in self.grams[item])


def search(index: Index, texts: pa.Array, threshold: float, overlap: float) -> list[tuple[int, int, float]]:
    """(text, item, best score) of all verified items."""
    words = Words(texts, fold=FOLD)
    if not len(words.start) or not len(index.ids):
        return []
    h = words.hashes()
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[at] == h)
    term = at[hit]
    stride = max(8, index.longest)
    n = -(-words.counts // stride)  # half windows of each text
    base = np.cumsum(n) - n
    text = words.text_of_word()[hit]
    half = base[text] + (hit - words.first[text]) // stride
    upper = np.bincount(half, index.most[term], int(n.sum()) + 1)
    first = np.zeros(len(upper), bool)
    first[base[n > 0]] = True
    both = upper[:-1] + np.where(first[1:], 0, upper[1:])  # passage i: the halves i and i + 1 of a text
    alive = both >= threshold - 1e-9
    if not alive.any():
        return []
    parts = [(half, term, alive[half])]
    follow = ~first[half] & alive[np.maximum(half - 1, 0)]
    parts.append((half - 1, term, follow))
    passage, term = (np.concatenate([x[i][x[2]] for x in parts]) for i in (0, 1))
    pair = np.unique(passage * len(index.terms) + term)
    found: dict[tuple[int, int], float] = {}
    owner = np.repeat(np.arange(len(n)), n)
    for p, item, score in zip(*index.retrieve(pair // len(index.terms), pair % len(index.terms), threshold), strict=True):
        d = int(owner[p])
        lo = words.first[d] + (p - base[d]) * stride
        if index.verified(int(item), h[lo : min(lo + 2 * stride, words.first[d + 1])], overlap):
            found[d, int(item)] = max(found.get((d, int(item)), 0.0), float(score))
    return [(d, i, s) for (d, i), s in sorted(found.items())]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Slices in lists of about HELD_BYTES."""
    held, size = [], 0
    for part in slices(batches):
        held.append(part)
        size += part.nbytes
        if size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _match(indexes: list, threshold: float, overlap: float):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, number = None, -1
        for held in _runs(batches):
            items: list[list[list[int]]] = [[[] for _ in range(part.num_rows)] for part in held]
            best = [[0.0] * part.num_rows for part in held]
            for i, shipped in enumerate(indexes):
                if number != i:
                    index = None
                    index, number = pickle.loads(shipped.value), i
                    shipped.__dict__.pop("_value", None)  # the bytes are read again when they are needed again
                for k, part in enumerate(held):
                    for d, item, score in search(index, part.column("text"), threshold, overlap):
                        items[k][d].append(int(index.ids[item]))
                        best[k][d] = max(best[k][d], score)
            for part, own, score in zip(held, items, best, strict=True):
                yield pa.record_batch({"row": part.column("row"), "item_ids": pa.array([sorted(x) for x in own], pa.list_(pa.int64())), "score": pa.array(score, pa.float64())})

    return match


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """row (struct of the input's columns), item_ids (of all verified items), score (the best item's share of its own BM25 score)."""
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and text is not null")
    count = F.size(F.split(F.trim("text"), r"\s+"))
    items = items.withColumn("kind", F.greatest(F.lit(0), F.ceil(F.log2(count / SHORTEST) / 2)).cast("int"))  # of lengths up to SHORTEST * 4 ** kind
    sizes = {r["kind"]: r["size"] for r in items.groupBy("kind").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    groups = [(kind, g, -(-size // INDEX_BYTES)) for kind, size in sorted(sizes.items()) for g in range(-(-size // INDEX_BYTES))]

    def group(kind: int, g: int, n: int) -> list[tuple[int, str]]:
        return sorted((r["id"], r["text"]) for r in items.where(F.expr(f"kind = {kind} and pmod(xxhash64(id), {n}) = {g}")).collect())

    common = None
    if len(groups) > 1:
        for one in groups:
            own = statistics([text for _, text in group(*one)])
            common = own if common is None else common + own
    indexes = []
    for one in groups:
        rows = group(*one)
        indexes.append(spark.sparkContext.broadcast(cloudpickle.dumps(Index([r[0] for r in rows], [r[1] for r in rows], common))))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()
    return whole.select(F.col("row")[text_col].cast("string").alias("text"), "row").mapInArrow(lean(_match(indexes, threshold, overlap)), f"row {kind}, item_ids array<long>, score double")
