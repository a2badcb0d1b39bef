"""Substring dedup by super-k-mer partitioning.

A window is `width` consecutive words of one document. A word is removed if a window covers it whose word
sequence also starts in a document with a smaller id. Windows are judged on the input.

Plan:
1. A first pass counts the windows of each minimiser, by its whole hash. A task sends only minimisers that could matter: with T tasks,
   those it holds LIMIT / 2T times or more, so that what it leaves out can't add up to half of LIMIT. Minimisers of
   more than LIMIT / 2 windows by these counts are hot; LIMIT is what a bucket should hold, or so much more that no more than MAX_HOT
   can be hot, which bounds what is broadcast.
2. Documents go through in runs of about DEAL_BYTES. A run decides by itself the windows it holds in two documents or more: those outside the
   smallest are removed, and only the smallest document's travel. What is left is cut into super-k-mers: consecutive
   windows sharing a minimiser. Hot minimisers yield: a window takes its smallest minimiser that isn't hot. Super-k-mers go as packed, compressed
   strings to the bucket of their minimiser's hash. Windows of which all minimisers are hot, as of a passage that very many documents share, go by their
   own hash, and first to one of several salted buckets, so that no passage gathers in one task.
3. In a bucket all windows are sorted by hash; equal hashes are compared byte by byte, so the result is exact. A bucket of more than PASS_WINDOWS
   is taken in several passes, each over a part of the hashes. Salted buckets also send on their smallest documents' windows to the bucket proper.
4. Removed ranges are joined to the documents.

Cases: null or empty text has no words and stays as it is (kept text ""). A null id is neither smaller nor larger than any
other: such rows keep all words and remove none. Repeated rows and rows of one id don't remove one another's words.
Ties can't arise: ids order documents. An empty table gives an empty result. Other columns, whatever their names, travel
in a struct and come back on request.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, give_back, lean, lean_group, materialise, partitions
from cartolith.llm.textkernels import Words, mix, same_spans, slices, span_hash, window_hash

BUCKET_WINDOWS = 1 << 19
PASS_WINDOWS = 1 << 20
MAX_HOT = 1 << 20
KEPT_COUNTS = 1 << 21
MMER = 3
DEAL_BYTES = 4 << 20
BUCKET_TYPE = "bucket int, salt int, kind int, n int, blob binary"
TOP = np.uint64(1 << 63)


def _minimisers(h: np.ndarray, width: int, hot: np.ndarray | None = None) -> np.ndarray:
    """The smallest m-mer hash (of 63 bits) of each window. hot: sorted hashes, which stand above all others (their top bit is set)."""
    m = min(MMER, width)
    v = window_hash(h, m) & ~TOP
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if hot is not None and len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        v = np.where(hot[at] == v, v | TOP, v)
    out = v[:n].copy()
    for j in range(1, width - m + 1):
        np.minimum(out, v[j : j + n], out=out)
    return out


def _windows(words: Words, width: int) -> np.ndarray:
    """Indexes of the words at which a window starts."""
    return np.flatnonzero(words.rest_of_text() >= width)


def _exact_firsts(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, the smallest doc among the windows of the same bytes buf[lo:hi]."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.concatenate((np.ones(1, bool), hs[1:] != hs[:-1])) if len(hs) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    if not len(at):
        return doc.copy()
    del hs
    out = np.empty_like(doc)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], at), np.diff(at, append=len(h)))
    # all windows of one hash against the first of them, byte by byte
    later = np.flatnonzero(~new)
    check, head = order[later], order[at[np.searchsorted(at, later, "right") - 1]]
    del order, new, later
    differ = ~same_spans(buf, lo[check], hi[check], lo[head], hi[head])
    if differ.any():
        for value in np.unique(h[check[differ]]):  # two texts of one hash: told apart by their bytes
            same = np.flatnonzero(h == value)
            least: dict[bytes, int] = {}
            keys = [buf[lo[i] : hi[i]].tobytes() for i in same]
            for i, key in zip(same, keys, strict=True):
                least[key] = min(least.get(key, doc[i]), doc[i])
            for i, key in zip(same, keys, strict=True):
                out[i] = least[key]
    return out


def _ranges(keys: tuple[np.ndarray, ...], start: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word ranges that windows at start cover, per row of keys, joined where they touch."""
    if not len(start):
        return [k[:0] for k in keys], start[:0], start[:0]
    order = np.lexsort((start, *keys))
    keys, start = tuple(k[order] for k in keys), start[order]
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > start[:-1] + width
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(start)])) - 1
    return [k[at] for k in keys], start[at], start[last] + width


def _pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    head = struct.pack("<I", len(arrays)) + b"".join(struct.pack("<I", a.nbytes) for a in arrays)
    return zstandard.ZstdCompressor(level=9).compress(head + b"".join(a.tobytes() for a in arrays) + text)


def _unpack(blob: bytes, dtypes: tuple[type, ...]) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", raw)[0]
    sizes = struct.unpack_from(f"<{n}I", raw, 4)
    at, out = 4 + 4 * n, []
    for size, kind in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out, raw[at:]


def _count(width: int, least: float):
    """(minimiser, windows) of those that stand least times or more in a task; of null, all windows of the task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, new, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate((keys, *(x[0] for x in new)))
            out, at = np.unique(every, return_inverse=True)
            new_n = np.bincount(at, np.concatenate((n, *(x[1] for x in new))), len(out)).astype(np.int64)
            new.clear()
            return out, new_n

        def sent(all_: bool) -> pa.RecordBatch:
            pick = np.ones(len(n), bool) if all_ else n >= least
            return pa.record_batch({"minimiser": pa.array(keys[pick].view(np.int64)), "n": pa.array(n[pick])})

        for part in slices(batches):
            words = Words(part.column("text"))
            at = _windows(words, width)
            total += len(at)
            if len(at):
                new.append(np.unique(_minimisers(words.hashes(), width)[at], return_counts=True))
                if sum(len(x[0]) for x in new) > KEPT_COUNTS // 2:
                    keys, n = merged()
                    if len(keys) > KEPT_COUNTS:  # too many to hold: all of them go
                        yield sent(True)
                        keys, n = keys[:0], n[:0]
        keys, n = merged()
        yield sent(False)
        yield pa.record_batch({"minimiser": pa.array([None], pa.int64()), "n": pa.array([total], pa.int64())})

    return count


def _deal(width: int, buckets: int, salts: int, hot: np.ndarray):
    def dealt(part: pa.RecordBatch, salt: int, turn: int) -> list[tuple[int, int, int, int, bytes]]:
        """Rows of one run; a function of its own, so that no run's arrays stand while the next one's are made."""
        words = Words(part.column("text"))
        ids = part.column("doc_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        doc = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        th = part.column("th").to_numpy(zero_copy_only=False)
        at = _windows(words, width)
        row_at = words.text_of_word()[at].astype(np.int32)
        if null.any():
            at, row_at = (x[~null[row_at]] for x in (at, row_at))
        if not len(at):
            return []
        h = words.hashes()
        wh = window_hash(h, width)[at]
        doc_at = doc[row_at]
        known = doc_at > _exact_firsts(words.buf, words.start[at], words.stop[at + width - 1], wh, doc_at)
        del doc_at
        least = _minimisers(h, width, hot)[at]
        del h
        start = (at - words.first[row_at]).astype(np.int32)
        out: list[tuple[int, int, int, int, bytes]] = []
        if known.any():
            (r,), lo, hi = _ranges((row_at[known],), start[known], width)
            own = int(mix(np.array([th[r[0]] + turn]).astype(np.uint64))[0] % np.uint64(buckets))
            out.append((own, -1, 1, 0, _pack(doc[r], th[r], lo, hi)))
            at, wh, least, row_at, start = (x[~known] for x in (at, wh, least, row_at, start))
        if len(at):
            all_hot = least >= TOP
            # salted rows stand apart from the others: buckets from `buckets` on
            bucket = (np.where(all_hot, wh, mix(least)) % np.uint64(buckets)).astype(np.int64)
            bucket[all_hot] += buckets
            del wh, all_hot
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (row_at[1:] != row_at[:-1]) | (bucket[1:] != bucket[:-1])
            head = np.flatnonzero(new)
            tail = np.concatenate((head[1:], [len(at)])) - 1
            order = np.lexsort((least[head], bucket[head]))  # strings of one minimiser are alike: side by side they pack well
            head, tail = head[order], tail[order]
            a, b = words.start[at[head]], words.stop[at[tail] + width - 1]
            n = np.cumsum(np.concatenate(([0], tail - head + 1)))
            text = words.buf.tobytes()
            del words, at, least, new, tail, order
            cuts = np.flatnonzero(np.diff(bucket[head], prepend=-1)).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(head)], strict=True):
                packed = b"\n".join([text[x:y] for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)])
                r, k = row_at[head[lo:hi]], int(bucket[head[lo]])
                out.append((k % buckets, salt if k >= buckets else -1, 0, int(n[hi] - n[lo]), _pack(doc[r], th[r], start[head[lo:hi]], text=packed)))
        return out

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        salt = task.partitionId() % salts if task else 0
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for turn, part in enumerate(slices(batches, limit=DEAL_BYTES), 1):
            if out := dealt(part, salt, turn):
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "salt", "kind", "n", "blob"])
            del out
            give_back()

    return deal


def _opened(blob: bytes, width: int):
    """(doc, th, start) of a packed blob's strings; its bytes; and of each window the string, the place in it, first and last byte, and hash."""
    (doc, th, start), text = _unpack(blob, (np.int64, np.int64, np.int32))
    buf = np.frombuffer(text, np.uint8)
    line = buf == 10
    stop = np.concatenate((np.flatnonzero(line | (buf == 32)), [len(buf)]))
    begin = np.concatenate((np.zeros(1, np.int64), stop[:-1] + 1))
    ends = np.concatenate((np.searchsorted(stop, np.flatnonzero(line)) + 1, [len(stop)]))  # words up to the end of each string
    n = np.diff(ends, prepend=0)
    at = np.flatnonzero(np.repeat(ends, n) - np.arange(len(stop)) >= width)
    string = np.repeat(np.arange(len(n), dtype=np.int32), n)[at]
    place = (at - (ends - n)[string]).astype(np.int32)
    return doc, th, start, buf, string, place, begin[at], stop[at + width - 1], window_hash(span_hash(buf, begin, stop), width)[at]


def _settle(width: int):
    """One bucket: the ranges that its windows remove, and the ranges that runs decided by themselves. A salted bucket also gives its smallest
    documents' windows, packed anew."""

    def settle(table: pa.Table) -> pa.Table:
        keys: list[list[np.ndarray]] = [[], [], [], []]
        blobs = []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob"), strict=True):
            if kind == 1:
                arrays, _ = _unpack(blob.as_py(), (np.int64, np.int64, np.int32, np.int32))
                for k, a in zip(keys, arrays, strict=True):
                    k.append(a)
            else:
                blobs.append(blob)
        bucket, salt = table.column("bucket")[0].as_py(), table.column("salt")[0].as_py()
        passes = -(-sum(table.column("n").to_pylist()) // PASS_WINDOWS)
        onward: list[tuple[int, bytes]] = []
        for turn in range(passes):
            parts, bufs, size, strings = [], [], 0, 0
            owners: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for blob in blobs:
                doc, th, start, buf, string, place, lo, hi, h = _opened(blob.as_py(), width)
                if passes > 1:
                    mine = h >> np.uint64(32) & np.uint64(0xFFFFFFFF)
                    mine = mine % np.uint64(passes) == turn
                    string, place, lo, hi, h = (x[mine] for x in (string, place, lo, hi, h))
                parts.append((string + strings, place, lo + size, hi + size, h))
                owners.append((doc, th, start))
                bufs.append(buf)
                size += len(buf)
                strings += len(doc)
            if not parts:
                continue
            string, place, lo, hi, h = (np.concatenate(x) for x in zip(*parts, strict=True))
            doc, th, start = (np.concatenate(x) for x in zip(*owners, strict=True))
            parts.clear()
            owners.clear()
            buf = np.concatenate(bufs) if len(bufs) > 1 else bufs[0]
            bufs.clear()
            doc_at = doc[string]
            first = _exact_firsts(buf, lo, hi, h, doc_at)
            hit = doc_at > first
            (d, t), a, b = _ranges((doc_at[hit], th[string[hit]]), (start[string] + place)[hit].astype(np.int64), width)
            for k, x in zip(keys, (d, t, a, b), strict=True):
                k.append(x)
            if salt >= 0:  # one copy of each window, of the smallest document
                left = np.flatnonzero(~hit)
                _, pick = np.unique(h[left], return_index=True)
                once = left[pick]
                again = np.setdiff1d(left, once)
                head = once[np.minimum(np.searchsorted(h[once], h[again]), max(0, len(once) - 1))] if len(once) else once
                odd = again[~same_spans(buf, lo[again], hi[again], lo[head], hi[head])]  # two texts of one hash: both go on
                rest = np.concatenate((once, odd))
                text = buf.tobytes()
                packed = b"\n".join([text[x:y] for x, y in zip(lo[rest].tolist(), hi[rest].tolist(), strict=True)])
                s = string[rest]
                onward.append((len(rest), _pack(doc[s], th[s], (start[s] + place[rest]).astype(np.int32), text=packed)))
        d, t, a, b = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in keys)
        none = pa.nulls(len(d))
        out = {"doc_id": pa.array(d, pa.int64()), "th": pa.array(t, pa.int64()), "lo": pa.array(a.astype(np.int32)), "hi": pa.array(b.astype(np.int32)), "bucket": none.cast(pa.int32()), "n": none.cast(pa.int32()), "blob": none.cast(pa.binary())}
        found = pa.table(out)
        if onward:
            m = len(onward)
            void = pa.nulls(m)
            more = {"doc_id": void.cast(pa.int64()), "th": void.cast(pa.int64()), "lo": void.cast(pa.int32()), "hi": void.cast(pa.int32()), "bucket": pa.array([bucket] * m, pa.int32()), "n": pa.array([x[0] for x in onward], pa.int32()), "blob": pa.array([x[1] for x in onward], pa.binary())}
            found = pa.concat_tables([found, pa.table(more)])
        return found

    return settle


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = Words(part.column("text"))
        ranges = part.column("ranges")
        gone = np.zeros(len(words.start) + 1, np.int64)
        flat = ranges.flatten()
        if len(flat):
            n = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
            base = np.repeat(words.first[:-1], n)
            np.add.at(gone, base + flat.field("lo").to_numpy(zero_copy_only=False), 1)
            np.add.at(gone, base + flat.field("hi").to_numpy(zero_copy_only=False), -1)
        keep = np.cumsum(gone[:-1]) == 0
        size = np.where(keep, words.stop - words.start + 1, 0)
        text = words.text_of_word()
        total = np.bincount(text, size, len(words.first) - 1).astype(np.int64)
        n_words = words.counts
        n_kept = np.bincount(text[keep], minlength=len(n_words))
        byte = np.repeat(keep, words.stop - words.start + 1)
        final = np.flatnonzero(keep)
        if len(final):  # no space after a text's last word
            end = final[np.concatenate((text[final][1:] != text[final][:-1], [True]))]
            byte[words.stop[end]] = False
            total[text[end]] -= 1
        kept = pa.LargeStringArray.from_buffers(len(total), pa.py_buffer(np.concatenate(([0], np.cumsum(total))).astype(np.int64)), pa.py_buffer(words.buf[byte])).cast(pa.string())
        yield pa.record_batch({"kept_text": kept, "n_words": pa.array(n_words.astype(np.int64)), "n_removed": pa.array((n_words - n_kept).astype(np.int64)), "row": part.column("row")})


def hot_minimisers(slim: DataFrame, width: int, tasks: int) -> tuple[int, np.ndarray]:
    """(windows of all texts, sorted hashes of the hot minimisers)."""
    most = int(slim.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0)  # no text has more words than every second byte
    limit = max(BUCKET_WINDOWS // 2, 2 * most // MAX_HOT)
    counts = slim.select("text").mapInArrow(lean(_count(width, limit / (2 * max(1, tasks)))), "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    rows = counts.where((F.col("n") >= limit // 2) | F.col("minimiser").isNull()).toArrow()  # MAX_HOT rows at most, and the total
    whole = pc.is_null(rows.column("minimiser"))
    hot = rows.filter(pc.invert(whole)).column("minimiser").to_numpy().astype(np.int64).view(np.uint64)
    return pc.sum(rows.filter(whole).column("n")).as_py() or 0, np.sort(hot)


def removed_ranges(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, lo, hi): word ranges to remove; th is xxhash64 of the text, which tells rows of one id apart."""
    spark = docs.sparkSession
    bound_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tasks = max(1, slim.rdd.getNumPartitions())
    total, hot = hot_minimisers(slim, width, tasks)
    buckets = max(partitions(spark), -(-total // BUCKET_WINDOWS))
    dealt = slim.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(lean(_deal(width, buckets, math.isqrt(tasks) + 1, hot)), BUCKET_TYPE)
    kind = "doc_id long, th long, lo int, hi int, bucket int, n int, blob binary"
    found = dealt.groupBy("bucket", "salt").applyInArrow(lean_group(_settle(width)), kind)
    if not len(hot):
        return found.select("doc_id", "th", "lo", "hi")
    found = materialise(found, "settled")
    onward = found.where("blob is not null").select("bucket", F.lit(-1).alias("salt"), F.lit(0).alias("kind"), "n", "blob")
    last = onward.groupBy("bucket").applyInArrow(lean_group(_settle(width)), kind)
    return found.where("blob is null").union(last).select("doc_id", "th", "lo", "hi")


def substring_dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs without the words that windows of smaller ids repeat.

    Returns row (struct of the input's columns, unchanged), kept_text (words that stay, joined by one space), n_words and n_removed.
    """
    ranges = removed_ranges(docs, width, id_col, text_col).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = left.select("row", F.col("row")[id_col].cast("long").alias("k"), F.xxhash64(F.col("row")[text_col].cast("string")).alias("k_th"))
    joined = left.join(ranges, (left["k"] == ranges["doc_id"]) & (left["k_th"] == ranges["th"]), "left")
    return joined.select(F.col("row")[text_col].cast("string").alias("text"), "row", "ranges").mapInArrow(
        lean(_remove), f"kept_text string, n_words long, n_removed long, row {docs.select(F.struct(*(F.col(f'`{c}`') for c in docs.columns)).alias('row')).schema['row'].dataType.simpleString()}"
    )
