"""A binary token store: static range asymmetric numeral coding of token ids, in shards that are read in parallel.

A shard holds a contiguous range of document ids in ascending order. Its file (one payload):

    head      magic, precision, lanes, block size, documents, ids, distinct ids, and the sizes of the parts
    documents ids and lengths of the documents (zstd)
    table     the distinct ids and their frequencies, which sum to 2**precision (zstd): shared by all blocks of the shard
    blocks    per block: a checkpoint (place in the words, ids, checksum of its ids, the lanes' states)
    words     the 32-bit words of all blocks
    crc32     of all before it

Blocks are independent. Each interleaves LANES states, which take turns over the ids, so that decoding is a step over all lanes
of all blocks at once; a checkpoint lets any block be decoded alone (decode_blocks), and its checksum proves it.

Shards hold about SHARD_BYTES of text, whatever the corpus: the bytes of CELLS quantiles of the document id are summed, small neighbours make one shard, and a large cell
is cut by even ranges of its ids. An id that alone is too large, and null ids, spread over several shards; one text is never cut.
Every shard's table counts all its ids. Spark writes and reads the payloads (a table of binary rows), so that they lie wherever Spark can write.

Cases: null and empty texts hold only the end id. Null ids come first, in no fixed order. Rows of one id lie side by side, repeated rows
stay. A damaged payload raises an error. An empty table gives an empty store. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, lean, lean_group
from cartolith.llm.textkernels import mix, slices
from cartolith.llm.tokenise import encoder

MAGIC = b"RANSTOK1"
HEAD = "<8sIIIQQIIII"
HEAD_SIZE = struct.calcsize(HEAD)
PRECISION = 20
LANES = 32
BLOCK = 1 << 15
LOW = np.uint64(1 << 31)
SHARD_BYTES = 16 << 20
CELLS = 1024


def frequencies(count: np.ndarray, precision: int) -> np.ndarray:
    """Positive whole frequencies that sum to 2**precision, near the shares of count (all positive)."""
    total = 1 << precision
    f = np.maximum(1, count.astype(np.int64) * total // int(count.sum()))
    over = int(f.sum()) - total
    order = np.argsort(-f, kind="stable")
    if over <= 0:
        f[order[0]] -= over
    while over > 0:
        cut = np.minimum(f[order] - 1, -(-over // len(f)) + f[order] // 8)
        cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        f[order] -= cut
        over -= int(cut.sum())
    return f


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(symbols, frequencies, states: blocks x lanes, words of each block)."""
    symbols, index, count = np.unique(ids, return_inverse=True, return_counts=True)
    f = frequencies(count, PRECISION)
    c = np.cumsum(f) - f
    blocks = -(-len(ids) // BLOCK)
    steps = min(BLOCK, -(-len(ids) // LANES) * LANES) // LANES
    grid = np.full(blocks * steps * LANES, f.argmax())  # a short last block ends with the cheapest id
    grid[: len(index)] = index
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    fu, cu = f.astype(np.uint64), c.astype(np.uint64)
    x = np.full(grid.shape[1], LOW)
    words, out = np.zeros(grid.shape, np.uint32), np.zeros(grid.shape, bool)
    bits, shift = np.uint64(PRECISION), np.uint64(63 - PRECISION)
    for s in range(steps - 1, -1, -1):
        fs, cs = fu[grid[s]], cu[grid[s]]
        spill = x >= fs << shift
        words[s] = x  # the low 32 bits
        out[s] = spill
        x = np.where(spill, x >> np.uint64(32), x)
        q = x // fs
        x = (q << bits) + (x - q * fs) + cs
    words, out = words.reshape(steps, blocks, LANES), out.reshape(steps, blocks, LANES)
    return symbols, f, x.reshape(blocks, LANES), [words[:, b][out[:, b]] for b in range(blocks)]


def decode(symbols: np.ndarray, f: np.ndarray, states: np.ndarray, words: np.ndarray, starts: np.ndarray, steps: int, precision: int = PRECISION) -> np.ndarray:
    """Ids (blocks x steps x lanes) of the blocks whose words begin at starts."""
    fu = f.astype(np.uint64)
    cu = (np.cumsum(f) - f).astype(np.uint64)
    slots = np.repeat(np.arange(len(f), dtype=np.int32), f)
    x, at = states.copy(), starts.astype(np.int64).copy()
    out = np.empty((steps, *x.shape), np.int32)
    mask, bits = np.uint64((1 << precision) - 1), np.uint64(precision)
    words = np.concatenate((words, np.zeros(1, np.uint32)))
    for s in range(steps):
        slot = x & mask
        sym = slots[slot]
        out[s] = sym
        x = fu[sym] * (x >> bits) + slot - cu[sym]
        need = x < LOW
        n = np.cumsum(need, axis=1)
        w = words[np.where(need, at[:, None] + n - 1, len(words) - 1)]
        x = np.where(need, x << np.uint64(32) | w, x)
        at += n[:, -1]
    return symbols[out].transpose(1, 0, 2)


def write_shard(docs: np.ndarray, null: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The payload of a shard: documents in order, their ids one after the other."""
    z = zstandard.ZstdCompressor(level=3)
    symbols, f, states, words = encode(ids)
    n = np.full(len(words), BLOCK, np.int64)
    n[-1] = len(ids) - BLOCK * (len(words) - 1)
    first = np.cumsum([len(w) for w in words]) - [len(w) for w in words]
    raw = ids.astype("<u4")
    crc = [zlib.crc32(raw[b * BLOCK : b * BLOCK + k].tobytes()) for b, k in enumerate(n.tolist())]
    documents = z.compress(docs.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + sizes.astype("<i8").tobytes())
    table = z.compress(symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes())
    blocks = first.astype("<i8").tobytes() + n.astype("<i8").tobytes() + np.array(crc, "<u4").tobytes() + states.astype("<u8").tobytes()
    head = struct.pack(HEAD, MAGIC, PRECISION, LANES, BLOCK, len(docs), len(ids), len(symbols), len(documents), len(table), len(words))
    body = b"".join((head, documents, table, blocks, *(w.astype("<u4").tobytes() for w in words)))
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """Reader of a payload."""

    def __init__(self, payload: bytes):
        if len(payload) < HEAD_SIZE + 4 or payload[:8] != MAGIC or zlib.crc32(memoryview(payload)[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("not a whole shard of tokens")
        _, self.precision, self.lanes, self.block, n_docs, self.n_ids, n_symbols, a, b, blocks = struct.unpack_from(HEAD, payload)
        z, at = zstandard.ZstdDecompressor(), HEAD_SIZE
        raw = z.decompress(payload[at : at + a])
        self.docs, self.null, self.sizes = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs).astype(bool), np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
        raw = z.decompress(payload[at + a : at + a + b])
        self.symbols, self.f = np.frombuffer(raw, "<u4", n_symbols), np.frombuffer(raw, "<u4", n_symbols, 4 * n_symbols).astype(np.int64)
        at += a + b
        self.first, self.n = np.frombuffer(payload, "<i8", blocks, at), np.frombuffer(payload, "<i8", blocks, at + 8 * blocks)
        self.crc = np.frombuffer(payload, "<u4", blocks, at + 16 * blocks)
        self.states = np.frombuffer(payload, "<u8", blocks * self.lanes, at + 20 * blocks).reshape(blocks, self.lanes)
        at += 20 * blocks + 8 * blocks * self.lanes
        self.words = np.frombuffer(payload, "<u4", (len(payload) - 4 - at) // 4, at)

    def decode_blocks(self, lo: int, hi: int) -> np.ndarray:
        """Ids of the blocks lo:hi, without reading any other."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        end = self.first[hi] if hi < len(self.first) else len(self.words)
        steps = -(-int(self.n[lo:hi].max()) // self.lanes)
        if len(self.n) > 1:
            steps = self.block // self.lanes  # the last block is padded to the others' length
        ids = decode(self.symbols, self.f, self.states[lo:hi], self.words[self.first[lo] : end], self.first[lo:hi] - self.first[lo], steps, self.precision)
        parts = [ids[b].ravel()[: self.n[lo + b]] for b in range(hi - lo)]
        for b, part in enumerate(parts):
            if zlib.crc32(part.astype("<u4").tobytes()) != self.crc[lo + b]:
                raise ValueError(f"block {lo + b} of a shard of tokens is damaged")
        return np.concatenate(parts)

    def ids(self) -> np.ndarray:
        return self.decode_blocks(0, len(self.n))


def shard_bounds(cells: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """Ids that end the shards but the last, ascending, from (least id, greatest id, bytes) of each cell in order. An id that stands several times ends as many shards:
    its rows go to any of them."""
    out: list[int] = []
    held = 0
    for lo, hi, n in cells:
        parts = -(-n // size)
        if held and held + n > size:
            out.append(lo - 1)
            held = 0
        if parts > 1:
            out += [lo + (hi - lo) * i // parts for i in range(1, parts)] if hi > lo else [lo] * (parts - 1)
            out.append(hi)
            held = 0
        else:
            held += n
    return np.array(sorted(out), np.int64)


def _weigh(edges: np.ndarray):
    """(cell, least id, greatest id, bytes): cells lie between edges, an edge belongs to the cell that it ends."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for batch in batches:
            doc, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "size"))
            cell = np.searchsorted(edges, doc, "left")
            order = np.argsort(cell, kind="stable")
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            if not len(at):
                continue
            columns = (cell[order][at], np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at), np.add.reduceat(size[order], at))
            for c, lo, hi, n in zip(*(x.tolist() for x in columns), strict=True):
                own = found.setdefault(c, [lo, hi, 0])
                found[c] = [min(own[0], lo), max(own[1], hi), own[2] + n]
        rows = [(c, *x) for c, x in found.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["cell", "lo", "hi", "n"])

    return weigh


def _deal(path: str, spaced: bool, end_id: int, bounds: np.ndarray, shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, z = encoder(path, spaced), zstandard.ZstdCompressor(level=3)
        for part in slices(batches):
            ids, at = enc.encode(part.column("text"))
            ids = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            size = np.diff(at)
            col = part.column("doc_id")
            null = col.is_null().to_numpy(zero_copy_only=False)
            doc = pc.fill_null(col, 0).to_numpy(zero_copy_only=False)
            coin = mix(np.arange(len(doc), dtype=np.uint64) + mix(size.astype(np.uint64)) + doc.astype(np.uint64))
            lo, hi = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
            shard = lo + (coin % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
            shard = np.where(null, (coin % np.uint64(shards)).astype(np.int64) - shards, shard)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order], prepend=shard[order][0] - 1)) if len(order) else []
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                o = order[a:b]
                flat = np.concatenate([ids[at[i] : at[i + 1]] for i in o])
                planes = [(flat >> s & 255).astype(np.uint8).tobytes() for s in (0, 8, 16, 24)]  # high bytes repeat: they pack apart
                raw = struct.pack("<II", len(o), len(flat)) + doc[o].astype("<i8").tobytes() + null[o].astype(np.uint8).tobytes() + size[o].astype("<i8").tobytes() + b"".join(planes)
                rows.append((int(shard[o[0]]), z.compress(raw)))
            yield pa.record_batch({"shard": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return deal


def _write(table: pa.Table) -> pa.Table:
    z = zstandard.ZstdDecompressor()
    got = []
    for blob in table.column("blob"):
        raw = z.decompress(blob.as_py())
        m, n = struct.unpack_from("<II", raw)
        planes = np.frombuffer(raw, np.uint8, 4 * n, 8 + 17 * m).reshape(4, n).astype(np.uint32)
        got.append((np.frombuffer(raw, "<i8", m, 8), np.frombuffer(raw, np.uint8, m, 8 + 8 * m), np.frombuffer(raw, "<i8", m, 8 + 9 * m), planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24))
    doc, null, size, ids = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(doc, kind="stable")
    from_ = (np.cumsum(size) - size)[order]
    size = size[order]
    ids = ids[np.repeat(from_ - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    payload = write_shard(doc[order], null[order].astype(bool), size, ids)
    return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "n_docs": pa.array([len(doc)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})


def write_tokens(docs: DataFrame, where: str, path: str, spaced: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode all texts of docs and write the shards to the folder where."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sized = slim.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    edges = sized.select(F.percentile_approx("doc_id", [i / CELLS for i in range(1, CELLS)], 20 * CELLS)).first()[0] or []
    weighed = sized.where("doc_id is not null").mapInArrow(lean(_weigh(np.unique(np.array(edges, np.int64)))), "cell long, lo long, hi long, n long")
    cells = weighed.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).orderBy("cell").collect()  # CELLS rows at most
    bounds = shard_bounds([(r["lo"], r["hi"], r["n"]) for r in cells], shard_bytes)
    nulls = 1 + (sized.where("doc_id is null").agg(F.sum("size")).first()[0] or 0) // shard_bytes
    dealt = slim.mapInArrow(_deal(path, spaced, end_id, bounds, nulls), "shard long, blob binary")
    dealt.groupBy("shard").applyInArrow(lean_group(_write), "shard long, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(where)


def _read(before: dict[int, int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                shard = Shard(payload.as_py())
                ids = shard.ids().astype("<u4")
                ends = np.concatenate(([0], np.cumsum(shard.sizes)))
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(shard.docs), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids)])
                out = pa.record_batch({"doc_id": pa.array(shard.docs, mask=shard.null), "start": pa.array(ends[:-1] + before[number]), "n_tokens": pa.array(shard.sizes), "ids": blobs.cast(pa.binary())})
                for lo in range(0, out.num_rows, 2000):
                    yield out.slice(lo, 2000)

    return read


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files in where; start: ids of all documents before; ids: little-endian unsigned 32-bit."""
    files = spark.read.schema("shard long, n_docs long, n_ids long, payload binary").parquet(where)
    sizes = sorted((r["shard"], r["n_ids"]) for r in files.select("shard", "n_ids").collect())  # a row per shard
    before, total = {}, 0
    for shard, n in sizes:
        before[shard] = total
        total += n
    return files.select("shard", "payload").mapInArrow(lean(_read(before)), "doc_id long, start long, n_tokens long, ids binary")
