"""Numpy kernels over Arrow string batches: words, hashes, shingles.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. Every kernel works on whole texts, in slices of
bounded size: a slice holds whole documents, and more than SLICE_BYTES only if one document does.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
CHUNK = 1 << 17
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLD = LOWER.copy()  # case and ASCII punctuation folded away
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32
BYTE_HASH = np.random.default_rng(20240229).integers(0, 2**64, (2, 256), dtype=np.uint64)
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD[which] ** i and its inverse, for i < n, mod 2**64."""
    have = _powers.get(which)
    if have is not None and have.shape[1] >= n:
        return have[0], have[1]
    m = max(n, CHUNK)
    base = int(ODD[which])
    out = np.empty((2, m), np.uint64)
    for row, b in ((0, base), (1, pow(base, -1, 2**64))):
        out[row] = np.uint64(b)
        out[row, 0] = 1
        np.multiply.accumulate(out[row], out=out[row])
    if m == CHUNK:
        _powers[which] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of whole rows of at most limit bytes of column (more only for one long row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo = 0
        while lo < n:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of a slice of texts.

    buf holds all words of all texts, each followed by one space; word i is buf[start[i]:stop[i]];
    text d has the words first[d]:first[d + 1].
    """

    def __init__(self, texts: pa.Array, lower: bool = False, fold: np.ndarray | None = None):
        """lower: A-Z become a-z. fold: any other table of 256 bytes to put in the bytes' place."""
        large = pa.large_string()
        joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(large), pa.scalar(" ", large), pa.scalar("", large))
        if len(joined) == 0:
            self.buf, self.start, self.stop, self.first = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
            return
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        raw = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        table = LOWER if lower else fold
        if table is not None:
            raw = table[raw]
        space = SPACE[raw]
        last = space.copy()
        last[1:] &= ~space[:-1]
        last[0] = False  # spaces that end a word
        keep = ~space | last
        self.buf = raw[keep]
        self.buf[SPACE[self.buf]] = 32
        self.stop = np.flatnonzero(self.buf == 32)
        self.start = np.concatenate((np.zeros(1, np.int64), self.stop[:-1] + 1)) if len(self.stop) else np.zeros(0, np.int64)
        self.first = np.searchsorted(np.flatnonzero(last), ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        return span_hash(self.buf, self.start, self.stop, which)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def rest_of_text(self) -> np.ndarray:
        """Words from each word on, to the end of its text."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def span_hash(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes (in ascending order), the same wherever the span stands.

    The spans go in chunks of about CHUNK bytes of buf, so that what is held beside buf stays small.
    """
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        at = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(stop, at + CHUNK, "right")))
        s, e = start[lo:hi] - at, stop[lo:hi] - at
        up, down = powers(which, int(e[-1]))
        with np.errstate(over="ignore"):
            v = BYTE_HASH[which][buf[at : at + int(e[-1])]]
            v *= up[: len(v)]
            np.cumsum(v, out=v)
            h = v[e - 1]
            inner = s > 0
            h[inner] -= v[s[inner] - 1]
            h *= down[s]
            out[lo:hi] = mix(h + (e - s).astype(np.uint64) * ODD[1 - which])
        lo = hi
    return out


def window_hash(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive values of h; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = np.uint64(int(ODD[1 - which]) | 1)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for j in range(1, k):
            out *= p
            out += h[j : j + n]
        return mix(out)


def same_spans(buf: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """Whether the bytes a0:a1 equal the bytes b0:b1, for each pair of spans; about chunk bytes at once, each of which takes some 50 more."""
    same = (a1 - a0) == (b1 - b0)
    todo = np.flatnonzero(same)
    size = np.cumsum((a1 - a0)[todo])
    lo = 0
    while lo < len(todo):
        base = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, base + chunk, "right")))
        part = todo[lo:hi]
        n = (a1 - a0)[part]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        equal = buf[np.repeat(a0[part], n) + at] == buf[np.repeat(b0[part], n) + at]
        bad = np.repeat(np.arange(len(part)), n)[~equal]
        same[part[bad]] = False
        lo = hi
    return same
