"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

The two supported vocabularies split a text before they merge: never inside a run of letters, and always where white space
meets a word. So the ids of a text are the ids of its pieces one after the other. A piece is a word with its trailing
ASCII punctuation apart (after a letter or digit only, where the split is certain) and, for the vocabulary that keeps
white space ("spaced"), with the one space before it; the rest of each white-space run is a piece of its own. Texts in which
this does not hold (white space beyond ASCII, strings of special tokens) are encoded whole.

Pieces are known by two independent 64-bit hashes. The cache is bounded by CACHE_WORDS and emptied when full; a run of texts with more distinct pieces than
that gets a table of its own size for as long as it needs one.

Cases: a null text is empty; an empty or blank one has the ids of its white space, if the vocabulary keeps that, else none.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cartolith.llm.shared import worker_cache
from cartolith.llm.textkernels import SPACE, span_hash

CACHE_WORDS = 1 << 21
WHOLE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|<[|]"
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b".,;:!?#$%&*|")] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


class Pieces:
    """Ids of pieces by hash: open addressing over numpy arrays."""

    def __init__(self) -> None:
        self.slot = np.zeros(0, np.int32)
        self.clear()

    def clear(self, room: int = 0) -> None:
        """Empty, with a table for room pieces, or for CACHE_WORDS if those are more."""
        size = 2 << max(room - 1, CACHE_WORDS - 1, 1).bit_length()
        if size != len(self.slot):
            self.slot = np.empty(size, np.int32)
        self.slot[:] = -1
        self.mask = np.uint64(size - 1)
        self.n = 0
        self.key = np.zeros((2, 1 << 16), np.uint64)
        self.off = np.zeros((1 << 16) + 1, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        todo, at = np.arange(len(h)), h & self.mask
        while len(todo):
            s = self.slot[at]
            have = s >= 0
            hit = have & (self.key[0, s] == h[todo]) & (self.key[1, s] == g[todo])
            out[todo[hit]] = s[hit]
            go = have & ~hit
            todo, at = todo[go], (at[go] + np.uint64(1)) & self.mask
        return out

    def add(self, h: np.ndarray, g: np.ndarray, lists: list[list[int]]) -> None:
        """Distinct pieces that find() does not know."""
        m, size = len(h), np.array([len(x) for x in lists], np.int64)
        end = self.off[self.n] + int(size.sum())
        if self.n + m > self.key.shape[1]:
            room = max(2 * self.key.shape[1], self.n + m)
            self.key = np.concatenate((self.key, np.zeros((2, room - self.key.shape[1]), np.uint64)), axis=1)
            self.off = np.concatenate((self.off, np.zeros(room + 1 - len(self.off), np.int64)))
        if end > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), np.uint32)))
        self.key[0, self.n : self.n + m], self.key[1, self.n : self.n + m] = h, g
        self.ids[self.off[self.n] : end] = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
        self.off[self.n + 1 : self.n + m + 1] = self.off[self.n] + np.cumsum(size)
        todo, at = np.arange(self.n, self.n + m), h & self.mask
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            put = self.slot[at] == todo
            todo, at = todo[~put], (at[~put] + np.uint64(1)) & self.mask
        self.n += m


class Encoder:
    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.spaced, self.pieces = spaced, Pieces()
        self.tokenizer = Tokenizer.from_file(path)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spans(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in order; raw holds the texts, each followed by one space that is not part of it."""
        space = SPACE[raw]
        start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        stop = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
        core = stop.copy()
        for _ in range(8):
            more = (core > start) & PUNCTUATION[raw[core - 1]]
            if not more.any():
                break
            core -= more
        ok = (core > start) & (core < stop)
        c1, c0 = raw[core - 1], raw[np.maximum(core - 2, 0)]
        latin = (c0 >= 0xC3) & (c0 <= 0xC5) & (c1 >= 0x80) & (c1 < 0xC0) & ~((c0 == 0xC3) & ((c1 == 0x97) | (c1 == 0xB7))) & (core - 2 >= start)
        core = np.where(ok & (ALNUM[c1] | latin), core, stop)
        if self.spaced:
            begin = start - ((start > 0) & (raw[start - 1] == 32) & ~np.isin(start, ends))
            parts = [(begin, core), (core, stop)]
            if len(raw):
                white = space.copy()
                white[begin[begin < start]] = False  # the space that goes with a word
                white[ends[1:] - 1] = False  # the space after each text
                lo = np.flatnonzero(white & ~np.concatenate(([False], white[:-1])))
                hi = np.flatnonzero(white & ~np.concatenate((white[1:], [False]))) + 1
                # a run that a word follows directly gives its last character apart
                cut = np.where((hi < len(raw)) & ~space[np.minimum(hi, len(raw) - 1)] & (hi - lo > 1), hi - 1, hi)
                parts += [(lo, cut), (cut, hi)]
        else:
            parts = [(start, core), (core, stop)]
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b = a[b > a], b[b > a]
        order = np.argsort(a, kind="stable")
        return a[order], b[order]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids start (with the end). Null is empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False)
        large = pa.large_string()
        plain = pc.if_else(pa.array(whole), "", texts).cast(large)
        joined = pc.binary_join_element_wise(plain, pa.scalar(" ", large), pa.scalar("", large))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
        raw = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        a, b = self._spans(raw, ends)
        h, g = span_hash(raw, a, b), span_hash(raw, a, b, 1)
        found = self.pieces.find(h, g)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            _, pick = np.unique(h[new] ^ (g[new] * np.uint64(3)), return_index=True)
            pick = new[pick]
            if self.pieces.n + len(pick) > CACHE_WORDS:
                _, pick = np.unique(h ^ (g * np.uint64(3)), return_index=True)
                self.pieces.clear(len(pick))
            data = raw.tobytes()
            for lo in range(0, len(pick), 20000):
                p = pick[lo : lo + 20000]
                self.pieces.add(h[p], g[p], self._encode([data[x:y].decode() for x, y in zip(a[p].tolist(), b[p].tolist(), strict=True)]))
            found = self.pieces.find(h, g)
        size = self.pieces.off[found + 1] - self.pieces.off[found]
        at = np.repeat(self.pieces.off[found] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, size) + np.arange(int(size.sum()))
        ids = self.pieces.ids[at]
        upto = np.concatenate(([0], np.cumsum(size)))
        bounds = upto[np.searchsorted(a, ends)]
        if whole.any():
            rows = np.flatnonzero(whole)
            own = self._encode(texts.take(pa.array(rows)).to_pylist())
            parts, at = [], 0
            n = np.diff(bounds)
            for r, x in zip(rows, own, strict=True):
                parts += [ids[bounds[at] : bounds[r]], np.array(x, np.uint32)]
                at, n[r] = r, len(x)
            ids = np.concatenate([*parts, ids[bounds[at] :]])
            bounds = np.concatenate(([0], np.cumsum(n)))
        return ids, bounds


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder."""
    return worker_cache("encoder", f"{path} {spaced}", lambda: Encoder(path, spaced))
