"""Quality rules: base counts of a text, and a linear-chain conditional random field over its lines.

The field labels each line of a text content or boilerplate; Viterbi decoding finds the best labelling, and the share of words in
content lines decides whether the text is kept. Features of a line are shares of kinds of characters, its length, and whether it repeats in its
text. It is trained in numpy (exact gradients by forward-backward) on lines of a bounded sample of labelled texts: lines of texts of
quality 1 are content, of quality 0 boilerplate; the noise in that is what the chain smooths.

Cases: null or empty texts have no words, fail the base rules and are not kept. Blank lines are no lines. Without labelled rows the
field keeps every text that passes the base rules. A tie between labels is content. Rows stay as they are, repeated rows too; an empty
table gives an empty result. Other columns travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches
from cartolith.llm.textkernels import SPACE, Words, slices, span_hash, window_hash

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER, DIGIT, STOP, LETTER = (np.zeros(256, bool) for _ in range(4))
UPPER[65:91] = True
DIGIT[48:58] = True
STOP[list(b".!?;:,")] = True
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
NAMES = ("one", "symbols", "upper", "digits", "stops", "letters", "pipes", "bangs", "words", "word_length", "repeated", "ends_with_stop")


class Lines:
    """Lines with a word of a slice of texts, and the base counts of the texts."""

    def __init__(self, texts: pa.Array):
        large = pa.large_string()
        joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(large), pa.scalar("\n", large), pa.scalar("", large))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8) if len(joined) else np.zeros(1, np.int64)
        raw = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(joined) else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        self.n = len(texts)
        words = Words(texts)
        self.words = words.counts
        text = words.text_of_word()
        inside = np.concatenate(([0], np.cumsum((words.buf & 0xC0) != 0x80)))
        self.word_chars = np.bincount(text, inside[words.stop] - inside[words.start], self.n).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(SYMBOL[raw])))
        self.symbols = np.diff(upto[ends])
        self.repeat_words = self._repeats(words, text)
        # lines
        stop = np.flatnonzero(raw == 10)
        start = np.concatenate((np.zeros(1, np.int64), stop[:-1] + 1)) if len(stop) else stop
        filled = np.concatenate(([0], np.cumsum(~SPACE[raw])))
        real = filled[stop] > filled[start]
        start, stop = start[real], stop[real]
        self.text = np.searchsorted(ends, start, "right") - 1
        h = mixed = span_hash(raw, start, stop)
        order = np.lexsort((np.arange(len(h)), mixed, self.text))
        self.repeated = np.zeros(len(h), bool)
        if len(h):
            same = (h[order][1:] == h[order][:-1]) & (self.text[order][1:] == self.text[order][:-1])
            self.repeated[order[1:]] = same
        self.dup_lines = np.bincount(self.text[self.repeated], minlength=self.n)

        def count(table: np.ndarray) -> np.ndarray:
            c = np.concatenate(([0], np.cumsum(table[raw])))
            return (c[stop] - c[start]).astype(float)

        size = np.maximum(1, stop - start).astype(float)
        begins = np.concatenate((~SPACE[raw] & np.concatenate(([True], SPACE[raw][:-1])), [False])) if len(raw) else np.zeros(1, bool)
        c = np.concatenate(([0], np.cumsum(begins)))
        self.line_words = c[stop] - c[start]
        pipe, bang = np.zeros(256, bool), np.zeros(256, bool)
        pipe[124] = bang[33] = True
        w = np.maximum(1, self.line_words)
        letters = count(LETTER)
        self.features = np.stack(
            (
                np.ones(len(start)), 10 * count(SYMBOL) / size, count(UPPER) / np.maximum(1, letters), count(DIGIT) / size, 10 * count(STOP) / size, letters / size,
                count(pipe) / w, count(bang) / w, np.log1p(w) / 3, size / w / 10, self.repeated.astype(float), STOP[raw[stop - 1]].astype(float) if len(stop) else np.zeros(0),
            ),
            axis=1,
        ) if len(start) else np.zeros((0, len(NAMES)))

    def _repeats(self, words: Words, text: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(words.rest_of_text() >= 3)
        if not len(at):
            return np.zeros(self.n, np.int64)
        # equal windows of one text: by two hashes
        key = window_hash(words.hashes(), 3)[at] ^ (text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((text[at], key))
        k, t = key[order], text[at][order]
        same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        hit = np.zeros(len(words.start) + 3, np.int64)
        np.add.at(hit, at[twice], 1)
        np.add.at(hit, at[twice] + 3, -1)
        covered = np.cumsum(hit)[: len(words.start)] > 0
        return np.bincount(text[covered], minlength=self.n)


def _grid(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines by text, longest texts first: (lines in that order, for each step the texts that have it, the first line of each)."""
    n = np.bincount(text) if len(text) else np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    rows = np.flatnonzero(n)
    rows = rows[np.argsort(-n[rows], kind="stable")]
    return first[rows], n[rows], rows


def viterbi(features: np.ndarray, text: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Whether each line is content; weights: features x 2, moves: 2 x 2."""
    score = features @ weights
    first, n, _ = _grid(text)
    out = np.zeros(len(text), bool)
    if not len(text):
        return out
    back = np.zeros((len(text), 2), np.int8)
    v = score[first]
    last = np.zeros((len(n), 2))
    for s in range(1, int(n[0]) + 1):
        live = int(np.searchsorted(-n, -s, "right"))  # texts with more than... at least s lines
        more = int(np.searchsorted(-n, -(s + 1), "right"))
        last[more:live] = v[more:live]
        if not more:
            break
        step = v[:more, :, None] + moves[None]
        best = np.where(step[:, 1] >= step[:, 0], 1, 0)
        back[first[:more] + s] = best
        v = np.take_along_axis(step, best[:, None, :], 1)[:, 0] + score[first[:more] + s]
    label = (last[:, 1] >= last[:, 0]).astype(np.int64)
    end = first + n - 1
    for s in range(int(n[0]) - 1, -1, -1):
        live = int(np.searchsorted(-n, -(s + 1), "right"))
        at = first[:live] + s
        inner = at < end[:live]
        label[:live] = np.where(inner, back[np.minimum(at + 1, len(text) - 1), label[:live]], label[:live])
        out[at] = label[:live] == 1
    return out


def train(features: np.ndarray, text: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.15, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves that maximise the conditional likelihood of the labels (lines of a text stand together)."""
    w, m = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    first, n, _ = _grid(text)
    if not len(text):
        return w, m
    steps = int(n[0])
    live = [int(np.searchsorted(-n, -(s + 1), "right")) for s in range(steps)]
    truth = np.zeros((len(text), 2))
    truth[np.arange(len(text)), label.astype(int)] = 1
    inner = np.ones(len(text), bool)
    inner[first] = False
    pairs = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(pairs, (label[at - 1].astype(int), label[at].astype(int)), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(m), np.zeros_like(m)]
    for turn in range(1, rounds + 1):
        score = features @ w
        a, b = np.zeros((len(text), 2)), np.zeros((len(text), 2))
        a[first] = score[first]
        for s in range(1, steps):
            i = first[: live[s]] + s
            a[i] = score[i] + np.logaddexp(a[i - 1, 0, None] + m[0], a[i - 1, 1, None] + m[1])
        for s in range(steps - 2, -1, -1):
            i = first[: live[s + 1]] + s
            x = score[i + 1] + b[i + 1]
            b[i] = np.logaddexp(x[:, 0, None] + m[:, 0], x[:, 1, None] + m[:, 1])
        end = first + n - 1
        z = np.repeat(np.logaddexp(a[end, 0], a[end, 1]), n)
        line = np.empty(len(text), np.int64)
        line[np.repeat(first, n) + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)] = np.arange(len(text))
        z = z[line]
        p = np.exp(a + b - z[:, None])
        both = np.exp(a[at - 1][:, :, None] + m[None] + (score[at] + b[at])[:, None, :] - z[at][:, None, None]).sum(axis=0)
        gw = features.T @ (p - truth) / len(text) + penalty * w
        gm = (both - pairs) / len(text) + penalty * m
        for g, x, i in ((gw, w, 0), (gm, m, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            x -= rate * (state[i] / (1 - 0.9**turn)) / (np.sqrt(state[i + 1] / (1 - 0.99**turn)) + 1e-8)
    return w, m


def _sample_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        lines = Lines(part.column("text"))
        ids = part.column("id").take(pa.array(lines.text))
        quality = part.column("quality").take(pa.array(lines.text))
        yield pa.record_batch({"id": ids, "quality": quality, "features": pa.FixedSizeListArray.from_arrays(pa.array(lines.features.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 2000) -> tuple[np.ndarray, np.ndarray] | None:
    """Train on about sample_docs labelled texts (chosen by a hash of the id, whole texts); None without any."""
    bound_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and id is not null").distinct()
    total = known.count()
    if not total:
        return None
    known = known.where(F.expr(f"pmod(xxhash64(id, 'sample'), 1000000007) < 1000000007D * {sample_docs} / {total}"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(known, "id")
    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "text", "quality").mapInArrow(_sample_lines, f"id {kind}, quality int, features array<double>").toArrow()  # lines of the bounded sample
    if not rows.num_rows:
        return None
    ids = rows.column("id").to_numpy()
    features = np.array(rows.column("features").combine_chunks().flatten()).reshape(-1, len(NAMES))
    label = rows.column("quality").to_numpy() == 1
    order = np.argsort(ids, kind="stable")
    _, text = np.unique(ids[order], return_inverse=True)
    return train(features[order], text, label[order])


def _judge(model: tuple[np.ndarray, np.ndarray] | None, share: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines = Lines(part.column("text"))
            content = np.ones(len(lines.text), bool) if model is None else viterbi(lines.features, lines.text, *model)
            good = np.bincount(lines.text[content], lines.line_words[content], lines.n)
            portion = good / np.maximum(1, np.bincount(lines.text, lines.line_words, lines.n))
            failed = (lines.words < 50) | (100 * lines.repeat_words > 50 * lines.words)
            longs = {"n_words": lines.words, "word_chars": lines.word_chars, "n_symbols": lines.symbols, "n_dup_lines": lines.dup_lines, "n_repeat_words": lines.repeat_words}
            yield pa.record_batch(
                {"row": part.column("row")}
                | {k: pa.array(v.astype(np.int64)) for k, v in longs.items()}
                | {"base_failed": pa.array(failed), "content_share": pa.array(portion), "kept": pa.array(~failed & (portion >= share))}
            )

    return judge


def quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, share: float = 0.5, text_col: str = "text") -> DataFrame:
    """row (struct of the input's columns), the base counts, base_failed, content_share and kept."""
    bound_batches(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return whole.select(F.col("row")[text_col].cast("string").alias("text"), "row").mapInArrow(_judge(model, share), f"row {kind}, {longs}, base_failed boolean, content_share double, kept boolean")
