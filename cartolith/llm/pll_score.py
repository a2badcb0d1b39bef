"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Tokens are words, all of the corpus. The network, in numpy, sees the SIDE words before and after a place (never the place itself): their embeddings, one hidden
layer, and a tree of softmaxes, whose product is a proper distribution. The HEAD most frequent words are leaves of two levels (class, word). The other words of the
table, up to TABLE of them, lie in alphabetical order, so that inflections stand together, in GROUPS parts of about equal counts, which are nodes of three levels; within its part a word has
its share of the part's count. Words too rare for the table (the cut is a count, so ties go together) and words never counted share one leaf of the last part evenly. A document's score is the sum of the
log probabilities of its words.

Training: the words of all documents are counted in Spark. The tree's biases begin as the counts say; so the first model is the unigram model of the corpus. Every task
trains these first weights on its own documents, at every place (one in `stride`, where that is more than 1); the tasks' weights are averaged, weighted by their places, in groups of
FAN (a tree, so that no task and not the driver gathers more than FAN sets of weights). So weights depend on how the corpus is dealt to tasks.

The network and the table go to the workers: both have a fixed greatest size, whatever the corpus. Scoring shuffles nothing.

Cases: null or empty texts have no tokens, score 0 and mean null. Very long texts are scored in batches of places. Ties in frequency go to the smaller word.
Repeated rows are scored alike. An empty table gives an empty result (the first weights). Other columns travel in a struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, discard, lean, lean_group, materialise
from cartolith.llm.textkernels import Words, slices

FANOUT = 32
HEAD, GROUPS, TABLE = FANOUT * (FANOUT - 1), FANOUT * FANOUT, 1 << 20
INPUTS = HEAD + GROUPS  # embeddings: head words, parts; then the pad
SIDE, WIDTH, HIDDEN = 2, 16, 32
BATCH = 1 << 13
FAN = 64
SHAPES = {"embed": (INPUTS + 1, WIDTH), "w": (2 * SIDE * WIDTH, HIDDEN), "b": (HIDDEN,), "w1": (HIDDEN, FANOUT), "b1": (FANOUT,)}
SHAPES |= {"w2": (FANOUT, HIDDEN, FANOUT), "b2": (FANOUT, FANOUT), "w3": (FANOUT, HIDDEN, FANOUT), "b3": (FANOUT, FANOUT)}
NEVER = -30.0
SAFE = 60.0  # logits up to this go through exp as they are


class Vocabulary(NamedTuple):
    hashes: np.ndarray  # sorted, of the table's words
    node: np.ndarray  # of each: its number below HEAD, or HEAD + its part
    share: np.ndarray  # log of its share within its node
    rare: tuple[int, float]  # node and log share of any other word
    counts: np.ndarray  # counted words of each node


def vocabulary(words: pa.Array, n: np.ndarray, rare_kinds: int, rare_count: int) -> Vocabulary:
    """words and their counts; rare_kinds: words too rare for the table, counted rare_count times together."""
    by_word = pc.sort_indices(words).to_numpy()
    words, n = words.take(pa.array(by_word)), n[by_word].astype(np.int64)
    head = np.argsort(-n, kind="stable")[:HEAD]
    node, share = np.empty(len(n), np.int64), np.zeros(len(n))
    node[head] = np.arange(len(head))
    tail = np.setdiff1d(np.arange(len(n)), head)
    after = np.cumsum(n[tail])
    whole = int(after[-1] if len(tail) else 0) + rare_count + 1
    node[tail] = HEAD + np.minimum((after - n[tail] / 2) * GROUPS / whole, GROUPS - 1).astype(np.int64)
    counts = np.bincount(node, n, INPUTS)
    counts[INPUTS - 1] += rare_count + 1
    share[tail] = np.log(n[tail] / counts[node[tail]])
    h = Words(words).hashes()
    order = np.argsort(h)
    return Vocabulary(h[order], node[order].astype(np.int16), share[order].astype(np.float32), (INPUTS - 1, float(np.log((rare_count + 1) / counts[INPUTS - 1] / (rare_kinds + 1)))), counts)


class Index(NamedTuple):
    shift: np.uint64
    first: np.ndarray  # where the hashes begin whose leading bits are this number or more


def index(hashes: np.ndarray) -> Index:
    """Of sorted hashes: one or two numbers of leading bits for each, so that a look-up reads one or two hashes."""
    bits = max(1, len(hashes).bit_length())
    shift = np.uint64(64 - bits)
    counts = np.bincount((hashes >> shift).astype(np.int64), minlength=1 << bits)
    return Index(shift, np.concatenate(([0], np.cumsum(counts))).astype(np.int32))


def tokens(h: np.ndarray, v: Vocabulary, by: Index | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(node, log share within it) of words by their hashes. by: index(v.hashes), for callers that ask often."""
    if not len(v.hashes):
        return np.full(len(h), v.rare[0], np.int16), np.full(len(h), v.rare[1], np.float32)
    by = by or index(v.hashes)
    lead = (h >> by.shift).astype(np.int64)
    at = np.minimum(by.first.take(lead), len(v.hashes) - 1)
    known = v.hashes.take(at) == h
    left = np.flatnonzero(~known)
    end = by.first.take(lead[left] + 1)
    while len(left):
        more = at[left] + 1 < end
        left, end = left[more], end[more]
        at[left] += 1
        hit = v.hashes[at[left]] == h[left]
        known[left[hit]] = True
        left, end = left[~hit], end[~hit]
    return np.where(known, v.node.take(at), v.rare[0]).astype(np.int16, copy=False), np.where(known, v.share.take(at), v.rare[1]).astype(np.float32, copy=False)


def first_weights(v: Vocabulary | None = None, seed: int = 5) -> dict[str, np.ndarray]:
    """Small random weights; with a vocabulary, biases by its counts."""
    rng = np.random.default_rng(seed)
    w = {k: (np.zeros(s) if k in ("b", "b1", "b2", "b3") else rng.normal(0, 0.1, s)).astype(np.float32) for k, s in SHAPES.items()}
    if v is not None:
        parts = v.counts[HEAD:].reshape(FANOUT, FANOUT)
        second = np.concatenate((v.counts[:HEAD].reshape(-1, FANOUT), parts.sum(axis=1)[None]))
        for k, c in (("b1", second.sum(axis=1)), ("b2", second), ("b3", parts)):
            total = np.maximum(c.sum(axis=-1, keepdims=True), 1)
            w[k] = np.where(c > 0, np.log(np.maximum(c, 1e-9) / total), NEVER).astype(np.float32)
    return w


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Padded ids: SIDE pads before and after each text (INPUTS is the pad)."""
    n = np.diff(first)
    out = np.full(len(ids) + 2 * SIDE * len(n), INPUTS, np.int16)
    out[np.arange(len(ids)) + np.repeat(2 * SIDE * np.arange(len(n)) + SIDE, n)] = ids
    return out


def _around(padded: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.stack([padded[place + o] for o in range(-SIDE, SIDE + 1) if o], axis=1)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probability of each row's column `at`; what _slope needs (in the memory of x)."""
    if len(x) and max(x.max(), -x.min()) > SAFE:
        x -= x.max(axis=1, keepdims=True)
    pick = np.arange(0, x.size, FANOUT) + at
    out = x.ravel()[pick]
    np.exp(x, out=x)
    s = x @ np.ones(FANOUT, x.dtype)
    return out - np.log(s), (x, s, pick)


def _slope(state: tuple, n: int) -> np.ndarray:
    """Gradient of the logits of the mean negative log probability over n places."""
    x, s, pick = state
    x *= (1 / (n * s))[:, None]
    x.ravel()[pick] -= x.dtype.type(1 / n)
    return x


def _joined(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weights with the biases as those of a last input that is always 1."""
    return np.concatenate((w, b[..., None, :]), axis=-2)


def _level(h: np.ndarray, w: np.ndarray, group: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probability of each target below its own group's node; groups ascend."""
    cuts = np.searchsorted(group, np.arange(FANOUT + 1)).tolist()
    logits = np.empty((len(h), FANOUT), h.dtype)
    for c in range(FANOUT):
        lo, hi = cuts[c], cuts[c + 1]
        if hi > lo:
            np.matmul(h[lo:hi], w[c], out=logits[lo:hi])
    log_p, state = _softmax(logits, target)
    return log_p, (cuts, h, state)


def _level_back(state: tuple, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gradient of h, of w, of b) of the mean negative log probability over n places."""
    cuts, h, p = state
    g = _slope(p, n)
    g_w, out = np.zeros((FANOUT, HIDDEN + 1, FANOUT), g.dtype), np.empty((len(g), HIDDEN), g.dtype)
    for c in range(FANOUT):
        lo, hi = cuts[c], cuts[c + 1]
        if hi > lo:
            np.matmul(h[lo:hi].T, g[lo:hi], out=g_w[c])
            np.matmul(g[lo:hi], w[c].T, out=out[lo:hi])
    return out, g_w[:, :-1], g_w[:, -1]


def _ascending(w: dict[str, np.ndarray], around: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probability of each node given its neighbours; nodes ascend, so that the places of each softmax stand together."""
    x = w["embed"].take(around, axis=0).reshape(len(around), -1)
    h = np.ones((len(x), HIDDEN + 1), x.dtype)
    inner = x @ w["w"]
    inner += w["b"]
    h[:, :-1] = np.tanh(inner, out=inner)
    head = int(np.searchsorted(node, HEAD))
    part = node[head:] - HEAD
    second = np.concatenate((node[:head], HEAD + part // FANOUT))
    first = second // FANOUT
    out, s1 = _softmax(h @ _joined(w["w1"], w["b1"]), first)
    log_2, s2 = _level(h, _joined(w["w2"], w["b2"]), first, second % FANOUT)
    out += log_2
    log_3, s3 = _level(h[head:], _joined(w["w3"], w["b3"]), part // FANOUT, part % FANOUT)
    out[head:] += log_3
    return out, (x, inner, h, s1, s2, s3, head)


def forward(w: dict[str, np.ndarray], around: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log probability of each node given its neighbours."""
    order = np.argsort(node, kind="stable")
    log_p, state = _ascending(w, around[order], node[order])
    out = np.empty_like(log_p)
    out[order] = log_p
    return out, state


def gradient(w: dict[str, np.ndarray], around: np.ndarray, node: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean log probability, gradient of its negative)."""
    order = np.argsort(node, kind="stable")
    around = around[order]
    out, (x, inner, h, s1, s2, s3, head) = _ascending(w, around, node[order])
    n = len(node)
    g1 = _slope(s1, n)
    top = h.T @ g1
    grad = {"w1": top[:-1], "b1": top[-1]}
    g_h, grad["w2"], grad["b2"] = _level_back(s2, w["w2"], n)
    g_h += g1 @ w["w1"].T
    below, grad["w3"], grad["b3"] = _level_back(s3, w["w3"], n)
    g_h[head:] += below
    inner *= inner
    g_h *= np.subtract(1, inner, out=inner)
    grad["w"], grad["b"] = x.T @ g_h, np.ones(n, g_h.dtype) @ g_h
    flat = around.ravel()
    same = np.argsort(flat, kind="stable")
    flat = flat[same]
    runs = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    grad["embed"] = np.zeros_like(w["embed"])
    g_x = (g_h @ w["w"].T).reshape(-1, WIDTH).take(same, axis=0)
    pairs = g_x.view(np.result_type(g_x, np.complex64))  # two numbers are added at a time
    grad["embed"][flat[runs]] = np.add.reduceat(pairs, runs, axis=0).view(g_x.dtype)
    return float(out.mean()), grad


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def _views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        size = math.prod(shape)
        out[k] = flat[at : at + size].reshape(shape)
        at += size
    return out


def step(flat: np.ndarray, speed: np.ndarray, around: np.ndarray, node: np.ndarray, rate: float) -> float:
    """One adaptive gradient step of the weights and speed, in place; the mean log probability before it."""
    mean, grad = gradient(_views(flat), around, node)
    g = _flat(grad)
    speed *= 0.9
    part = g * g
    part *= 0.1
    speed += part
    np.sqrt(speed, out=part)
    part += 1e-6
    g *= rate
    g /= part
    flat -= g
    return mean


def _dump(w: dict[str, np.ndarray]) -> bytes:
    return _flat(w).astype("<f4").tobytes()


def _load(raw: bytes) -> dict[str, np.ndarray]:
    return _views(np.frombuffer(raw, "<f4").copy())


def _train(shipped, stride: int, batch: int, rate: float):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = Vocabulary(*cloudpickle.loads(shipped.value))
        w, by = _flat(first_weights(v)), index(v.hashes)
        speed = np.full_like(w, 1e-6)
        seen = 0
        rng = np.random.default_rng(1)
        for part in slices(batches):
            words = Words(part.column("text"))
            node, _ = tokens(words.hashes(), v, by)
            padded = contexts(node, words.first)
            within = np.arange(len(node)) - np.repeat(words.first[:-1], words.counts)
            place = np.flatnonzero(within % stride == (words.text_of_word() % stride))
            rng.shuffle(place)
            at = place + 2 * SIDE * words.text_of_word()[place] + SIDE
            for lo in range(0, len(place), batch):
                p = at[lo : lo + batch]
                step(w, speed, _around(padded, p), padded[p], rate)
            seen += len(place)
        if seen:
            task = TaskContext.get()
            yield pa.record_batch({"task": pa.array([task.partitionId() if task else 0], pa.int64()), "n": pa.array([seen], pa.int64()), "weights": pa.array([_dump(_views(w))], pa.binary())})

    return train


def _average(fan: int):
    def average(table: pa.Table) -> pa.Table:
        table, total, n = table.sort_by("task"), None, 0  # one order of adding, so that each run gives the same bits
        for k, raw in zip(table.column("n").to_pylist(), table.column("weights"), strict=True):
            part = np.frombuffer(raw.as_py(), "<f4") * np.float64(k)
            total, n = part if total is None else total + part, n + k
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // fan], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([(total / n).astype("<f4").tobytes()], pa.binary())})

    return average


def count_words(slim: DataFrame, table: int = TABLE) -> Vocabulary:
    """The vocabulary of all texts: words from the least count on at which no more than HEAD + table words are left."""
    words = slim.select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    counted = materialise(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    often = 1 << 16
    kinds = counted.groupBy(F.least("n", F.lit(often)).alias("c")).agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).orderBy(F.desc("c")).collect()  # `often` rows at most
    least, have = often + 1, 0
    for r in kinds:
        if have + r["kinds"] > HEAD + table:
            break
        least, have = r["c"], have + r["kinds"]
    if least > often:  # more words than the table holds are that frequent: the most frequent of them
        rows = counted.orderBy(F.desc("n"), "word").limit(HEAD + table).toArrow()
    else:
        rows = counted.where(F.col("n") >= least).toArrow()
    rows = rows.combine_chunks()
    discard(counted)
    n = rows.column("n").to_numpy().astype(np.int64)
    left = (sum(r["kinds"] for r in kinds) - len(n), sum(r["n"] for r in kinds) - int(n.sum()))
    column = rows.column("word")
    return vocabulary(pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string()), n, *left)


def train(docs: DataFrame, text_col: str = "text", stride: int = 1, batch: int = 2048, rate: float = 0.01, table: int = TABLE) -> tuple[Vocabulary, bytes]:
    """(vocabulary, weights)."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    v = count_words(slim, table)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(tuple(v)))
    kind = "task long, n long, weights binary"
    trained = slim.mapInArrow(lean(_train(shipped, stride, batch, rate)), kind)
    tasks = max(1, slim.rdd.getNumPartitions())
    while tasks > 1:
        trained = trained.groupBy(F.floor(F.col("task") / FAN).alias("group")).applyInArrow(lean_group(_average(FAN)), kind)
        tasks = -(-tasks // FAN)
    rows = trained.collect()  # one set of weights
    return v, bytes(rows[0]["weights"]) if rows else _dump(first_weights(v))


def _score(shipped):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, weights = cloudpickle.loads(shipped.value)
        v, w = Vocabulary(*parts), _load(weights)
        by = index(v.hashes)
        for part in slices(batches):
            words = Words(part.column("text"))
            node, share = tokens(words.hashes(), v, by)
            padded = contexts(node, words.first)
            text = words.text_of_word()
            total = np.bincount(text, share, part.num_rows)
            for lo in range(0, len(text), BATCH):
                t = text[lo : lo + BATCH]
                at = np.arange(lo, lo + len(t)) + 2 * SIDE * t + SIDE
                out, _ = forward(w, _around(padded, at), padded[at])
                total += np.bincount(t, out, part.num_rows)
            yield pa.record_batch({"row": part.column("row"), "n_tokens": pa.array(words.counts.astype(np.int64)), "pll": pa.array(total)})

    return score


def pseudo_likelihood(docs: DataFrame, model: tuple[Vocabulary, bytes], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (struct of the input's columns, or of those in keep), n_tokens, pll (sum of log probabilities, natural logarithm), pll_per_token."""
    bound_batches(docs.sparkSession)
    whole = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((tuple(model[0]), model[1])))
    out = whole.mapInArrow(lean(_score(shipped)), f"row {kind}, n_tokens long, pll double")
    return out.select("row", "n_tokens", "pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("pll_per_token"))
