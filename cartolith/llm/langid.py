"""Language identification with interpolated Kneser-Ney character models.

Per language a model of order ORDER over the characters of lower-cased words, each word between spaces; a history does not reach
beyond its word. Counts come from a sample of labelled documents bounded by `sample_docs` per language (chosen by a hash,
the same for every run). All languages' n-grams lie in one sorted array of 64-bit hashes per length, with a column of log
probabilities and one of back-off weights for each language, so one search serves all languages.

A text's score in a language is the mean log probability of its characters (length-normalised cross-entropy); the lowest entropy
wins. Words are scored once per worker (a bounded cache by hash). Rejection is calibrated: a text is rejected if its entropy exceeds
`slack` times what a share of 1 - `reject_share` of the language's documents stays under (more for short texts, whose entropy
varies: in proportion to 1 + SHORT / characters), or if it has no letter. These documents (about `calibration_docs` a language, chosen by another hash)
are none of the sample that the counts come from.

Cases: null, empty and letterless texts are "und", score 0 and rejected. Rows without a label or without an id are not learned, every label is: model and sample grow with the number of labels. A language without documents for
calibration rejects nothing by entropy. With no labelled document all texts are
"und". Equal scores go to the language first in order. Rows stay as they are, repeated rows too; an empty table gives an empty result.
Other columns travel in a struct.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.shared import bound_batches, worker_cache
from cartolith.llm.textkernels import Words, mix, slices

ORDER = 5
CACHE_WORDS = 1 << 20
COINS = 1_000_000_007
SHORT = 16
UNSEEN = float(np.log(1e-5))  # of a character that no sample holds
MULT = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of " word word ... " and for each the distance from the space before its word (0 for a space)."""
    text = " " + " ".join(words).lower() + " "
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.flatnonzero(codes == 32)
    depth = np.arange(len(codes)) - space[np.searchsorted(space, np.arange(len(codes)), "right") - 1]
    gap = np.diff(space)
    depth[space[1:]] = gap  # a space ends its word as well as it begins the next
    depth[0] = 0
    return codes, depth


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters up to each place (of fewer at the beginning, which no caller reads)."""
    with np.errstate(over="ignore"):
        h = np.full(len(codes), n, np.uint64)
        for j in range(n - 1, -1, -1):
            c = codes.astype(np.uint64)
            if j:
                c = np.concatenate((np.zeros(j, np.uint64), c[:-j]))
            h = mix(h * MULT + c)
    return h


def kneser_ney(words: list[str], counts: np.ndarray, order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length 1..order: (hashes, log probability or nan, log back-off weight or nan)."""
    codes, depth = _codes(words)
    number = np.cumsum(codes == 32) - 1  # of the word that begins with this space or holds this place
    number = np.where(codes == 32, number - 1, number)
    weight = np.where(number >= 0, counts[np.clip(number, 0, len(counts) - 1)], 0).astype(float)
    event = depth >= 1
    hashes = [None, *(_grams(codes, n) for n in range(1, order + 1))]
    # the counts of each length: raw at the highest and where a gram begins its word, else the number of grams that extend it
    tables = []
    lower: tuple[np.ndarray, np.ndarray] | None = None  # probabilities of the length below
    for n in range(1, order + 1):
        at = np.flatnonzero(event & (depth >= n - 1))
        keys, first, inverse = np.unique(hashes[n][at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight[at], len(keys))
        if n < order:
            wider = np.flatnonzero(event & (depth >= n))
            _, one = np.unique(hashes[n + 1][wider], return_index=True)
            kinds = np.bincount(np.searchsorted(keys, hashes[n][wider[one]]), minlength=len(keys))
            begins = depth[at[first]] == n - 1
            count = np.where(begins | (kinds == 0), count, kinds)
        place = at[first]
        if n == 1:
            context, inside = np.zeros(1, np.uint64), np.zeros(len(keys), np.int64)
        else:
            context, inside = np.unique(hashes[n - 1][place - 1], return_inverse=True)
        total = np.bincount(inside, count, len(context))
        kinds = np.bincount(inside, minlength=len(context))
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        below = np.full(len(keys), np.exp(UNSEEN)) if n == 1 else lower[1][np.searchsorted(lower[0], hashes[n - 1][place])]
        p = np.maximum(count - discount, 0) / total[inside] + back[inside] * below
        lower = (keys, p)
        tables.append((keys, np.log(p), context, np.log(back)))
    out = []
    for n in range(1, order + 1):
        keys, logp = tables[n - 1][:2]
        context, back = tables[n][2:] if n < order else (keys[:0], logp[:0])
        every = np.union1d(keys, context)
        a, b = np.full(len(every), np.nan), np.full(len(every), np.nan)
        a[np.searchsorted(every, keys)] = logp
        b[np.searchsorted(every, context)] = back
        out.append((every, a, b))
    return out


class Model:
    """Models of several languages over shared sorted hash arrays."""

    def __init__(self, words: dict[str, tuple[list[str], np.ndarray]]):
        self.langs = sorted(words)
        self.limits = np.full(len(self.langs), np.inf)
        single = [kneser_ney(*words[k]) for k in self.langs]
        self.keys, self.logp, self.back = [], [], []
        for n in range(ORDER):
            every = np.unique(np.concatenate([m[n][0] for m in single])) if single else np.zeros(0, np.uint64)
            a, b = (np.full((len(every) + 1, len(single)), np.nan, np.float32) for _ in range(2))  # the last row: of no gram
            for j, m in enumerate(single):
                at = np.searchsorted(every, m[n][0])
                a[at, j], b[at, j] = m[n][1], m[n][2]
            self.keys.append(every)
            self.logp.append(a)
            self.back.append(b)
        self.digest = hashlib.blake2b(repr(self.langs).encode() + b"".join(x.tobytes() for t in (self.keys, self.logp, self.back) for x in t)).hexdigest()

    def score_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability in each language, characters with the space after) of each word."""
        codes, depth = _codes(words)
        score = np.full((len(codes), len(self.langs)), UNSEEN, np.float32)
        found = None
        for n in range(1, ORDER + 1):
            h, keys = _grams(codes, n), self.keys[n - 1]
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            at = np.where(keys[at] == h, at, -1) if len(keys) else np.full(len(h), -1)
            open_ = (depth >= max(1, n - 1))[:, None]
            p = self.logp[n - 1][at]
            if n > 1:
                before = np.concatenate(([-1], found[:-1]))
                g = self.back[n - 2][before]
                score = np.where(open_, np.where(np.isnan(p), score + np.nan_to_num(g), p), score)
            else:
                score = np.where(open_ & ~np.isnan(p), p, score)
            found = at
        space = np.flatnonzero(codes == 32)
        total = np.add.reduceat(np.where((depth >= 1)[:, None], score, 0)[1:], space[:-1], axis=0)
        return total, np.diff(space)


class _Cache:
    """Word scores of one model in a worker."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.keys, self.score, self.size = np.zeros(0, np.uint64), np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int32)

    def look(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        h = words.hashes()
        own, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] == own
        if not known.all():
            if len(self.keys) + len(own) > CACHE_WORDS:
                self.clear()
                known[:] = False
            raw, new = words.buf.tobytes(), np.flatnonzero(~known)
            score, size = [], []
            for lo in range(0, len(new), 20000):
                s, z = self.model.score_words([raw[words.start[i] : words.stop[i]].decode() for i in first[new[lo : lo + 20000]].tolist()])
                score.append(s)
                size.append(z)
            keys = np.concatenate((self.keys, own[new]))
            order = np.argsort(keys)
            self.keys = keys[order]
            self.score = np.concatenate((self.score, *score))[order]
            self.size = np.concatenate((self.size, *size))[order]
            at = np.searchsorted(self.keys, own)
        return self.score[at][inverse], self.size[at][inverse]


def _cache(model: Model) -> _Cache:
    return worker_cache("languages", model.digest, lambda: _Cache(model))


def _predict(shipped):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = pickle.loads(shipped.value)
        shipped.__dict__.pop("_value", None)
        cache = _cache(model)
        model = cache.model  # one copy in the worker
        for part in slices(batches):
            texts = part.column("text")
            words = Words(texts)
            n = part.num_rows
            letter = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
            langs, k = np.array([*model.langs, "und"], object), len(model.langs)
            if k:
                score, size = cache.look(words)
                text = words.text_of_word()
                chars = np.maximum(1, np.bincount(text, size, n))
                entropy = np.stack([-np.bincount(text, score[:, j], n) / chars for j in range(k)], axis=1)
                best = entropy.argmin(axis=1)
                low = entropy[np.arange(n), best]
                share = 1 / np.exp(8 * (low[:, None] - entropy)).sum(axis=1)
                best = np.where(letter, best, k)
                rejected = ~letter | (low > model.limits[np.minimum(best, k - 1)] * (1 + SHORT / chars))
            else:
                best, low, share, rejected = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
            yield pa.record_batch(
                {"row": part.column("row"), "lang_pred": pa.array(langs[best].tolist(), pa.string()), "score": pa.array(np.where(letter, share, 0.0)), "entropy": pa.array(np.where(letter, low, np.nan), from_pandas=True), "rejected": pa.array(rejected)}
            )

    return predict


def train(
    labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_docs: int = 400, reject_share: float = 1e-3, slack: float = 1.5, calibration_docs: int = 1000
) -> Model:
    """labelled: rows to learn from. The sample holds about sample_docs documents of each language (of a rarer one four in five; all, if it has four or fewer), whole texts."""
    bound_batches(labelled.sparkSession)
    named = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({})

    def coins(docs: dict[str, float]) -> Column:
        share = F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, COINS * docs[k] / n)))
        return F.coalesce(share[F.col("lang")], F.lit(0.0))

    coin = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(COINS))
    learned = {k: min(sample_docs, 0.8 * n) if n > 4 else float(n) for k, n in sizes.items()}
    sample = named.where(coin < coins(learned))
    counted = sample.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    rows = counted.toArrow()  # words of the bounded sample
    words: dict[str, tuple[list[str], np.ndarray]] = {}
    for name in sorted(pc.unique(rows.column("lang")).to_pylist()):
        own = rows.filter(pc.equal(rows.column("lang"), name)).sort_by("word")
        words[name] = (own.column("word").to_pylist(), own.column("n").to_numpy())
    model = Model(words)
    if model.langs:
        shipped = labelled.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
        others = named.where((coin >= coins(learned)) & (coin < coins({k: n + calibration_docs for k, n in learned.items()})))
        scored = others.select("text", F.struct("lang").alias("row")).mapInArrow(_predict(shipped), "row struct<lang: string>, lang_pred string, score double, entropy double, rejected boolean")
        limits = {r["lang"]: r["q"] for r in scored.where("lang_pred = row.lang").groupBy(F.col("row.lang").alias("lang")).agg(F.percentile_approx("entropy", 1 - reject_share, 10000).alias("q")).collect()}
        model.limits = np.array([slack * limits[k] if limits.get(k) is not None else np.inf for k in model.langs])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (struct of the input's columns), lang_pred, score (0 to 1: the language's share against the others), entropy, rejected."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kind = whole.schema["row"].dataType.simpleString()
    return whole.select(F.col("row")[text_col].cast("string").alias("text"), "row").mapInArrow(_predict(shipped), f"row {kind}, lang_pred string, score double, entropy double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no model learns from: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
