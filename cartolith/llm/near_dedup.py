"""Near-duplicate detection with min-max hashing.

A document's set: its distinct k-word shingles after lower-casing A-Z (with fewer words, the whole sequence as one).
Two documents are linked if their sets' Jaccard similarity reaches the threshold; a group is a connected component.

Plan:
1. Each document's shingle hashes pass through a family of permutations; of each both the minimum and the maximum are
   kept, so that half the evaluations give a signature of the same length. Bands of `rows` values are the search keys.
   Their number follows from the threshold: a pair at the threshold meets in no band with probability about `miss` (both
   ends of one permutation are not quite independent; for sets of some twenty shingles it is a tenth more).
2. Documents of one set are one class, represented by its smallest id; only representatives go on.
3. In every band bucket all members are paired with the bucket's smallest member (a star, never all pairs), and every
   such pair is confirmed on the full sets. Components follow.
4. A bucket that still holds members of several components, besides its smallest, has pairs not yet seen. Members of such buckets are put
   together by prefix filtering: with shingles in one order (those that no other component holds first, then by how many members hold them), two sets
   that reach the threshold share a shingle among the first n - ceil(threshold * n) + 1 of each. Components that share such a shingle are a cluster;
   within it members are compared exactly, across components only, in blocks of BLOCK members dealt over tasks. So no link is lost to the stars,
   and documents that have only a common passage in common are not compared.

Cases: null, empty or blank text has an empty set and links with nothing. A null id links with nothing, its component is
null and it is kept. Rows of one id are one node: a link of one of them is a link of all, and repeated rows stay rows. Ties
go to the smallest id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.graph import components
from cartolith.llm.shared import bound_batches, discard, lean, lean_group, materialise
from cartolith.llm.textkernels import Words, mix, slices, window_hash

BLOCK = 256


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets' sorted distinct hashes one after the other, and where each set starts (with the end)."""
    words = Words(texts, lower=True)
    h = words.hashes()
    n_words = words.counts
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    ends = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(int(ends[-1]), np.uint64)
    long = np.flatnonzero(words.rest_of_text() >= k)
    of = np.repeat(n_words >= k, n)
    out[of] = window_hash(h, k)[long] if len(long) else out[:0]
    for d in np.flatnonzero((n_words > 0) & (n_words < k)):
        a, b = words.first[d], words.first[d + 1]
        out[ends[d]] = mix(window_hash(h[a:b], b - a) + np.uint64(b - a))[0]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[ends[:-1][n > 0]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], upto[ends]


def plan_bands(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def min_max_bands(sets: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (documents x bands) of non-empty sets: two values, minimum and maximum, of each permutation."""
    turns = -(-bands * rows // 2)
    coin = np.random.default_rng(77).integers(0, 2**64, (2, turns), dtype=np.uint64)
    values = np.empty((2 * turns, len(at) - 1), np.uint64)
    x = np.empty_like(sets)
    with np.errstate(over="ignore"):
        for p in range(turns):
            np.multiply(sets, coin[0, p] | np.uint64(1), out=x)
            x += coin[1, p]
            values[2 * p] = np.minimum.reduceat(x, at[:-1])
            values[2 * p + 1] = np.maximum.reduceat(x, at[:-1])
        keys = np.empty((bands, len(at) - 1), np.uint64)
        for b in range(bands):
            key = np.full(len(at) - 1, b + 1, np.uint64)
            for r in range(rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[b * rows + r])
            keys[b] = key
    return keys.T


def _signatures(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, at = shingle_sets(part.column("text"), k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                keys = min_max_bands(sets, np.concatenate((at[full], at[-1:])), bands, rows)
            raw = sets.tobytes()
            prints = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n > 0) * bands)).astype(np.int32)), pa.array(np.ascontiguousarray(keys).view(np.int64).ravel()))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_shingles": pa.array(n.astype(np.int64)), "print": pa.array(prints, pa.binary()), "bands": lists})

    return sign


def _sets(k: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, at = shingle_sets(part.column("text"), k)
            raw = sets.tobytes()
            yield pa.record_batch({"id": part.column("doc_id"), "hashes": pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())})

    return build


def _confirm(num: int, den: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    ok.append(False)  # the sizes alone rule it out
                    continue
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                same = int((z[1:] == z[:-1]).sum())
                ok.append(den * same >= num * (both - same))
            yield pa.record_batch({"leader": batch.column("leader"), "node": batch.column("node"), "ok": pa.array(ok, pa.bool_())})

    return confirm


def block_links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between members of different labels, as many as join the labels (a spanning forest)."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), bool), flat[1:] != flat[:-1])))
    size = np.diff(np.concatenate((at, [len(flat)])))
    shared = np.zeros((len(sets), len(sets)), np.float32)
    col = np.repeat(np.arange(len(at)), size)
    for lo in range(0, len(at), 4096):  # incidence of 4096 shingles at a time
        pick = (col >= lo) & (col < lo + 4096) & (size[col] > 1)
        table = np.zeros((len(sets), 4096), np.float32)
        table[who[pick], col[pick] - lo] = 1
        shared += table @ table.T
    total = n[:, None] + n[None, :] - shared
    hit = (den * shared >= num * total) & (labels[:, None] != labels[None, :])
    root = {x: x for x in set(labels.tolist())}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(hit)), strict=True):
        a, b = find(int(labels[i])), find(int(labels[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def _compare(num: int, den: int):
    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        links = block_links(table.column("node").to_numpy(), table.column("label").to_numpy(), sets, num, den)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return compare


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set."""
    for batch in batches:
        for node, label, raw in zip(batch.column("node"), batch.column("label"), batch.column("hashes"), strict=True):
            own = np.frombuffer(raw.as_py(), np.int64)
            for lo in range(0, len(own), 1 << 16):
                m = len(own[lo : lo + (1 << 16)])
                columns = {k: pa.array(np.full(m, v)) for k, v in (("node", node.as_py()), ("label", label.as_py()), ("n", len(own)))}
                yield pa.record_batch(columns | {"key": pa.array(own[lo : lo + (1 << 16)])})


def _prefixes(members: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(node, label, key) of each set's prefix, without the shingles that only one label holds; and the table it reads."""
    held = members.join(sets, F.col("node") == F.col("id")).select("node", "label", "hashes").mapInArrow(lean(_spread), "node long, label long, n long, key long")
    held = materialise(held, "held")
    shared = held.groupBy("key").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "df")
    # the n - s shingles that no other label holds come first, so s - ceil(t * n) + 1 of the shared ones belong to the prefix
    of = Window.partitionBy("node")
    ranked = held.join(shared, "key").withColumn("s", F.count("*").over(of)).withColumn("place", F.row_number().over(of.orderBy("df", "key")))
    return ranked.where(f"place <= s - (({num} * n + {den - 1}) div {den}) + 1").select("node", "label", "key"), held


def _rest(pairs: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, list[DataFrame]] | None:
    """Links among the members of buckets that hold several components besides their smallest member, and the tables they are read from."""
    members = pairs.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    open_ = materialise(members.join(several.select("key"), "key").select("node", "label").distinct(), "open")
    if open_.isEmpty():
        discard(open_)
        return None
    prefixes, held = _prefixes(open_, sets, num, den)
    prefixes = materialise(prefixes, "prefixes")
    several = prefixes.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    found = materialise(prefixes.join(several.select("key", "lo"), "key"), "found")
    discard(open_, held, prefixes)
    if found.isEmpty():
        discard(found)
        return None
    merged = components(found.where("label <> lo").select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct())
    clusters = found.select("node", "label").distinct().join(merged.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label", "left")
    clusters = clusters.select("node", "label", F.coalesce("cluster", "label").alias("cluster"))
    sizes = clusters.groupBy("cluster", "label").agg(F.count("*").alias("n")).withColumn("big", F.expr(f"if(n > {BLOCK}, label, null)"))
    pools = sizes.groupBy("cluster", "big").agg(F.sum("n").alias("n_pool"))
    placed = clusters.join(sizes.select("label", "cluster", "big"), ["cluster", "label"]).join(
        pools.select(F.col("cluster").alias("c2"), F.col("big").alias("b2"), "n_pool"), (F.col("cluster") == F.col("c2")) & F.col("big").eqNullSafe(F.col("b2"))
    )
    placed = materialise(placed.select("node", "label", "cluster", "big", F.expr(f"pmod(xxhash64(node), cast(ceil(n_pool / {BLOCK}) as int))").alias("part")), "placed")
    blocks = placed.select("cluster", "big", "part").distinct().withColumn("block", F.xxhash64("big", "part", F.lit(1)))
    left, right = (blocks.select("cluster", *(F.col(c).alias(f"{c}_{s}") for c in ("big", "block"))) for s in "lr")
    tasks = left.join(right, "cluster").where("block_l <= block_r and not (big_l is not null and big_r is not null and big_l = big_r)")
    tasks = tasks.select("cluster", F.xxhash64("cluster", "block_l", "block_r").alias("task"), F.explode(F.array_distinct(F.array("block_l", "block_r"))).alias("block"))
    dealt = placed.withColumn("block", F.xxhash64("big", "part", F.lit(1))).join(tasks, ["cluster", "block"]).join(sets, F.col("node") == F.col("id"))
    return dealt.select("task", "node", "label", "hashes").groupBy("task").applyInArrow(lean_group(_compare(num, den)), "a long, b long"), [found, merged, placed]


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (85, 100), k: int = 5, rows: int = 5, miss: float = 1e-7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs. threshold: a fraction, for whole-number tests."""
    bound_batches(docs.sparkSession)
    num, den = threshold
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bands = plan_bands(num / den, rows, miss)
    signed = materialise(slim.mapInArrow(lean(_signatures(k, bands, rows)), "doc_id long, n_shingles long, print binary, bands array<long>"), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # written first, so that the join below deals its rows by itself and Spark can split a print that holds very many of them
    classes = materialise(some.groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    nodes = materialise(
        signed.join(classes, "print", "left").select("doc_id", "n_shingles", F.expr("if(n_shingles > 0 and doc_id is not null, coalesce(rep, doc_id), doc_id)").alias("rep"), F.expr("if(rep is null or rep = doc_id, bands, null)").alias("bands")),
        "nodes",
    )
    discard(signed, classes)
    keyed = nodes.where("n_shingles > 0 and doc_id is not null and bands is not null").select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("most")).where("leader <> most").drop("most")
    pairs = materialise(keyed.join(leaders, "key").where("node <> leader").select("key", "leader", "node"), "pairs")
    candidates = pairs.select("leader", "node").distinct()
    wanted = pairs.select(F.col("node").alias("doc_id")).union(pairs.select("leader")).distinct()
    sets = materialise(slim.join(wanted, "doc_id", "left_semi").mapInArrow(lean(_sets(k)), "id long, hashes binary").where("length(hashes) > 0"), "sets")
    checked = candidates.join(sets.select(F.col("id").alias("node"), F.col("hashes").alias("x")), "node").join(sets.select(F.col("id").alias("leader"), F.col("hashes").alias("y")), "leader")
    links = materialise(checked.select("leader", "node", "x", "y").mapInArrow(lean(_confirm(num, den)), "leader long, node long, ok boolean").where("ok").select(F.col("leader").alias("a"), F.col("node").alias("b")), "links")
    labels = components(links)
    more = _rest(pairs.select("key", "node"), labels, sets, num, den)
    if more is not None:
        both = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more[0])
        labels, old = components(both), labels
        discard(old, *more[1])
    discard(links, sets, pairs)
    out = nodes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
