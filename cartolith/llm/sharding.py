"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size (an offset and a step from its name's hash). Shards take turns;
each claims the first slot in its order that is still free, until all are taken. So shards hold equal numbers of slots to within one, and when a
shard comes or goes few slots change hands. A document's slot is the hash of its key modulo the size; the table, `size` rows whatever the
documents, is broadcast, so a placement is one look-up.

Cases: a null key is placed by its text, and if that is null too, by the empty string. Repeated keys go to one shard. A shard named twice counts once. An
empty table gives an empty result; no shards, or a size that isn't prime or is below the number of shards, is an error. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS_PER_SHARD = 100
MAX_SIZE = 10_000_019


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def prime_from(n: int) -> int:
    while not is_prime(n):
        n += 1
    return n


def fill(shards: list[str], size: int | None = None) -> list[int]:
    """The table: for each slot the index of its shard in the sorted distinct names."""
    names = sorted(set(shards))
    size = prime_from(SLOTS_PER_SHARD * len(names)) if size is None else size
    if not names or not is_prime(size) or not len(names) <= size <= MAX_SIZE:
        raise ValueError("sharding needs shards, and a prime size from their number to MAX_SIZE")
    digest = [hashlib.md5(x.encode()).digest() for x in names]
    at = [int.from_bytes(d[:8], "big") % size for d in digest]
    step = [int.from_bytes(d[8:], "big") % (size - 1) + 1 if size > 1 else 0 for d in digest]
    table, free = [-1] * size, size
    while True:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def slot(key: Column, size: int) -> Column:
    """The key's slot: the first 60 bits of its md5 (a string key), modulo the size."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, shards: list[str], size: int | None = None, id_col: str = "doc_id", text_col: str | None = "text") -> DataFrame:
    """docs with shard (the name's index in sorted order) and slot; columns of those names are replaced."""
    table = fill(shards, size)
    rows = docs.sparkSession.createDataFrame(list(enumerate(table)), "slot long, shard int")
    key = F.col(id_col).cast("string")
    key = F.coalesce(key, F.md5(F.col(text_col).cast("binary")), F.lit("")) if text_col else F.coalesce(key, F.lit(""))
    return docs.drop("shard").withColumn("slot", slot(key, len(table))).join(F.broadcast(rows), "slot")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard; a shard is dealt over files_per_shard tasks."""
    placed.withColumn("_file", F.pmod(F.xxhash64("slot"), F.lit(files_per_shard))).repartition("shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
