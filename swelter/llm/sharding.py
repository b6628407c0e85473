"""Sharding by a permutation-filled lookup table.

Each shard walks its own permutation of a prime number of slots (offset and step come from two
hashes of its name) and the shards take turns: at its turn a shard claims the first slot of its
order that is free. Shares differ by at most one turn a weight, and taking a shard away moves few
other slots. The table's size is a parameter, not a function of the data; rows find their slot by
hash and their shard by a broadcast join with the table, in constant time and without a shuffle.

Nulls: a null key hashes as the empty string. Empty tables give empty results. Other columns are returned as they
are; where one has the name of a column that is added, the added one has underscores before its name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Production parameters: shards, and a prime about a thousand times as many; the largest table that is broadcast.
N_SHARDS, TABLE_SIZE, MOST_SLOTS = 64, 65_537, 5_000_000


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], table_size: int = TABLE_SIZE, weights: list[int] | None = None) -> list[int]:
    """The shard's position in `shards` for each slot. weights: turns of a shard in each round."""
    if not shards or len(set(shards)) < len(shards) or table_size < len(shards):
        raise ValueError("shards must be distinct, and no more than the table has slots")
    if table_size > MOST_SLOTS:
        raise ValueError(f"the table is broadcast, so it has at most {MOST_SLOTS} slots")
    if table_size < 2 or any(table_size % k == 0 for k in range(2, int(table_size**0.5) + 1)):
        raise ValueError("table_size must be a prime number")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("weights must be one whole number per shard, none negative, one positive")
    at = [_hash(s, "offset") % table_size for s in shards]
    step = [_hash(s, "step") % (table_size - 1) + 1 for s in shards]
    table, free = [-1] * table_size, table_size
    while free:
        for k, many in enumerate(turns):
            for _ in range(min(many, free)):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + step[k]) % table_size
                table[at[k]] = k
                free -= 1
    return table


def slot_of(key, table_size: int = TABLE_SIZE):
    """Slot of a key column: xxhash64 of its text, modulo the table's size."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(table_size)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], table_size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """rows with two more columns at the end, slot and shard. The table has table_size rows, whatever the data's size."""
    spark: SparkSession = rows.sparkSession
    slot, shard = scratch.fresh(rows.columns, "slot", "shard")
    filled = ",".join(map(str, fill_table(shards, table_size, weights)))
    table = spark.range(1).select(F.posexplode(F.split(F.lit(filled), ",")).alias(slot, "turn")).select(
        slot, F.element_at(F.array(*map(F.lit, shards)), F.col("turn").cast("int") + 1).alias(shard)
    )
    return rows.withColumn(slot, slot_of(F.col(key), table_size)).join(F.broadcast(table), slot, "left").select(*rows.columns, slot, shard)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document's slot and shard among 64 shards: doc_id, slot, shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", [f"shard-{k:03d}" for k in range(N_SHARDS)])
