"""Sharding through a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The
shards take turns, each claiming the first slot of its permutation that is
free, until the table is full: shares differ by one slot at most, and adding or
dropping a shard moves few slots beyond its own. A row's key hashes to a slot,
and the table, of a size that never depends on the data, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fields_of, others_of, row_of

#: A prime; at 64 shards a shard has 1,024 slots or one more.
TABLE_SIZE = 65_537


def _number(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot. ``size`` must be a prime, above the number of shards; names must differ."""
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) >= size:
        raise ValueError("shards need distinct names, fewer than slots")
    place = [_number(f"start {s}") % size for s in shards]
    step = [_number(f"step {s}") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % size
            table[place[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key, size: int = TABLE_SIZE):
    """The slot of a key column: the first 32 bits of the MD5 of its text, modulo the table size. Null keys are as empty texts."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % size).cast("long")


def assign_shards(docs: DataFrame, shards: list[str], key_col: str = "doc_id", *, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` plus slot (long) and shard (name).

    Equal keys share a shard, repeated rows and null keys too; no row moves for
    it: the broadcast table has ``size`` rows whatever the input. All columns
    pass through, but those named slot or shard, which are replaced; keys may be
    of any length, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))], "slot long, shard string")
    others = others_of(docs, "slot", "shard")
    row = docs.select(row_of(others), slot_of(F.col(key_col), size).alias("slot"))
    return row.join(F.broadcast(table), "slot").select(*fields_of(others), "slot", "shard")


def sharding_sql(shards: list[str], key: str, source: str, size: int = TABLE_SIZE) -> str:
    """DuckDB SQL of ``assign_shards`` for one key column."""
    table = ",".join(map(str, lookup_table(shards, size)))
    names = ",".join(shards)
    return f"""
with t as materialized (select string_split('{table}', ',') as slots, string_split('{names}', ',') as names),
d as (select {key}, ('0x' || substr(md5(coalesce(cast({key} as varchar), '')), 1, 8))::bigint % {size} as slot from {source}),
u as (select i - 1 as slot, names[slots[i]::int + 1] as shard from t, unnest(range(1, {size} + 1)) as g(i))
select {key}, slot, shard from d join u using (slot)"""
