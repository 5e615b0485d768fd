"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size: an offset and a step
from two hashes of its name. Shards take turns, each claiming the first free slot in its order, until
the table is full; so each has its share of slots to within one, and when a shard goes, few slots of
others change hands. The table is a constant of the placement (its size is a parameter and bounds what
is broadcast); a row's slot is the hash of its key modulo the size.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, about a thousand slots for each of the production shards.
SLOTS = 65_537
SHARDS = tuple(f"shard-{k:02d}" for k in range(64))


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> np.ndarray:
    """For each slot the number of its shard. The names must differ, and the size be a prime that is not
    less than their number."""
    if not shards or len(set(shards)) < len(shards) or not _prime(slots) or slots < len(shards):
        raise ValueError("shards need different names, and a prime number of slots, no fewer than shards")
    seeds = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(x[:8], "big") % slots for x in seeds]
    step = [int.from_bytes(x[8:16], "big") % (slots - 1) + 1 for x in seeds]
    table = np.full(slots, -1)
    free = slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of the MD5 of it as text, modulo the size; null as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard to the rows. A null key is placed as the empty text; rows of one key, however
    many, go to one shard without being brought together here; an empty table stays empty. Columns of
    rows that are named slot or shard are replaced."""
    rows = rows.drop("slot", "shard").withColumn("slot", slot(F.col(key), slots))
    # one row of two numbers a slot
    table = rows.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(lookup_table(shards, slots))], "slot long, shard int")
    return rows.join(F.broadcast(table), "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def oracle_sql() -> str:
    """The same in SQL; the table is a literal of two hexadecimal digits a slot."""
    table = "".join(f"{s:02x}" for s in lookup_table(SHARDS))
    slot_sql = f"('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS}"
    return f"WITH placed AS (SELECT doc_id, {slot_sql} AS slot FROM documents) SELECT doc_id, slot, ('0x' || substr('{table}', CAST(2 * slot + 1 AS BIGINT), 2))::INTEGER AS shard FROM placed"
