"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime size. Shards take turns, each claiming
the next free slot of its order, until the table is full. A key is placed by one hash and one lookup; adding or
removing a shard moves few keys. The table has ``SLOTS`` rows whatever the data, so it may be broadcast.

Defined results: a row without id is placed by its text, one without both by the hash of nothing, so null ids do not
meet in one shard; repeated ids share a shard. Further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 10_007
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """slot -> place of its shard in ``shards``. ``slots`` must be prime and no smaller than the number of shards."""
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    owner = np.full(slots, -1, dtype=np.int32)
    at = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    free = slots
    while free:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            owner[at[k]] = k
            free -= 1
            if not free:
                break
    return owner


def shard_names(count: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(count)]


def _slot(slots: int) -> Column:
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint") % slots


def _free(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the table's own columns."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def place(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The documents with two more columns, ``slot`` and ``shard``; one narrow map against the broadcast table.

    A table that has columns of these names keeps them; the new ones then end in an underscore.
    """
    spark: SparkSession = docs.sparkSession
    slot, shard = _free(docs, "slot"), _free(docs, "shard")
    owners = lookup_table(shard_names(shards), slots)
    table = spark.createDataFrame([(i, int(k)) for i, k in enumerate(owners)], f"{slot} bigint, {shard} bigint")
    return docs.withColumn(slot, _slot(slots)).join(F.broadcast(table), slot).select(*docs.columns, slot, shard)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> None:
    """One folder of Parquet files per shard. Rows are written where they are, without a shuffle."""
    place(docs, shards, slots).drop(_free(docs, "slot")).write.partitionBy(_free(docs, "shard")).parquet(path)


def placements(docs: DataFrame) -> DataFrame:
    """doc_id, slot and shard of every document."""
    return place(docs.select("doc_id", "text")).select("doc_id", "slot", "shard")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """DuckDB twin: the same hash against the table written out as a list."""
    owners = ", ".join(map(str, lookup_table(shard_names(shards), slots)))
    return f"""
WITH s AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15) AS BIGINT) % {slots} AS slot
           FROM documents),
t AS (SELECT [{owners}] AS owners)
SELECT doc_id, slot, CAST(owners[slot + 1] AS BIGINT) AS shard FROM s, t
"""
