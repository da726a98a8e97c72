"""Sharding by a permutation-filled lookup table of prime size."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import columns

SHARDS = 64
#: A prime, about a thousand slots for each shard: shares differ by 1 in 1,000 at most.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def build_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Slot -> index of the shard. Each shard orders the slots by (offset + j * skip) mod size, both hashed from
    its name, and shards take turns claiming the first free slot of their own order. Since size is prime each
    order is a permutation. Removing a shard moves few keys besides its own.

    Raises ValueError for no shards, repeated names, more shards than slots, or a size that isn't prime."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size or not _is_prime(size):
        raise ValueError("shards must be distinct and fit a table of prime size")
    offset, skip = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        offset.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:], "big") % (size - 1) + 1 if size > 2 else 1)
    table, at, filled = np.full(size, -1, np.int32), list(offset), 0
    while filled < size:
        for i, step in enumerate(skip):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step) % size
            table[at[i]] = i
            filled += 1
            if filled == size:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 60 bits of the MD5 of its text, modulo the size. A null key counts as the text 'null'."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def assign_shards(spark: SparkSession, df: DataFrame, key: str = "doc_id", shards: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """df with `slot` (long) and `shard` (int) of each row; existing columns of those names are replaced.

    The table has `size` rows whatever the input, so it is broadcast: one hash probe a row, no shuffle of df.
    Nulls in the key: all go to one fixed slot. Repeated rows and equal keys: the same shard. Empty table: empty
    result. Other columns, texts of any length included, pass through."""
    names = shards if shards is not None else [f"shard-{i:05d}" for i in range(SHARDS)]
    table = build_table(names, size)
    slots = spark.createDataFrame(list(zip(range(size), table.tolist())), "slot long, shard int")
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), size))
    # left: every slot has its row, and a left join keeps df on the streamed side
    return placed.join(F.broadcast(slots), "slot", "left").select(*columns(placed), "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """DuckDB: the same placement, with the table as a list."""
    table = build_table([f"shard-{i:05d}" for i in range(SHARDS)])
    return (
        "WITH placed AS (SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT"
        f" % {TABLE_SIZE} AS slot FROM documents), t AS (SELECT unnest(range({TABLE_SIZE})) AS slot,"
        f" unnest([{','.join(map(str, table.tolist()))}]) AS shard)"
        " SELECT doc_id, text, lang, source, n_chars, slot, CAST(shard AS INTEGER) AS shard FROM placed JOIN t USING (slot)"
    )
