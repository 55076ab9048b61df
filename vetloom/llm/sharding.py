"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Every shard has an order of preference over the slots of a table of prime size: an offset and a step from the hash of its
name. The shards take turns, each claiming its next free slot (as many per turn as its weight), until the table is full.
The table's size is a parameter, not a matter of the data; it is broadcast, and a row's slot is the hash of its key modulo
that size. When a shard comes or goes, few keys change their place but those it gains or loses.

A null key counts as the empty string. Equal keys, and so repeated rows, share a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of MD5 that make a number; 60 bits fit a long.
DIGITS = 15


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def fill_table(shards: Mapping[str, int], size: int) -> list[str]:
    """The shard of each slot; ``shards`` gives weights by name, ``size`` is a prime."""
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime")
    if not shards or min(shards.values()) < 1 or sum(shards.values()) > size:
        raise ValueError("shards need a weight of 1 or more each, and a slot per unit of weight")
    at = {name: _number(f"{name}/offset") % size for name in shards}
    step = {name: _number(f"{name}/step") % (size - 1) + 1 for name in shards}
    table: list[str | None] = [None] * size
    free = size
    while free:
        for name in sorted(shards):
            for _ in range(min(shards[name], free)):
                while table[at[name]] is not None:
                    at[name] = (at[name] + step[name]) % size
                table[at[name]] = name
                free -= 1
    return table


def slot_of(key: Column, size: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") % size


def lookup(spark: SparkSession, shards: Mapping[str, int], size: int, name: str = "shard") -> DataFrame:
    """``slot, shard``: the filled table as a relation of ``size`` rows."""
    names = F.split(F.lit(",".join(fill_table(shards, size))), ",")
    return spark.range(1).select(F.posexplode(names).alias("slot", name)).select(F.col("slot").cast("bigint").alias("slot"), name)


def place(df: DataFrame, key_col: str, shards: Mapping[str, int], size: int = 4099) -> DataFrame:
    """``slot, shard, row`` of every row; ``row`` holds the columns of ``df`` as they are."""
    rows = df.select(slot_of(F.col(key_col), size).alias("slot"), F.struct("*").alias("row"))
    return rows.join(F.broadcast(lookup(df.sparkSession, shards, size)), "slot").select("slot", "shard", "row")


def write(df: DataFrame, key_col: str, shards: Mapping[str, int], path: str, size: int = 4099, tasks_per_shard: int = 8) -> None:
    """One folder per shard; each shard's rows are spread over several tasks by their slot's neighbour hash."""
    spread = F.pmod(F.xxhash64("row"), F.lit(tasks_per_shard))
    placed = place(df, key_col, shards, size).repartition(len(shards) * tasks_per_shard, "shard", spread)
    placed.select("shard", "row.*").write.partitionBy("shard").parquet(path)


def plan_growth(df: DataFrame, key_col: str, now: Mapping[str, int], then: Mapping[str, int], size: int = 4099) -> DataFrame:
    """``key, slot, shard, next_shard`` of every row: where it lies and where it will lie with the shards of ``then``."""
    tables = lookup(df.sparkSession, now, size).join(lookup(df.sparkSession, then, size, "next_shard"), "slot")
    rows = df.select(F.col(key_col).alias("key"), slot_of(F.col(key_col), size).alias("slot"))
    return rows.join(F.broadcast(tables), "slot").select("key", "slot", "shard", "next_shard")
