"""Parallelism: tables that arrive in fewer pieces than there are cores, and joins on keys that many rows share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(table: DataFrame) -> DataFrame:
    """A scanned table over all cores, for heavy projections on it.

    A small table in one file is one task, however long the expressions on its rows. Tables with as many splits as cores
    (all large ones) stay as they are: no shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def met_by_size(rows: DataFrame, classes: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` joined with the one row that ``classes`` has per ``key``; ``size`` there is the number of rows of the key.

    Keys of more than ``limit`` rows, fewer than one in ``limit`` rows, meet by broadcast; the others by a join that spreads them.
    """
    common = classes.where(F.col("size") > limit)
    near = rows.join(F.broadcast(common), key)
    others = rows.join(F.broadcast(common.select(key)), key, "left_anti")
    return near.unionByName(others.join(classes.where(F.col("size") <= limit), key))


def looked_up(rows: DataFrame, unique: DataFrame, keys: list[str], share: int = 2_000) -> DataFrame:
    """``rows`` left-joined with the one row that ``unique`` has per ``keys``; null keys meet each other.

    Rows that ask for the same key are counted first: a key of more than one row in ``share`` is met by broadcast, with what
    ``unique`` has for it. All other rows meet ``unique`` in one join.
    """
    from vetloom.plans.scans import fixed

    asked = rows.withColumn("__key", F.struct(*keys))
    held = unique.withColumn("__key", F.struct(*keys)).drop(*keys)
    sizes = asked.groupBy("__key").agg(F.count(F.lit(1)).alias("size"))
    limit = max(1, asked.count() // share)
    common = fixed(sizes.where(F.col("size") > limit).select("__key"))  # fewer than ``share`` keys
    if common.isEmpty():
        return asked.join(held, "__key", "left").drop("__key")
    met = fixed(common.join(held.join(F.broadcast(common), "__key", "left_semi"), "__key", "left"))
    near = asked.join(F.broadcast(met), "__key")
    others = asked.join(F.broadcast(common), "__key", "left_anti").join(held, "__key", "left")
    return near.unionByName(others).drop("__key")
