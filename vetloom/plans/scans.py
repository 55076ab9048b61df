"""Ordered scans over groups of any size.

A plain window sends a whole group to one task. These helpers cut every group into
chunks (a monotone expression of the leading order column: a day, a block of line
numbers), scan inside the chunk, and carry one summary row per chunk across the group.
A group that holds a third of the table is then spread over as many tasks as it has
chunks, and only the summaries of a group meet in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.session import checkpoint_dir

CHUNK = "__chunk"


def _ordered(keys: Sequence[str], order: Sequence[str], with_chunk: bool = True):
    cols = [F.col(k) for k in keys] + ([F.col(CHUNK)] if with_chunk else [])
    return Window.partitionBy(*cols).orderBy(*[F.col(o) for o in order])


def _joined(chunked: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the carry of their chunk; null keys and chunks meet each other."""
    other = carry.select(*[F.col(c).alias(f"__carry_{c}") if c in (*keys, CHUNK) else F.col(c) for c in carry.columns])
    on = F.lit(True)
    for c in (*keys, CHUNK):
        on = on & F.col(c).eqNullSafe(F.col(f"__carry_{c}"))
    return chunked.join(other, on, "left").drop(*[f"__carry_{c}" for c in (*keys, CHUNK)])


def day_chunk(column: str) -> Column:
    """Chunk expression for a timestamp order column."""
    return F.floor(F.unix_seconds(F.col(column)) / 86400)


def block_chunk(column: str, width: int = 4096) -> Column:
    """Chunk expression for an integer order column."""
    return F.floor(F.col(column) / width)


def scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
    number: str | None = None, lags: dict[str, str] | None = None, sums: dict[str, str] | None = None,
) -> DataFrame:
    """``row_number()`` as ``number``, ``lag(column)`` and running ``sum(column)`` over (keys, order), from two reads of ``df``.

    ``lags`` and ``sums`` give ``{column: new_name}``; sums are of exact decimal or integer types.
    """
    lags, sums = lags or {}, sums or {}
    chunked = df.withColumn(CHUNK, chunk)
    if lags:
        chunked = chunked.withColumn("__row", F.struct(*[F.col(c) for c in lags]))
    parts = [F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__total_{i}") for i, c in enumerate(sums)]]
    if lags:
        parts.append(F.max_by("__row", F.struct(*[F.col(o) for o in order])).alias("__tail"))
    groups = chunked.groupBy(*keys, CHUNK).agg(*parts)
    place = Window.partitionBy(*keys).orderBy(CHUNK)
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")]
    carried += [F.sum(f"__total_{i}").over(before).alias(f"__before_{i}") for i in range(len(sums))]
    if lags:
        carried.append(F.lag("__tail").over(place).alias("__carry"))
    inside = _ordered(keys, order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = chunked.withColumn("__local", F.row_number().over(inside))
    for i, c in enumerate(sums):
        local = local.withColumn(f"__sum_{i}", F.sum(c).over(so_far))
    if lags:
        local = local.withColumn("__prev", F.lag("__row").over(inside))
    out = _joined(local, groups.select(*keys, CHUNK, *carried), keys)
    if number:
        out = out.withColumn(number, (F.col("__local") + F.col("__offset")).cast("bigint"))
    for i, name in enumerate(sums.values()):
        out = out.withColumn(name, F.coalesce(f"__sum_{i}", F.lit(0)) + F.coalesce(f"__before_{i}", F.lit(0)))
    for c, name in lags.items():
        out = out.withColumn(name, F.coalesce("__prev", "__carry")[c])
    helpers = ["__local", "__offset", "__row", "__prev", "__carry", *(f"__{k}_{i}" for i in range(len(sums)) for k in ("sum", "before"))]
    return out.drop(CHUNK, *helpers)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str = "rn") -> DataFrame:
    """``row_number()`` over (keys, order)."""
    return scan(df, keys, order, chunk, number=name)


def lag_columns(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: dict[str, str]
) -> DataFrame:
    """``lag(column)`` over (keys, order) for each ``{column: new_name}``."""
    return scan(df, keys, order, chunk, lags=columns)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, name: str
) -> DataFrame:
    """``sum(value)`` over (keys, order, rows unbounded preceding), in exact decimal or integer types."""
    return scan(df, keys, order, chunk, sums={value: name})


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group.

    The filter on ``row_number`` lets Spark keep only ``n`` rows per group in every map task
    (WindowGroupLimit), so a hot group shrinks before the shuffle.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def latest_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group: the first in the given order."""
    return first_rows(df, keys, order, 1, "__rank").drop("__rank")


def fixed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its partitions stay as they are, and lost executors cost no earlier work."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``fixed``, but as a compressed table, for many rows that are read more than once; its partitions are dealt anew."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, whole: int = 0) -> DataFrame:
    """Running ``max(value)`` over (keys, order) as ``name``, over range partitions that cut a group of any size.

    The rows are sorted once by (keys, order); every partition scans its own stretch of each group. At most one group goes on
    from one partition into the next, so the maxima carried over are at most one row per partition, and are broadcast. Rows
    that are equal in (keys, order) have the order in which they happen to stand.

    Groups of up to ``whole`` rows are scanned by a plain window instead, and only the larger ones, fewer than one in ``whole``
    rows, are cut.
    """
    if whole:
        df = stored(df)
        large = fixed(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > whole).select(*[F.col(k).alias(f"__l_{k}") for k in keys]))
        running = F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if large.isEmpty():
            return df.withColumn(name, running)
        same = [df[k].eqNullSafe(large[f"__l_{k}"]) for k in keys]
        small = df.join(F.broadcast(large), same, "left_anti").withColumn(name, running)
        return small.unionByName(prefix_max(df.join(F.broadcast(large), same, "left_semi"), keys, order, value, name))
    part = "__part"
    placed = fixed(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)).withColumn(part, F.spark_partition_id())
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(part, *keys).agg(F.max(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("__before", F.max("__total").over(before)).where("__before is not null")
    carried = carried.select("__before", *[F.col(c).alias(f"__c_{c}") for c in (part, *keys)])
    local = placed.withColumn("__local", F.max(value).over(inside))
    on = [local[c].eqNullSafe(carried[f"__c_{c}"]) for c in (part, *keys)]
    out = local.join(F.broadcast(carried), on, "left").drop(*[f"__c_{c}" for c in (part, *keys)])
    return out.withColumn(name, F.greatest("__local", "__before")).drop(part, "__local", "__before")
