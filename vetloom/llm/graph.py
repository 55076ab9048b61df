"""Connected components by alternating large-star and small-star steps; only aggregates and equi-joins of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.llm.shared import cut, narrowed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)`` that isn't the smallest of its component.

    Each round replaces edges by edges to smaller neighbours, and ends when nothing changes. The minimum per node is
    aggregated before the shuffle; the join on a node with very many edges is left to Spark's split of skewed joins. A
    round never has more edges than the one before, so its steps take no more partitions than those edges fill.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).union(now.select("root", "node"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = narrowed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), state[0]).distinct()
        large = cut(narrowed(large, state[0]))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), "m")
        both = narrowed(small.union(moved), state[0]).distinct()
        now = cut(narrowed(both.select(F.col("u").alias("node"), F.col("m").alias("root")), state[0]))
        last, state = state, _state(now)
        if state == last:
            break
    return now
