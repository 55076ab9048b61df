"""Set comparisons, fingerprints and duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.functions import text as X
from vetloom.operators.scoring import exact_set
from vetloom.plans import scans


def exact_set_match(df: DataFrame, chosen: str, wanted: str) -> DataFrame:
    return df.withColumn("same_set", exact_set(F.col(chosen), F.col(wanted)))


def hits_and_false_positives(df: DataFrame, chosen: str, wanted: str) -> DataFrame:
    return df.withColumns(
        {"hits": F.size(F.array_intersect(chosen, wanted)), "false_positives": F.size(F.array_except(chosen, wanted))}
    )


def union_new_items(base: DataFrame, incoming: DataFrame, key: str, item: str, order: Sequence[str]) -> DataFrame:
    """Base items plus the incoming ones that are new to their group, ignoring case; ``added`` marks those."""
    folded = F.lower(F.col(item))
    known = base.select(key, folded.alias("__item")).distinct()
    first = scans.latest_row(incoming.withColumn("__item", folded), [key, "__item"], [F.col(o) for o in order])
    fresh = first.join(known, [key, "__item"], "left_anti").drop("__item")
    return base.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def content_fingerprint(cells: DataFrame) -> DataFrame:
    """One comparable value per workbook and how many workbooks share it.

    The value is the SHA-256 of all cells in order, nulls as blanks, so a workbook's cells are gathered as one unit of work.
    Equal workbooks meet in a count and a smallest id, never as pairs.
    """
    sheet, col, row = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sheet", "col", "row_no"))
    ref = X.normalise_key_text(F.concat(sheet, F.lit("!"), col, row), "lower")
    pair = F.concat(ref, F.lit("="), X.normalise_key_text(F.coalesce("text", F.lit("")), "lower"))
    prints = cells.groupBy("workbook_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(pair)), "\n"), 256).alias("fingerprint"))
    prints = prints.repartition("fingerprint")  # one exchange for both sides, so that cells are read once
    shared = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min("workbook_id").alias("first_workbook"))
    return prints.join(shared, "fingerprint")


def duplicate_items(items: DataFrame, key: str, position: str, item: str) -> DataFrame:
    """Later repeats of an item inside one record, with the place of the first; a record is one input row."""
    folded = F.lower(X.trim_all(F.col(item)))
    named = items.withColumn("__item", folded).filter(F.col("__item") != "")
    first = F.min(position).over(Window.partitionBy(key, "__item"))
    return named.withColumn("first_at", first).filter(F.col(position) > F.col("first_at")).drop("__item")


def distinct_matches(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Distinct lower-case matches of a pattern per document with their counts."""
    hits = docs.select(key, F.explode(X.all_matches(F.col(text), pattern)).alias("hit"))
    return hits.groupBy(key, F.lower("hit").alias("match")).agg(F.count("*").alias("n"))


def unlisted_refs(answers: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Answers with whether their id is in the authored set; the set is distinct before the join."""
    marked = allowed.select(*keys).distinct().withColumn("listed", F.lit(True))
    return answers.join(marked, list(keys), "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
