"""Roster, report, reconciliation and overlap joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.functions import text as X
from vetloom.plans import scans


def attempt_roster(attempts: DataFrame, candidates: DataFrame, definitions: DataFrame, results: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` attempts with candidate, definition, result and attempt number.

    The top ``n`` is taken before the left join: results hold at most one row per attempt.
    """
    base = attempts.join(candidates.select("candidate_id"), "candidate_id", "left_semi")
    base = base.join(definitions.select("definition_id"), "definition_id", "left_semi")
    top = base.orderBy(F.col("started_at").desc(), F.col("attempt_id")).limit(n)
    wide = top.join(candidates, "candidate_id").join(definitions, "definition_id").join(results, "attempt_id", "left")
    return wide.withColumn("attempt_number", F.coalesce("attempt_number", F.lit(1)))


def attempt_report(
    attempts: DataFrame, candidates: DataFrame, definitions: DataFrame, results: DataFrame,
    saves: DataFrame, audits: DataFrame, save_limit: int = 200, audit_limit: int = 300,
) -> DataFrame:
    """One wide row per attempt; save history and audit trail are bounded before they are gathered."""
    kept = scans.first_rows(saves, ["attempt_id"], [F.col("revision"), F.col("saved_at")], save_limit)
    history = kept.groupBy("attempt_id").agg(F.array_sort(F.collect_list(F.struct("revision", "saved_at"))).alias("saves"))
    first = scans.first_rows(audits, ["attempt_id"], [F.col("created_at"), F.col("audit_id")], audit_limit)
    trail = first.groupBy("attempt_id").agg(
        F.array_sort(F.collect_list(F.struct("created_at", "audit_id", "event_type"))).alias("audit")
    )
    wide = attempts.join(candidates, "candidate_id").join(definitions, "definition_id").join(results, "attempt_id", "left")
    return wide.join(history, "attempt_id", "left").join(trail, "attempt_id", "left")


def missing_results(attempts: DataFrame, results: DataFrame) -> DataFrame:
    closed = attempts.filter(F.col("status").isin("completed", "timed_out"))
    return closed.join(results.select("attempt_id"), "attempt_id", "left_anti")


def guarded_insert(new: DataFrame, guard: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(guard.select(*keys), list(keys), "left_semi")


def reconcile(left: DataFrame, right: DataFrame, key: str, amount: str, tolerance: float = 0.005) -> DataFrame:
    """State of every reference over two sides, with the net difference.

    Both sides are reduced to one row per reference first, so the outer join never meets a
    repeated key and a reference that is repeated many times costs nothing extra.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        total = F.sum(F.col(amount).cast("decimal(18,2)")).cast("double")
        return df.groupBy(key).agg(F.count("*").alias(f"{tag}_rows"), F.min(amount).alias(f"{tag}_amount"), total.alias(f"{tag}_total"))

    both = side(left, "left").join(side(right, "right"), key, "full_outer")
    state = (
        F.when(F.col("right_rows").isNull(), "left only")
        .when(F.col("left_rows").isNull(), "right only")
        .when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "duplicate")
        .when(F.abs(F.col("left_amount") - F.col("right_amount")) < tolerance, "matched")
        .otherwise("amount differs")
    )
    zero = F.lit(0.0)
    net = F.round(F.coalesce("left_total", zero) - F.coalesce("right_total", zero), 2)
    return both.select(key, "left_amount", "right_amount", state.alias("state"), net.alias("net"))


def sentences(df: DataFrame, keys: Sequence[str], text: str, kind: str) -> DataFrame:
    """``(keys, kind, canonical)`` rows, one per sentence, in comparable form."""
    parts = F.explode(F.split(F.col(text), r"[.\n]+"))
    folded = df.select(*keys, parts.alias("part")).select(
        *keys, F.lit(kind).alias("kind"), X.normalise_key_text(F.col("part"), "lower").alias("canonical")
    )
    return folded.filter(F.col("canonical") != "")


def content_overlap(published: DataFrame, practice: DataFrame) -> DataFrame:
    """Published ``(kind, canonical)`` rows that also occur in the practice set."""
    met = _met(published, practice, ["kind", "canonical"]).select("kind", "canonical").distinct()
    return published.join(met, ["kind", "canonical"], "left_semi")


def _met(published: DataFrame, practice: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Practice rows whose sentence is published.

    The published set is small: its distinct hashes are the build side, so Spark broadcasts it if its size allows and the
    practice sentences aren't shuffled before they are cut down to those that occur in both.
    """
    asked = published.select("kind", "canonical", F.xxhash64("kind", "canonical").alias("__hash")).distinct()
    hashed = practice.select(*columns, F.xxhash64("kind", "canonical").alias("__hash"))
    few = hashed.join(asked.select("__hash").distinct(), "__hash", "left_semi")
    return few.join(asked, ["__hash", "kind", "canonical"], "left_semi").drop("__hash")


def overlap_any(published: DataFrame, practice: DataFrame, set_column: str) -> DataFrame:
    """Overlapping rows counted per practice set; both sides are distinct before they meet."""
    pieces = _met(published, practice, [set_column, "kind", "canonical"]).distinct()
    return pieces.groupBy(set_column).agg(F.count("*").alias("overlaps"))
