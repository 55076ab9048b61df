"""Scoring of written notes from evidence markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions.text import compatible, regex

CRITERION_POINTS = 2
NEGATION_WINDOW = 40
# Words that negate, and words that end a clause (fixed values).
NEGATORS = ["not", "never", "no", "none", "without", "don't", "doesn't", "didn't", "won't", "cannot", "can't", "isn't",
            "aren't", "avoid", "avoiding", "stop", "refuse", "refused", "decline", "declined"]
CLAUSE_WORDS = ["but", "however", "so", "then", "unless", "and"]
NEGATION = rf"\b({'|'.join(NEGATORS)})\b"
CLAUSE_END = rf"[,.;:!?()—–]|\b({'|'.join(CLAUSE_WORDS)})\b"


def normalise_note(col: Column) -> Column:
    """Comparable text: compatibility characters in their plain form, lower case, plain quotes, single blanks."""
    plain = F.translate(F.lower(compatible(F.coalesce(col, F.lit("")))), "’‘", "''")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _pattern(marker: Column) -> Column:
    """The marker as a whole word: no letter or digit on either side."""
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), marker, F.lit(r"\E(?![a-z0-9])"))


def has_marker(note: Column, marker: Column) -> Column:
    # The plain search spares compiling a pattern for every marker that is not in the note at all.
    return F.when(note.contains(marker), F.regexp_like(note, _pattern(marker))).otherwise(False)


def _negated(before: Column) -> Column:
    clause = F.element_at(F.split(F.right(before, F.lit(NEGATION_WINDOW)), regex(CLAUSE_END)), -1)
    return F.regexp_like(F.regexp_replace(clause, regex(r"\bnot only\b"), ""), F.lit(regex(NEGATION)))


def has_unnegated(note: Column, marker: Column) -> Column:
    """Some whole-word occurrence without a negator before it in its own clause."""
    return F.when(note.contains(marker), _clean_occurrence(note, marker)).otherwise(False)


def _clean_occurrence(note: Column, marker: Column) -> Column:
    parts = F.split(note, _pattern(marker), -1)
    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.exists(places, lambda i: ~_negated(F.call_function("array_join", F.slice(parts, F.lit(1), i), marker)))


def match_marker(note: Column, markers: Column) -> Column:
    """First marker that occurs at all."""
    return F.get(F.filter(markers, lambda m: has_marker(note, m)), F.lit(0))


def match_unnegated(note: Column, markers: Column) -> Column:
    """First marker that occurs without negation."""
    return F.get(F.filter(markers, lambda m: has_unnegated(note, m)), F.lit(0))


def score_criterion(notes: DataFrame, criteria: DataFrame, item: str = "item_id") -> DataFrame:
    """One row per note and criterion of its item: points, matched marker, blocking marker, missing facts.

    ``notes``: note_id, item, note. ``criteria``: item, criterion_id, and the arrays all_of, any_of, none_of.
    Facts (``all_of``) need presence only; choices (``any_of``) and blocks (``none_of``) respect negation.
    """
    joined = notes.withColumn("__note", normalise_note(F.col("note"))).join(criteria, item)
    note = F.col("__note")
    empty = F.array().cast("array<string>")
    facts, choices, blocks = (F.coalesce(c, empty) for c in ("all_of", "any_of", "none_of"))
    checked = joined.withColumns(
        {
            "blocked_by": match_unnegated(note, blocks),
            "missing": F.filter(facts, lambda m: ~has_marker(note, m)),
            "__choice": match_unnegated(note, choices),
            "__fact": match_marker(note, facts),
        }
    )
    met = (
        (note != "")
        & (F.size(facts) + F.size(choices) > 0)
        & F.col("blocked_by").isNull()
        & (F.size("missing") == 0)
        & ((F.size(choices) == 0) | F.col("__choice").isNotNull())
    )
    return checked.select(
        "note_id", item, "criterion_id",
        F.when(met, CRITERION_POINTS).otherwise(0).alias("points"),
        F.when(met, F.coalesce("__fact", "__choice")).alias("matched"),
        F.when(note != "", F.col("blocked_by")).alias("blocked_by"),
        "missing",
        (note == "").alias("blank"),
    )


def score_note(notes: DataFrame, criteria: DataFrame, item: str = "item_id") -> DataFrame:
    """Earned and maximum points per note."""
    rows = score_criterion(notes, criteria, item)
    return rows.groupBy("note_id", item).agg(
        F.sum("points").alias("earned"), (F.count("*") * CRITERION_POINTS).alias("max"), F.bool_or("blank").alias("blank")
    )
