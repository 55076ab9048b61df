"""Grading and score roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import amounts as A
from vetloom.functions import text as X


def catalogue_summary(packages: DataFrame, key: str) -> DataFrame:
    """Section titles in order, number of items and whole minutes per package."""
    count = F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["items"]))
    return packages.select(
        key,
        F.transform("sections", lambda s: s["title"]).alias("section_titles"),
        count.alias("item_count"),
        F.ceil(F.col("seconds") / 60).alias("minutes"),
    )


# ---- grading -------------------------------------------------------------------------------

def grade_join(attempts: DataFrame, items: DataFrame, responses: DataFrame) -> DataFrame:
    """Every authored item of an attempt's definition, with its response where one was saved."""
    asked = attempts.select("attempt_id", "definition_id").join(items, "definition_id")
    return asked.join(responses, ["attempt_id", "item_id"], "left")


def key_variants(base: Column, alternatives: Column) -> Column:
    """The base line key, then the base overlaid by each alternative."""
    overlaid = F.transform(alternatives, lambda alt: F.transform_values(base, lambda line, choice: F.coalesce(alt[line], choice)))
    return F.concat(F.array(base), F.coalesce(overlaid, F.array().cast("array<map<string,string>>")))


def lines_right(chosen: Column, key: Column) -> Column:
    return F.size(F.filter(F.map_keys(key), lambda line: F.coalesce(chosen[line] == key[line], F.lit(False))))


def best_key(chosen: Column, base: Column, alternatives: Column) -> Column:
    """``struct<points, variant>`` of the best key; the first wins a tie."""
    scored = F.transform(
        key_variants(base, alternatives),
        lambda key, i: F.struct(lines_right(chosen, key).alias("points"), (-i).alias("variant")),
    )
    best = F.array_max(scored)
    return F.struct(best["points"].alias("points"), (-best["variant"]).alias("variant"))


def exact_set(chosen: Column, wanted: Column) -> Column:
    """Same members in any order; an empty choice never matches."""
    return (F.size(chosen) > 0) & (F.array_sort(F.array_distinct(chosen)) == F.array_sort(wanted))


def _graded_columns() -> dict[str, Column]:
    kind = F.col("type")
    typed = X.normalise_key_text(F.col("typed"))
    packed = F.regexp_replace(F.col("code"), r"\s+", "")
    number = A.parse_amount(F.col("cell"))
    cell_ok = F.when(
        F.col("answer_number").isNotNull(),
        A.within_tolerance(number, F.col("answer_number"), F.coalesce("tolerance", F.lit(0.005))),
    ).otherwise(X.normalise_key_text(F.col("cell")) == X.normalise_key_text(F.col("answer")))
    given = (
        F.when(kind == "single", F.col("single").isNotNull())
        .when(kind == "multi", F.coalesce(F.size("multi"), F.lit(0)) > 0)
        .when(kind == "text", F.col("typed").isNotNull())
        .when(kind == "ref", F.coalesce(packed, F.lit("")) != "")
        .when(kind == "match", F.coalesce(F.size("lines"), F.lit(0)) > 0)
        .otherwise(F.coalesce(F.trim("cell"), F.lit("")) != "")
    )
    right = (
        F.when(kind == "single", F.col("single") == F.col("answer"))
        .when(kind == "multi", exact_set(F.col("multi"), F.col("answer_set")))
        .when(kind == "text", typed == X.normalise_key_text(F.col("answer")))
        .when(
            kind == "ref",
            X.parse_reference(F.col("code")).isNotNull() & (X.reference_key(F.col("code")) == X.reference_key(F.col("answer"))),
        )
        .when(kind == "match", F.col("best.points") == F.size("answer_lines"))
        .otherwise(cell_ok)
    )
    given, right = F.coalesce(given, F.lit(False)), F.coalesce(right, F.lit(False))
    chosen = F.when(kind == "single", F.array("single")).when(kind == "multi", F.col("multi"))
    return {
        "answered": given,
        "correct": F.when(given, right),
        "awarded": F.when(kind == "match", F.coalesce(F.col("best.points"), F.lit(0)))
        .otherwise(F.when(given & right, F.col("points")).otherwise(0))
        .cast("int"),
        "unsafe_hit": F.coalesce(F.size(F.array_intersect(chosen, "unsafe")) > 0, F.lit(False)),
    }


GRADED = ["attempt_id", "definition_id", "item_id", "type", "section", "category", "level", "points", "answered", "correct",
          "awarded", "unsafe_hit"]


def _graded(joined: DataFrame, key: DataFrame) -> DataFrame:
    """Every column of the responses and of the key, with the verdicts."""
    keyed = joined.join(key, "item_id")
    best = F.when((F.col("type") == "match") & F.col("lines").isNotNull(), best_key(F.col("lines"), F.col("answer_lines"), F.col("alternatives")))
    return keyed.withColumn("best", best).withColumns(_graded_columns())


def grade_items(joined: DataFrame, key: DataFrame) -> DataFrame:
    """One verdict per attempt and item. ``correct`` stays null when nothing was given."""
    return _graded(joined, key).select(*GRADED)


def match_best_key(responses: DataFrame, items: DataFrame, key: DataFrame) -> DataFrame:
    """Points and winning key variant of every line-matching response."""
    wanted = items.filter("type = 'match'").select("item_id").distinct().join(key, "item_id")
    both = responses.join(wanted, "item_id")
    best = best_key(F.col("lines"), F.col("answer_lines"), F.col("alternatives"))
    return both.select("attempt_id", "item_id", best.alias("best")).select("attempt_id", "item_id", "best.points", "best.variant")


# ---- roll-ups --------------------------------------------------------------------------------

def _totals() -> list[Column]:
    return [F.sum("awarded").alias("earned"), F.sum("points").alias("max")]


def _with_percent(df: DataFrame) -> DataFrame:
    return df.withColumn("percent", A.percent_1dp(F.col("earned"), F.col("max")))


def section_scores(graded: DataFrame, by: str = "attempt_id") -> DataFrame:
    return _with_percent(graded.groupBy(by, "section").agg(*_totals()))


def category_scores(graded: DataFrame, by: str = "attempt_id") -> DataFrame:
    return _with_percent(graded.groupBy(by, "category").agg(*_totals()))


def level_scores(graded: DataFrame, by: str = "attempt_id") -> DataFrame:
    """Earned and maximum per level; items without a level are left out."""
    return graded.filter(F.col("level").isNotNull()).groupBy(by, "level").agg(*_totals())


def score_rollup(graded: DataFrame, by: str = "attempt_id") -> DataFrame:
    """Sections, categories, levels and the total of every attempt from one pass and one shuffle."""
    sets = [[F.col(by), F.col("section")], [F.col(by), F.col("category")], [F.col(by), F.col("level")], [F.col(by)]]
    rolled = graded.groupingSets(sets, by, "section", "category", "level").agg(*_totals(), F.grouping_id().alias("gid"))
    kind = F.when(F.col("gid") == 3, "section").when(F.col("gid") == 5, "category").when(F.col("gid") == 6, "level").otherwise("total")
    label = F.coalesce("section", "category", "level", F.lit("all"))
    return _with_percent(rolled.select(by, kind.alias("kind"), label.alias("label"), "earned", "max"))


KNOWLEDGE_WEIGHT, RECONCILIATION_WEIGHT = 40, 60


def _scores(graded: DataFrame, by: str) -> DataFrame:
    """Plain total and maximum, the two category scores on their scales, and ``weighted``, their sum where both have points."""

    def part(category: str, column: str) -> Column:
        return F.sum(F.when(F.col("category") == category, F.col(column)).otherwise(0))

    sums = graded.groupBy(by).agg(
        F.sum("awarded").alias("earned"), F.sum("points").alias("max"),
        part("knowledge", "awarded").alias("k"), part("knowledge", "points").alias("k_max"),
        part("reconciliation", "awarded").alias("r"), part("reconciliation", "points").alias("r_max"),
    )

    def scaled(weight: int, earned: str, maximum: str) -> Column:
        return F.when(F.col(maximum) > 0, A.half_up(F.lit(weight) * F.col(earned) / F.col(maximum))).otherwise(0).cast("bigint")

    scores = sums.withColumn("knowledge_score", scaled(KNOWLEDGE_WEIGHT, "k", "k_max")).withColumn(
        "reconciliation_score", scaled(RECONCILIATION_WEIGHT, "r", "r_max")
    )
    both = (F.col("k_max") > 0) & (F.col("r_max") > 0)
    return scores.withColumn("weighted", F.when(both, F.col("knowledge_score") + F.col("reconciliation_score")))


def overall_score(graded: DataFrame, by: str = "attempt_id", capped: bool = True, weighted: bool = False) -> DataFrame:
    """Total and maximum per attempt, with the two category scores on their 40 and 60 point scales.

    With declared caps the total is the sum of points; without them it is the sum of both scaled scores, which ``weighted``
    adds to the capped form as a column of its own, from the same pass.
    """
    scores = _scores(graded, by)
    if capped:
        total, maximum = F.col("earned"), F.col("max")
    else:
        total, maximum = F.col("weighted"), F.when(F.col("weighted").isNotNull(), F.lit(KNOWLEDGE_WEIGHT + RECONCILIATION_WEIGHT))
    extra = ["weighted"] if weighted else []
    return scores.select(by, total.alias("overall_score"), maximum.alias("score_max"), "knowledge_score", "reconciliation_score", *extra)


def pass_flag(scores: DataFrame, pass_percent: float = 75.0) -> DataFrame:
    if not 50 <= pass_percent <= 100:
        raise ValueError("the pass percent must be 50 to 100")
    exact = F.when(F.col("score_max") > 0, F.col("overall_score") / F.col("score_max") * 100).otherwise(F.lit(0.0))
    return scores.withColumn("passed", exact >= pass_percent)


def combine_scores(scores: DataFrame) -> DataFrame:
    """The final view of a grade: everything is scored by the time it is stored."""
    maximum = F.when(F.coalesce("score_max", F.lit(0)) == 0, 100).otherwise(F.col("score_max"))
    total = F.coalesce("overall_score", F.lit(0))
    return scores.withColumns(
        {"status": F.lit("scored"), "total": total, "total_max": maximum, "percent": A.percent_1dp(total, maximum)}
    )


def critical_flags(graded: DataFrame, by: str = "attempt_id") -> DataFrame:
    """Distinct flags per attempt; sections are few, so the set stays small."""
    flag = F.concat(F.lit("Unsafe choice selected in "), F.col("section"))
    return graded.groupBy(by).agg(F.array_sort(F.collect_set(F.when(F.col("unsafe_hit"), flag))).alias("flags"))


def items_correct(graded: DataFrame, by: str = "attempt_id") -> DataFrame:
    return graded.groupBy(by).agg(F.count_if(F.coalesce("correct", F.lit(False))).alias("items_correct"), F.count("*").alias("items_total"))


def answered_progress(joined: DataFrame, key: DataFrame, by: str = "attempt_id") -> DataFrame:
    """Answered and total items; a match item counts once every line is classified."""
    keyed = joined.join(key.select("item_id", "answer_lines"), "item_id")
    kind = F.col("type")
    every_line = F.forall(F.map_keys("answer_lines"), lambda line: F.col("lines")[line].isNotNull())
    done = (
        F.when(kind == "single", F.col("single").isNotNull())
        .when(kind == "multi", F.size("multi") > 0)
        .when(kind.isin("text", "ref", "note"), F.trim(F.coalesce("typed", "code")) != "")
        .when(kind == "match", F.col("lines").isNotNull() & every_line)
        .otherwise(F.trim("cell") != "")
    )
    return keyed.groupBy(by).agg(F.count_if(F.coalesce(done, F.lit(False))).alias("answered"), F.count("*").alias("total"))


# Target share of points earned per level (fixed values).
FACILITY_BANDS = {"foundation": (0.75, 0.95), "core": (0.45, 0.80), "stretch": (0.30, 0.65)}


def item_facility(graded: DataFrame) -> DataFrame:
    """Share of points earned per item and whether it lies in the band of the item's level."""
    share = F.sum("awarded") / F.sum("points")
    per_item = graded.groupBy("item_id", "level").agg(F.round(share, 6).alias("facility"))
    inside = F.lit(None).cast("boolean")
    for level, (low, high) in FACILITY_BANDS.items():
        inside = F.when(F.col("level") == level, F.col("facility").between(low, high)).otherwise(inside)
    return per_item.withColumn("in_band", inside)


def result_review(joined: DataFrame, key: DataFrame) -> DataFrame:
    """One row per item: prompt, chosen text or "Not answered", expected text, correct."""
    kind = F.col("type")
    lines = F.array_join(F.transform(F.array_sort(F.map_keys("lines")), lambda k: F.concat_ws(": ", k, F.col("lines")[k])), "; ")
    chosen = (
        F.when(kind == "single", F.col("single")).when(kind == "multi", F.array_join("multi", "; "))
        .when(kind == "text", F.col("typed")).when(kind == "ref", F.col("code")).when(kind == "match", lines).otherwise(F.col("cell"))
    )
    expected = F.coalesce(
        F.col("answer"), F.array_join("answer_set", "; "), X.number_text(F.col("answer_number")),
        F.array_join(F.transform(F.array_sort(F.map_keys("answer_lines")), lambda k: F.concat_ws(": ", k, F.col("answer_lines")[k])), "; "),
    )
    return _graded(joined, key).select(
        "attempt_id", "item_id", F.concat("section", F.lit(": "), "prompt").alias("prompt"),
        F.coalesce(chosen, F.lit("Not answered")).alias("chosen"), expected.alias("expected"), "correct",
    )


def candidate_view(sections: DataFrame, overall: DataFrame, by: str = "attempt_id") -> DataFrame:
    """What a candidate may see: overall and section percentages with a band, nothing else."""
    share = A.percent_2dp_clamped(F.col("percent"))
    rows = sections.select(by, F.struct(F.col("section").alias("title"), share.alias("percentage"), A.feedback_band(share).alias("band")).alias("s"))
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list("s")).alias("sections"))
    return overall.select(by, A.percent_2dp_clamped(F.col("overall_score").cast("double")).alias("overall")).join(listed, by)


def attempts_used(starts: DataFrame, definition: str, identity: str, limit: int = 3) -> DataFrame:
    used = starts.groupBy(definition, identity).agg(F.count("*").alias("used"))
    return used.withColumn("at_limit", F.col("used") >= limit)


def version_count(versions: DataFrame, definition: str) -> DataFrame:
    counted = versions.groupBy(definition).agg(F.count("*").alias("n"))
    return counted.select(definition, F.concat(F.lit("v"), (F.col("n") + 1).cast("string")).alias("next_label"))


# ---- the earlier exercise format ---------------------------------------------------------------

QUESTION_POINTS, HIT_POINTS, FALSE_POSITIVE_POINTS, BALANCE_POINTS = 8, 10, 8, 10
ACTION_POINTS = [7, 7, 6]
STRONG_TOTAL, STRONG_RECONCILIATION = 80, 45


def score_exercise(attempts: DataFrame, key: DataFrame) -> DataFrame:
    """Knowledge and reconciliation points of attempts stored as one row each.

    ``attempts``: attempt_id, definition_id, mcq map, discrepancies array, actions map, balance.
    ``key``: definition_id, key_mcq map, key_discrepancies array, key_actions map, unsafe_actions array, key_balance.
    """
    joined = attempts.join(key, "definition_id")
    correct = F.size(F.filter(F.map_keys("key_mcq"), lambda q: F.coalesce(F.col("mcq")[q] == F.col("key_mcq")[q], F.lit(False))))
    chosen = F.array_distinct("discrepancies")
    hits, false_positives = F.size(F.array_intersect(chosen, "key_discrepancies")), F.size(F.array_except(chosen, "key_discrepancies"))
    weights = F.array(*[F.lit(w) for w in ACTION_POINTS])
    action = F.aggregate(
        F.transform(
            "key_discrepancies",
            lambda ref, i: F.when(
                F.array_contains("discrepancies", ref) & F.coalesce(F.col("actions")[ref] == F.col("key_actions")[ref], F.lit(False)),
                F.coalesce(F.get(weights, i), F.lit(0)),
            ).otherwise(0),
        ),
        F.lit(0),
        lambda total, points: total + points,
    )
    balance = F.when(F.abs(F.col("balance") - F.col("key_balance")) < 0.005, BALANCE_POINTS).otherwise(0)
    parts = joined.select(
        "attempt_id",
        (correct * QUESTION_POINTS).alias("knowledge_score"),
        hits.alias("hits"),
        false_positives.alias("false_positives"),
        F.greatest(F.lit(0), hits * HIT_POINTS - false_positives * FALSE_POSITIVE_POINTS).alias("identification"),
        action.alias("action_points"),
        balance.alias("balance_points"),
        F.coalesce(F.size(F.array_intersect(F.map_values("actions"), "unsafe_actions")) > 0, F.lit(False)).alias("unsafe"),
    )
    scored = parts.withColumn("reconciliation_score", F.col("identification") + F.col("action_points") + F.col("balance_points"))
    scored = scored.withColumn("overall_score", F.col("knowledge_score") + F.col("reconciliation_score"))
    flags = F.filter(
        F.array(
            F.when(F.col("false_positives") > 0, "false positive"),
            F.when(F.col("reconciliation_score") < STRONG_RECONCILIATION, "reconciliation below threshold"),
            F.when(F.col("unsafe"), "unsafe action"),
        ),
        lambda f: f.isNotNull(),
    )
    strong = (F.col("overall_score") >= STRONG_TOTAL) & (F.col("reconciliation_score") >= STRONG_RECONCILIATION) & ~F.col("unsafe")
    return scored.withColumn("flags", flags).withColumn("strong", strong)
