"""Data quality rules: every suite emits ``(entity_id, field, rule, level)`` rows.

A suite is one projection: the failed rules of a row are gathered in an array and exploded, so a
table is read once however many rules it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import dates as D
from vetloom.functions import patterns as R
from vetloom.functions import text as X
from vetloom.functions.dates import MONTHS
from vetloom.operators.workbook import MAX_CELL_TEXT, canonical_cell_ref, split_cell_ref

FINDING = "struct<field:string,rule:string,level:string>"
Rule = tuple[Column | str, str, str, Column]


def finding(field: Column | str, rule: str, level: str, broken: Column) -> Column:
    """The finding where ``broken`` holds, else null."""
    name = F.lit(field) if isinstance(field, str) else field
    return F.when(broken, F.struct(name.alias("field"), F.lit(rule).alias("rule"), F.lit(level).alias("level")).cast(FINDING))


def emit(df: DataFrame, key: Column | str, rules: Sequence[Column], lists: Sequence[Column] = ()) -> DataFrame:
    """Explode the findings of a row: single rules, and arrays of findings."""
    none = F.array().cast(f"array<{FINDING}>")
    parts = [F.array(*rules)] if rules else []
    joined = F.concat(*parts, *[F.coalesce(p, none) for p in lists])
    entity = F.col(key) if isinstance(key, str) else key
    rows = df.select(entity.alias("entity_id"), F.explode_outer(F.filter(joined, lambda f: f.isNotNull())).alias("f"))
    return rows.filter("f is not null").select("entity_id", "f.*")


def findings_summary(findings: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Errors, warnings and the verdict per entity; an entity without findings is fine."""
    counted = findings.groupBy(F.col("entity_id").alias(key)).agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings")
    )
    joined = entities.select(key).join(counted, key, "left").na.fill(0, ["errors", "warnings"])
    return joined.withColumn("ok", F.col("errors") == 0)


def filled(col: Column) -> Column:
    return F.trim(F.coalesce(col, F.lit(""))) != ""


# ---- tables ----------------------------------------------------------------------------------------

def check_range(df: DataFrame, key: str, field: str, low: float, high: float) -> DataFrame:
    return emit(df, key, [finding(field, "out of range", "error", ~F.col(field).between(low, high) | F.col(field).isNull())])


def check_enum(df: DataFrame, key: str, field: str, allowed: Sequence[str]) -> DataFrame:
    return emit(df, key, [finding(field, "not allowed", "error", ~F.coalesce(F.col(field).isin(list(allowed)), F.lit(False)))])


def check_unique(df: DataFrame, field: str) -> DataFrame:
    """One finding per repeated value; counted with a partial aggregate, never by pairs."""
    repeated = df.groupBy(field).agg(F.count("*").alias("n")).filter("n > 1")
    return emit(repeated, field, [finding(field, "not unique", "error", F.lit(True))])


def check_foreign_key(df: DataFrame, key: str, field: str, parent: DataFrame, parent_key: str) -> DataFrame:
    known = parent.select(F.col(parent_key).alias(field)).distinct()
    lost = df.select(key, field).join(known, field, "left_anti")
    return emit(lost, key, [finding(field, "unknown reference", "error", F.lit(True))])


def check_constraints(suites: Sequence[DataFrame]) -> DataFrame:
    out = suites[0]
    for suite in suites[1:]:
        out = out.unionByName(suite)
    return out


# ---- packages ----------------------------------------------------------------------------------------

def check_exercise_package(packages: DataFrame, key: str) -> DataFrame:
    """Five questions of four options with a listed answer, 3 to 19 rows a side, three discrepancies, valid actions."""
    qs = F.col("questions")
    sides = lambda c: ~F.size(c).between(3, 19)
    rules = [
        finding("questions", "needs five questions", "error", F.size(qs) != 5),
        finding("questions", "needs four options", "error", F.exists(qs, lambda q: F.size(q["options"]) != 4)),
        finding("questions", "repeated option", "error", F.exists(qs, lambda q: F.size(F.array_distinct(q["options"])) != F.size(q["options"]))),
        finding("questions", "key is no option", "error", F.exists(qs, lambda q: ~F.array_contains(q["options"], q["answer"]))),
        finding("questions", "prompt length", "error", F.exists(qs, lambda q: ~F.length(q["prompt"]).between(15, 900))),
        finding("statement", "3 to 19 rows", "error", sides("statement")),
        finding("ledger", "3 to 19 rows", "error", sides("ledger")),
        finding("discrepancies", "needs three", "error", F.size("discrepancies") != 3),
        finding("discrepancies", "unknown reference", "error", F.size(F.array_except("discrepancies", F.concat("statement", "ledger"))) > 0),
        finding("actions", "3 to 8 actions", "error", ~F.size("actions").between(3, 8)),
        finding("actions", "key is no action", "error", F.size(F.array_except("action_keys", "actions")) > 0),
    ]
    return emit(packages, key, rules)


def check_battery_package(packages: DataFrame, key: str) -> DataFrame:
    """Sections, items, points, options, key coverage, caps and note criteria of nested packages."""
    sections = F.col("sections")
    items = F.flatten(F.transform(sections, lambda s: s["items"]))
    ids = F.transform(items, lambda i: i["id"])
    points = lambda s: F.aggregate(s["items"], F.lit(0), lambda n, i: n + i["points"])
    is_choice = lambda i: i["type"].isin("single", "multi")
    option_ids = lambda i: F.transform(i["options"], lambda o: o["id"])
    per_item = F.flatten(
        F.transform(
            items,
            lambda i: F.array(
                finding(i["id"], "points 1 to 10", "error", ~i["points"].between(1, 10)),
                finding(i["id"], "prompt length", "error", ~F.length(F.trim(i["prompt"])).between(15, 900)),
                finding(i["id"], "option count", "error", is_choice(i) & ~F.size(i["options"]).between(F.when(i["type"] == "single", 2).otherwise(3), 8)),
                finding(i["id"], "option id", "error", is_choice(i) & F.exists(option_ids(i), lambda o: ~F.regexp_like(o, F.lit(r"^o[1-8]\z")))),
                finding(i["id"], "key is no option", "error", is_choice(i) & ~F.array_contains(option_ids(i), i["answer"])),
                finding(i["id"], "tolerance 0 to 1", "error", (i["type"] == "cell") & ~i["tolerance"].between(0, 1)),
                finding(i["id"], "criteria 1 to 8", "error", (i["type"] == "note") & ~i["criteria"].between(1, 8)),
                finding(i["id"], "criteria times two", "error", (i["type"] == "note") & (i["criteria"] * 2 != i["points"])),
            ),
        )
    )
    per_section = F.flatten(
        F.transform(
            sections,
            lambda s: F.array(
                finding(s["id"], "title length", "error", ~F.length(F.trim(s["title"])).between(3, 120)),
                finding(s["id"], "item count", "error", ~F.size(s["items"]).between(1, 12)),
                finding(s["id"], "cap is not the points", "error", s["cap"].isNotNull() & (points(s) != s["cap"])),
            ),
        )
    )
    categories = F.array_distinct(F.transform(items, lambda i: i["category"]))
    rules = [
        finding("sections", "2 to 6 sections", "error", ~F.size(sections).between(2, 6)),
        finding("items", "3 to 30 items", "error", ~F.size(items).between(3, 30)),
        finding("items", "repeated id", "error", F.size(F.array_distinct(ids)) != F.size(ids)),
        finding("items", "both categories", "error", F.size(F.array_intersect(categories, F.array(F.lit("knowledge"), F.lit("reconciliation")))) < 2),
    ]
    return emit(packages, key, rules, [per_section, per_item])


def check_form_weights(points: DataFrame, form: str, section: str, expected: dict[str, int]) -> DataFrame:
    """Sections whose points differ from the weights of one named form."""
    sums = points.groupBy(form).pivot(section, list(expected)).agg(F.sum("points"))
    rules = [finding(s, "section weight", "error", F.coalesce(F.col(s), F.lit(0)) != w) for s, w in expected.items()]
    return emit(sums, form, rules)


# ---- submissions -----------------------------------------------------------------------------------

def check_workbook_cells(cells: DataFrame, sources: DataFrame, writable: Sequence[str], amount_refs: Sequence[str], key: str = "workbook_id") -> DataFrame:
    """Cell rules, then size rules per workbook. ``sources`` lists read-only ``(workbook_id, ref)``."""
    parts = split_cell_ref(F.col("ref"))
    # Columns of their own, made once per cell: the rules below read them again and again.
    named = cells.withColumns({"canon": canonical_cell_ref(F.col("ref")), "__sheet": F.lower(parts["sheet"]), "__valid": parts["row"].isNotNull()})
    marked = named.join(sources.select(key, F.col("ref").alias("canon")).distinct().withColumn("__source", F.lit(True)), [key, "canon"], "left")
    text = F.trim("text")
    signed = F.regexp_like(text, F.lit(r"^[-−‒–—]")) | F.regexp_like(text, F.lit(r"^\(.*\)\z"))
    rules = [
        finding(F.col("ref"), "invalid cell", "error", ~F.col("__valid")),
        finding(F.col("ref"), "read-only sheet", "error", F.col("__valid") & ~F.col("__sheet").isin(list(writable))),
        finding(F.col("ref"), "source cell", "error", F.coalesce("__source", F.lit(False))),
        finding(F.col("ref"), "too long", "error", F.length("text") > MAX_CELL_TEXT),
        finding(F.col("ref"), "signed amount", "error", F.col("canon").isin(list(amount_refs)) & signed),
    ]
    sizes = cells.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.length("ref") + F.length("text") + 6).alias("size"))
    whole = [
        finding("cells", "more than 400 cells", "error", F.col("n") > 400),
        finding("cells", "workbook too large", "error", F.col("size") > 48_000),
    ]
    return emit(marked, key, rules).unionByName(emit(sizes, key, whole))


def check_submission(responses: DataFrame, options: DataFrame, key: str = "attempt_id") -> DataFrame:
    """Answers to unknown items or options, too many answers, and unusable balances."""
    known = options.select("item_id", "option_id").distinct().withColumn("__listed", F.lit(True))
    items = options.select("item_id").distinct().withColumn("__item", F.lit(True))
    marked = responses.join(items, "item_id", "left").join(known, ["item_id", "option_id"], "left")
    field = F.col("item_id").cast("string")
    balance = F.col("balance").try_cast("double")
    rules = [
        finding(field, "unknown item", "error", F.col("__item").isNull()),
        finding(field, "unknown option", "error", F.col("__item").isNotNull() & F.col("__listed").isNull()),
        finding("balance", "not a usable number", "error", filled(F.col("balance")) & (balance.isNull() | (F.abs(balance) > 1e9))),
    ]
    counted = responses.groupBy(key).agg(F.count("*").alias("n"))
    return emit(marked, key, rules).unionByName(emit(counted, key, [finding("answers", "too many answers", "error", F.col("n") > 5)]))


def check_screening(df: DataFrame, key: str, today: str) -> DataFrame:
    route = F.col("travel_mode").isin("public_transport", "other")
    day = F.col("start_at").cast("date")
    rules = [
        finding("phone", "invalid phone", "error", D.normalise_phone(F.col("phone")).isNull()),
        finding("id_number", "invalid id", "error", ~D.valid_id_number(F.col("id_number"), today)),
        finding("start_at", "invalid start date", "error", ~D.valid_start_date(day, F.lit(today).cast("date"))),
        finding("day_confirmed", "not confirmed", "error", ~F.col("day_confirmed")),
        finding("travel_mode", "not allowed", "error", ~F.col("travel_mode").isin("own_vehicle", "lift", "public_transport", "other")),
        finding("travel_note", "route missing", "error", route & ~filled(F.col("travel_note"))),
        finding("travel_note", "too long", "error", F.length("travel_note") > 300),
        finding("own_transport", "not allowed", "error", ~F.col("own_transport").isin("yes", "no")),
        finding("available", "not allowed", "error", ~F.col("available").isin("yes", "no")),
    ]
    return emit(df, key, rules)


# ---- texts and records -----------------------------------------------------------------------------

_MONTH = "(?:" + "|".join(MONTHS) + ")"
RANGE_SHAPE = rf"^{_MONTH} \d{{4}} – (?:Present|{_MONTH} \d{{4}})$"


def range_findings(field: Column, value: Column, allow_empty: Column | bool = False) -> Column:
    """At most one finding: missing, hyphen, wrong form, or an end before its start."""
    empty_ok = F.lit(allow_empty) if isinstance(allow_empty, bool) else allow_empty
    start, end = D.month_index(F.trim(value)), D.month_index(F.split_part(F.trim(value), F.lit(" – "), F.lit(2)))
    rule = (
        F.when(~filled(value), F.when(~empty_ok, "duration missing"))
        .when(value.contains(" - ") | value.contains(" -- "), "hyphen, not dash")
        .when(~F.regexp_like(F.trim(value), F.lit(RANGE_SHAPE)), "wrong form")
        .when(end < start, "ends before start")
    )
    return F.when(rule.isNotNull(), F.array(F.struct(field.alias("field"), rule.alias("rule"), F.lit("error").alias("level")).cast(FINDING)))


def check_ranges(df: DataFrame, key: str, column: str) -> DataFrame:
    return emit(df, key, [], [range_findings(F.lit(column), F.col(column))])


def contact_findings(field: Column, text: Column) -> Column:
    return F.array(
        finding(field, "e-mail address", "error", F.regexp_like(text, F.lit(R.RECORD_EMAIL))),
        finding(field, "phone number", "error", F.regexp_like(text, F.lit(R.RECORD_PHONE))),
        finding(field, "link", "warning", F.regexp_like(text, F.lit(R.RECORD_URL))),
    )


def check_contact_leak(df: DataFrame, key: str, column: str) -> DataFrame:
    return emit(df, key, [], [contact_findings(F.lit(column), F.col(column))])


def bullet_findings(field: Column, raw: Column, sentence: bool) -> Column:
    """Empty, capital first, weak opener, full stop rule, length, and contact leaks of one bullet."""
    s = X.trim_all(raw)
    some = s != ""
    weak = F.lit(False)
    for opener in R.WEAK_OPENERS:
        weak = weak | F.lower(s).startswith(opener)
    shape = [
        finding(field, "empty", "error", ~some),
        finding(field, "capital first", "error", some & ~F.regexp_like(s, F.lit("^[A-Z0-9(]"))),
        finding(field, "too long", "warning", F.length(s) > 320),
    ]
    if sentence:
        shape.append(finding(field, "full stop missing", "warning", some & ~s.endswith(".")))
    else:
        shape.append(finding(field, "weak opener", "warning", some & weak))
        shape.append(finding(field, "full stop", "warning", s.endswith(".")))
    return F.concat(F.array(*shape), contact_findings(field, s))


def check_bullets(df: DataFrame, key: Column | str, column: str, sentence: bool = False) -> DataFrame:
    return emit(df, key, [], [bullet_findings(F.lit(column), F.coalesce(F.col(column), F.lit("")), sentence)])


def _path(base: str, i: Column, tail: str = "") -> Column:
    return F.concat(F.lit(f"{base}["), i.cast("string"), F.lit(f"]{tail}"))


def _rising(values: Column) -> Column:
    """Whether some value is larger than the one before it; nulls are skipped."""
    kept = F.filter(values, lambda v: v.isNotNull())
    return F.exists(F.transform(kept, lambda v, i: v > F.get(kept, i - 1)), lambda up: F.coalesce(up, F.lit(False)))


def _shouts(text: Column) -> Column:
    return filled(text) & (text == F.upper(text))


def check_record(records: DataFrame, key: str = "record_id") -> DataFrame:
    """The record suite: required fields, mode rules, summary, studies, chips, roles, duplicates, early career."""
    p, direct = F.col("personal"), F.col("meta.mode") == "direct"
    ps, exp = F.col("professionalSummary"), F.col("experience")
    rules = [
        finding("redact.candidateName", "hidden in direct mode", "error", direct & F.col("redact.candidateName")),
        finding("meta.targetRole", "required", "error", ~filled(F.col("meta.targetRole"))),
        finding("meta.targetRole", "capitals", "warning", _shouts(F.col("meta.targetRole"))),
        finding("meta.fileName", "missing", "warning", ~filled(F.col("meta.fileName"))),
        finding("personal.fullName", "required", "error", ~filled(p["fullName"])),
        finding("personal.email", "contact needed", "error", direct & ~filled(p["email"]) & ~filled(p["phone"])),
        finding("personal.email", "not an address", "error", direct & filled(p["email"]) & ~F.regexp_like(p["email"], F.lit(R.RECORD_EMAIL))),
        finding("personal.phone", "not a phone", "warning", direct & filled(p["phone"]) & ~F.regexp_like(p["phone"], F.lit(R.RECORD_PHONE))),
        finding("personal.email", "must be empty", "error", ~direct & filled(p["email"])),
        finding("personal.phone", "must be empty", "error", ~direct & filled(p["phone"])),
        finding("personal.areaOfResidence", "street address", "error", F.regexp_like(p["areaOfResidence"], F.lit(r"(?i)\d{1,4}\s+\w+\s+(?:street|road|avenue|drive|lane|close)"))),
        *[finding(f"personal.{n}", "empty", "warning", ~filled(p[n])) for n in ("citizenship", "languages", "areaOfResidence", "availability")],
        finding("consultant.contactPerson", "required", "error", ~direct & ~filled(F.col("consultant.contactPerson"))),
        finding("consultant.emailAddress", "required", "error", ~direct & ~filled(F.col("consultant.emailAddress"))),
        finding("professionalSummary", "under four bullets", "error", F.size(ps) < 4),
        finding("professionalSummary", "over six bullets", "warning", F.size(ps) > 6),
        finding("qualifications", "order", "warning", _rising(F.transform("qualifications", lambda s: s["year"].try_cast("int")))),
        finding("experience", "no entries", "error", F.size(exp) == 0),
        finding("experience", "order", "error", _rising(F.transform(exp, lambda r: D.month_index(r["duration"])))),
    ]
    summary = F.flatten(F.transform(ps, lambda b, i: bullet_findings(_path("professionalSummary", i), b, True)))
    study = F.flatten(
        F.transform(
            "qualifications",
            lambda s, i: F.array(
                finding(_path("qualifications", i), "name missing", "error", ~filled(s["name"])),
                finding(_path("qualifications", i), "year missing", "warning", ~filled(s["year"])),
                finding(_path("qualifications", i), "four digits", "error", filled(s["year"]) & ~F.regexp_like(F.trim(s["year"]), F.lit(r"^\d{4}$"))),
                finding(_path("qualifications", i), "institution missing", "warning", ~filled(s["institution"])),
            ),
        )
    )
    chips = F.flatten(F.transform("technicalSkills", lambda g, gi: F.transform(g["items"], lambda s, si: F.struct(F.concat(_path("technicalSkills", gi), F.lit(".items["), si.cast("string"), F.lit("]")).alias("at"), s.alias("s")))))
    keys = F.transform("__chips", lambda c: F.lower(F.trim(c["s"])))
    capability = F.flatten(
        F.transform(
            "__chips",
            lambda c, i: F.array(
                finding(c["at"], "empty", "error", ~filled(c["s"])),
                finding(c["at"], "duplicate", "warning", filled(c["s"]) & (F.array_position(keys, F.lower(F.trim(c["s"]))) != i + 1)),
                finding(c["at"], "too long", "warning", F.length(F.trim(c["s"])) > 38),
                finding(c["at"], "full stop", "warning", F.trim(c["s"]).endswith(".")),
            ),
        )
    )

    def role(r: Column, i: Column) -> Column:
        at = _path("experience", i)
        titles = r["titles"]
        bullets = F.transform(F.concat(r["responsibilities"], r["achievements"]), lambda b: F.lower(X.trim_all(b)))
        repeats = F.filter(bullets, lambda b, n: F.array_position(bullets, b) != n + 1)
        none = F.array().cast(f"array<{FINDING}>")
        own = F.array(
            finding(at, "employer missing", "error", ~filled(r["employer"])),
            finding(at, "no titles", "error", F.size(titles) == 0),
            finding(F.concat(at, F.lit(".titles")), "order", "error", _rising(F.transform(titles, lambda t: D.month_index(t["duration"])))),
            finding(F.concat(at, F.lit(".titles[0]")), "no current title", "error",
                    r["duration"].endswith("Present") & (F.size(titles) > 0) & ~F.exists(titles, lambda t: t["duration"].endswith("Present"))),
            finding(F.concat(at, F.lit(".context")), "full stop missing", "warning", filled(r["context"]) & ~F.trim(r["context"]).endswith(".")),
            finding(F.concat(at, F.lit(".context")), "too long", "warning", F.length(F.trim(r["context"])) > 600),
            finding(at, "no bullets", "error", F.size(bullets) == 0),
        )
        per_title = F.flatten(
            F.transform(
                titles,
                lambda t, j: F.concat(
                    F.array(
                        finding(F.concat(at, F.lit(".titles["), j.cast("string"), F.lit("]")), "title missing", "error", ~filled(t["title"])),
                        finding(F.concat(at, F.lit(".titles["), j.cast("string"), F.lit("]")), "capitals", "warning", _shouts(t["title"]) & (F.length(t["title"]) > 4)),
                    ),
                    F.coalesce(range_findings(F.concat(at, F.lit(".titles["), j.cast("string"), F.lit("].duration")), t["duration"], F.size(titles) == 1), none),
                ),
            )
        )

        def listed(n: str) -> Column:
            return F.flatten(
                F.transform(r[n], lambda b, j: bullet_findings(F.concat(at, F.lit(f".{n}["), j.cast("string"), F.lit("]")), b, False))
            )

        return F.concat(
            own, F.coalesce(range_findings(F.concat(at, F.lit(".duration")), r["duration"]), none), per_title,
            contact_findings(F.concat(at, F.lit(".context")), r["context"]), listed("responsibilities"), listed("achievements"),
            F.transform(repeats, lambda b: finding(at, "duplicated bullet", "warning", F.lit(True))),
        )

    early = F.flatten(
        F.transform(
            "earlyCareer",
            lambda r, i: F.concat(
                F.array(finding(_path("earlyCareer", i), "title missing", "error", ~filled(r["title"])), finding(_path("earlyCareer", i), "employer missing", "error", ~filled(r["employer"]))),
                F.coalesce(range_findings(_path("earlyCareer", i, ".duration"), r["duration"]), F.array().cast(f"array<{FINDING}>")),
            ),
        )
    )
    return emit(records.withColumn("__chips", chips), key, rules, [summary, study, capability, F.flatten(F.transform(exp, role)), early])


def check_alias_present(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Redaction flags that need an alias, a reference or a readable date."""
    f, p = F.col("redact"), F.col("personal")
    roles = F.transform("experience", lambda r, i: finding(_path("experience", i, ".alias"), "descriptor missing", "error", f["employerNames"] & ~filled(r["alias"])))
    early = F.transform("earlyCareer", lambda r, i: finding(_path("earlyCareer", i, ".alias"), "descriptor missing", "warning", f["employerNames"] & ~filled(r["alias"])))
    study = F.transform(
        "qualifications",
        lambda s, i: finding(_path("qualifications", i, ".institutionAlias"), "descriptor missing", "warning", f["institutions"] & filled(s["institution"]) & ~filled(s["institutionAlias"])),
    )
    rules = [
        finding("meta.reference", "reference missing", "warning", f["candidateName"] & ~filled(F.col("meta.reference"))),
        finding("personal.dateOfBirth", "unreadable date", "warning", f["dateOfBirth"] & filled(p["dateOfBirth"]) & F.try_to_date(p["dateOfBirth"], "d MMMM yyyy").isNull()),
        finding("personal.areaAlias", "area missing", "warning", f["areaOfResidence"] & filled(p["areaOfResidence"]) & ~filled(p["areaAlias"])),
    ]
    return emit(records, key, rules, [roles, early, study])


