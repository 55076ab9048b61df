"""Rule suites over tables, packages, submissions, texts and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.projections import packages
from vetloom.catalog.registry import query
from vetloom.functions import patterns as R
from vetloom.operators import rules as K

TODAY = "1998-07-01"


def union(*rows: tuple[str, str, str, str, str, str]) -> str:
    """``(id, field, rule, level, source, condition)`` rows as one statement."""
    return " union all ".join(
        f"select {i} as entity_id, {f} as field, '{r}' as rule, '{level}' as level from {src} where {cond}" for i, f, r, level, src, cond in rows
    )


@query("check_constraints", union(
    ("o_orderkey", "'o_orderstatus'", "not allowed", "error", "orders", "o_orderstatus not in ('F', 'O')"),
    ("o_orderkey", "'o_totalprice'", "out of range", "error", "orders", "o_totalprice not between 1000 and 450000"),
    ("o_custkey", "'o_custkey'", "not unique", "error", "(select o_custkey from orders group by 1 having count(*) > 1) x", "true"),
    ("o_orderkey", "'o_custkey'", "unknown reference", "error", "orders", "o_custkey not in (select c_custkey from customer where c_acctbal > 0)"),
))
def _(t):
    return K.check_constraints([
        K.check_enum(t.orders, "o_orderkey", "o_orderstatus", ["F", "O"]), K.check_range(t.orders, "o_orderkey", "o_totalprice", 1000, 450000),
        K.check_unique(t.orders, "o_custkey"), K.check_foreign_key(t.orders, "o_orderkey", "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey"),
    ])


def exercise_packages(t):
    ref = lambda n: F.concat(F.lit("T"), n.cast("string"))
    size = F.col("p_size").cast("int")
    question = F.struct(F.concat(F.lit("What about "), F.col("p_name")).alias("prompt"), F.when(F.col("p_partkey") % 5 == 0, F.split(F.lit("a b a d"), " ")).otherwise(F.split(F.lit("a b c d"), " ")).alias("options"),
                        F.when(F.col("p_partkey") % 7 == 0, "x").otherwise("b").alias("answer"))
    return t.part.select(
        "p_partkey", F.array_repeat(question, 5 - (F.col("p_partkey") % 6 == 0).cast("int")).alias("questions"),
        F.transform(F.sequence(F.lit(1), size), ref).alias("statement"), F.transform(F.sequence(F.lit(1), F.floor((size + 1) / 2).cast("int")), ref).alias("ledger"),
        F.transform(F.sequence(F.lit(1), F.lit(3) + (F.col("p_partkey") % 4 == 0).cast("int")), ref).alias("discrepancies"),
        F.transform(F.sequence(F.lit(1), F.lit(2) + (F.col("p_partkey") % 9).cast("int")), ref).alias("actions"), F.array(F.lit("T1"), F.lit("T3")).alias("action_keys"),
    )


@query("check_exercise_package", union(*[("p_partkey", f"'{f}'", r, "error", "part", c) for f, r, c in [
    ("questions", "needs five questions", "p_partkey % 6 = 0"), ("questions", "repeated option", "p_partkey % 5 = 0"), ("questions", "key is no option", "p_partkey % 7 = 0"),
    ("statement", "3 to 19 rows", "p_size not between 3 and 19"), ("ledger", "3 to 19 rows", "(p_size + 1) // 2 not between 3 and 19"),
    ("discrepancies", "needs three", "p_partkey % 4 = 0"), ("discrepancies", "unknown reference", "greatest(p_size, (p_size + 1) // 2) < 3 + cast(p_partkey % 4 = 0 as int)"),
    ("actions", "3 to 8 actions", "p_partkey % 9 + 2 not between 3 and 8"), ("actions", "key is no action", "p_partkey % 9 + 2 < 3"),
]]))
def _(t):
    return K.check_exercise_package(exercise_packages(t), "p_partkey")


_Q2 = "case when p_partkey % 9 = 0 then 'q1' else 'q2' end"
_NOTE = "(p_size % 4 * 2 + cast(p_partkey % 7 = 0 as int))"


@query("check_battery_package", union(*[("p_partkey", f, r, "error", "part", c) for f, r, c in [
    ("'items'", "repeated id", "p_partkey % 9 = 0"), ("'s1'", "cap is not the points", "p_size % 3 > 0 and p_size % 12 + 3 <> p_size % 12 + 3"),
    ("'q1'", "points 1 to 10", "p_size % 12 not between 1 and 10"), ("'q4'", "points 1 to 10", f"{_NOTE} not between 1 and 10"),
    ("'q1'", "prompt length", "length('Describe ' || p_name) not between 15 and 900"), (_Q2, "prompt length", "length('Describe ' || p_name) not between 15 and 900"),
    ("'q3'", "prompt length", "length('Describe ' || p_name) not between 15 and 900"), ("'q4'", "prompt length", "length('Describe ' || p_name) not between 15 and 900"),
    ("'q1'", "key is no option", "p_partkey % 5 = 4"), (_Q2, "key is no option", "p_partkey % 5 = 4"), ("'q3'", "tolerance 0 to 1", "p_size > 40"),
    ("'q4'", "criteria 1 to 8", "p_size % 4 = 0"), ("'q4'", "criteria times two", "p_partkey % 7 = 0"),
]]))
def _(t):
    return K.check_battery_package(packages(t), "p_partkey")


@query("check_form_weights", """with s as (select l_suppkey, sum(case when l_returnflag = 'A' then l_linenumber end) as a, sum(case when l_returnflag = 'N' then l_linenumber end) as n from line_v group by 1)
    select l_suppkey as entity_id, unnest(['A', 'N']) as field, 'section weight' as rule, 'error' as level from s where a <> 600 and n <> 600
    union all select l_suppkey, 'A', 'section weight', 'error' from s where a <> 600 and n = 600 union all select l_suppkey, 'N', 'section weight', 'error' from s where a = 600 and n <> 600""")
def _(t):
    return K.check_form_weights(t.line_v.withColumnRenamed("l_linenumber", "points"), "l_suppkey", "l_returnflag", {"A": 600, "N": 600})


@query("check_workbook_cells", union(
    ("workbook_id", "'Other!' || col || row_no", "read-only sheet", "error", "cells_v", "col = 'C'"),
    ("workbook_id", "'Data!' || col || row_no", "source cell", "error", "cells_v", "col = 'A' and row_no <= 2"),
    ("workbook_id", "'Data!Z' || row_no", "invalid cell", "error", "cells_v", "col = 'D'"),
    ("workbook_id", "'Data!' || col || row_no", "too long", "error", "cells_v", "col = 'E' and row_no = 7"),
    ("workbook_id", "'Data!B1'", "signed amount", "error", "cells_v", "col = 'B' and row_no = 1 and workbook_id % 2 = 0"),
))
def _(t):
    ref = F.concat(F.when(F.col("col") == "C", "Other!").otherwise("Data!"), F.when(F.col("col") == "D", "Z").otherwise(F.col("col")), F.col("row_no").cast("string"))
    text = (
        F.when((F.col("col") == "E") & (F.col("row_no") == 7), F.repeat(F.lit("x"), 201))
        .when((F.col("col") == "B") & (F.col("workbook_id") % 4 == 0), F.concat(F.lit("-"), "text"))
        .when((F.col("col") == "B") & (F.col("workbook_id") % 4 == 2), F.concat(F.lit("("), "text", F.lit(")"))).otherwise(F.col("text"))
    )
    cells = t.cells_v.select("workbook_id", ref.alias("ref"), text.alias("text"))
    sources = t.cells_v.filter("col = 'A' and row_no <= 2").select("workbook_id", F.concat(F.lit("data!A"), F.col("row_no").cast("string")).alias("ref"))
    return K.check_workbook_cells(cells, sources, ["data"], ["data!B1"])


@query("check_submission", union(
    ("attempt_id", "cast(item_id as varchar)", "unknown item", "error", "answers_v", "item_id > 5"),
    ("attempt_id", "cast(item_id as varchar)", "unknown option", "error", "answers_v", "item_id <= 5 and single = 'R'"),
    ("attempt_id", "'balance'", "not a usable number", "error", "answers_v", "try_cast(cell as double) is null"),
    ("attempt_id", "'answers'", "too many answers", "error", "(select attempt_id from answers_v group by 1 having count(*) > 5) x", "true"),
))
def _(t):
    responses = t.answers_v.select("attempt_id", "item_id", F.col("single").alias("option_id"), F.col("cell").alias("balance"))
    options = t.items_v.filter("item_id <= 5").select("item_id", F.explode(F.array(F.lit("A"), F.lit("N"))).alias("option_id"))
    return K.check_submission(responses, options)


@query("check_screening", r"""with d as (select *, regexp_replace(phone, '[\s()-]', '', 'g') as p, '19' || substr(id_number, 1, 2) || '-' || substr(id_number, 3, 2) || '-' || substr(id_number, 5, 2) as this_c,
      '18' || substr(id_number, 1, 2) || '-' || substr(id_number, 3, 2) || '-' || substr(id_number, 5, 2) as last_c, list_sum(list_transform(range(1, 14), lambda i: case when i % 2 = 1 then cast(substr(id_number, i, 1) as int)
        when cast(substr(id_number, i, 1) as int) > 4 then cast(substr(id_number, i, 1) as int) * 2 - 9 else cast(substr(id_number, i, 1) as int) * 2 end)) as luhn from customer_v) """ + union(
    ("candidate_id", "'phone'", "invalid phone", "error", "d", r"not regexp_matches(p, '^(0|\+27)[1-9]\d{8}$')"),
    ("candidate_id", "'id_number'", "invalid id", "error", "d", "not (try_cast(case when this_c > '1998-07-01' then last_c else this_c end as date) is not null and substr(id_number, 11, 1) in ('0', '1') and luhn % 10 = 0)"),
    ("candidate_id", "'start_at'", "invalid start date", "error", "d", "not (cast(start_at as date) between date '1998-07-02' and date '1998-09-29' and isodow(start_at) < 6)"),
    ("candidate_id", "'day_confirmed'", "not confirmed", "error", "d", "not day_confirmed"),
    ("candidate_id", "'travel_mode'", "not allowed", "error", "d", "travel_mode = 'teleport'"),
    ("candidate_id", "'travel_note'", "route missing", "error", "d", "travel_mode in ('public_transport', 'other') and trim(travel_note) = ''"),
    ("candidate_id", "'own_transport'", "not allowed", "error", "d", "own_transport = 'maybe'"),
))
def _(t):
    return K.check_screening(t.customer_v, "candidate_id", TODAY)


_OM = "strftime({}, '%B %Y')"


@query("check_ranges", """select o_orderkey as entity_id, 'duration' as field, case o_orderkey % 6 when 0 then 'duration missing' when 1 then 'hyphen, not dash' when 2 then 'wrong form' else 'ends before start' end as rule, 'error' as level
    from orders where o_orderkey % 6 < 3 or (o_orderkey % 6 = 3 and date_trunc('month', o_orderdate - interval '40' day) < date_trunc('month', o_orderdate))""")
def _(t):
    start = F.date_format("o_orderdate", "MMMM yyyy")
    k = F.col("o_orderkey") % 6
    earlier = F.date_format(F.expr("o_orderdate - interval '40' day"), "MMMM yyyy")
    text = (
        F.when(k == 0, " ").when(k == 1, F.concat(start, F.lit(" - "), start)).when(k == 2, F.date_format("o_orderdate", "MMM yyyy"))
        .when(k == 3, F.concat(start, F.lit(" – "), earlier)).when(k == 4, F.concat(start, F.lit(" – Present"))).otherwise(F.concat(start, F.lit(" – "), start))
    )
    return K.check_ranges(t.orders.withColumn("duration", text), "o_orderkey", "duration")


_S = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_LEAKS = [("e-mail address", "error", f"regexp_matches({{}}, '{R.RECORD_EMAIL}')"), ("phone number", "error", f"regexp_matches({{}}, '{R.RECORD_PHONE}')"), ("link", "warning", f"regexp_matches({{}}, '{R.RECORD_URL}')")]
_WEAK = " or ".join(f"starts_with(lower(s), '{w}')" for w in R.WEAK_OPENERS)


@query("check_bullets", f"""with b as (select conv_id * 1000 + turn as entity_id, {_S.format("unnest(string_split(text, chr(10)))")} as s from conversations) """ + union(
    ("entity_id", "'line'", "empty", "error", "b", "s = ''"), ("entity_id", "'line'", "capital first", "error", "b", "s <> '' and not regexp_matches(s, '^[A-Z0-9(]')"),
    ("entity_id", "'line'", "too long", "warning", "b", "length(s) > 320"), ("entity_id", "'line'", "weak opener", "warning", "b", f"s <> '' and ({_WEAK})"),
    ("entity_id", "'line'", "full stop", "warning", "b", "s like '%.'"), *[("entity_id", "'line'", r, lv, "b", c.replace("{}", "s")) for r, lv, c in _LEAKS],
))
def _(t):
    lines = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("entity"), F.explode(F.split("text", "\n")).alias("line"))
    return K.check_bullets(lines, "entity", "line")


@query("check_contact_leak", "with b as (select doc_id, text as s from documents union all select doc_id + 1000000000, text from briefs_v) " + union(*[("doc_id", "'text'", r, lv, "b", c.replace("{}", "s")) for r, lv, c in _LEAKS]))
def _(t):
    both = t.documents.select("doc_id", "text").unionByName(t.briefs_v.select((F.col("doc_id") + 1000000000).alias("doc_id"), "text"))
    return K.check_contact_leak(both, "doc_id", "text")


# ---- the record suite ---------------------------------------------------------------------------------

_MONTHS = "['January','February','March','April','May','June','July','August','September','October','November','December']"
_IX = "(case when regexp_matches({0}, '^[A-Z][a-z]+ [0-9]') then cast(regexp_extract({0}, '[0-9]+') as int) * 12 + list_position(" + _MONTHS + ", split_part({0}, ' ', 1)) - 1 end)"
_D = "meta.mode = 'direct'"


def bullets_sql(source: str, field: str, sentence: bool):
    text = _S.format("v")
    own = [("empty", "error", f"{text} = ''"), ("capital first", "error", f"{text} <> '' and not regexp_matches({text}, '^[A-Z0-9(]')"), ("too long", "warning", f"length({text}) > 320")]
    if sentence:
        own.append(("full stop missing", "warning", f"{text} <> '' and {text} not like '%.'"))
    else:
        own += [("weak opener", "warning", f"{text} <> '' and (" + _WEAK.replace("lower(s)", f"lower({text})") + ")"), ("full stop", "warning", f"{text} like '%.'")]
    return [("record_id", field, r, lv, source, c) for r, lv, c in own] + [("record_id", field, r, lv, source, c.replace("{}", text)) for r, lv, c in _LEAKS]


def range_sql(source: str, field: str, empty_ok: str):
    good = r"regexp_matches(v, '^(January|February|March|April|May|June|July|August|September|October|November|December) \d{4} – (Present|(January|February|March|April|May|June|July|August|September|October|November|December) \d{4})$')"
    return [
        ("record_id", field, "duration missing", "error", source, f"v = '' and not {empty_ok}"), ("record_id", field, "hyphen, not dash", "error", source, "v like '% - %'"),
        ("record_id", field, "wrong form", "error", source, f"v <> '' and v not like '% - %' and not {good}"),
        ("record_id", field, "ends before start", "error", source, f"{good} and {_IX.format('split_part(v, chr(32) || chr(8211) || chr(32), 2)')} < {_IX.format('v')}"),
    ]


_RECORD = (
    "with roles as (select record_id, generate_subscripts(experience, 1) - 1 as i, unnest(experience) as r from records_v), "
    "titles as (select record_id, i, generate_subscripts(r.titles, 1) - 1 as j, unnest(r.titles) as tt from roles), "
    "rb as (select record_id, 'experience[' || i || '].responsibilities[' || (generate_subscripts(r.responsibilities, 1) - 1) || ']' as path, unnest(r.responsibilities) as v from roles), "
    "ab as (select record_id, 'experience[' || i || '].achievements[' || (generate_subscripts(r.achievements, 1) - 1) || ']' as path, unnest(r.achievements) as v from roles), "
    "ps as (select record_id, 'professionalSummary[' || (generate_subscripts(professionalSummary, 1) - 1) || ']' as path, unnest(professionalSummary) as v from records_v), "
    "qs as (select record_id, generate_subscripts(qualifications, 1) - 1 as i, unnest(qualifications) as s from records_v), "
    "chips as (select record_id, g, generate_subscripts(items, 1) - 1 as j, unnest(items) as v from (select record_id, 0 as g, technicalSkills[1].items as items from records_v union all select record_id, 1, technicalSkills[2].items from records_v) x), "
    "cd as (select *, row_number() over (partition by record_id, lower(v) order by g, j) as n from chips), "
    "bl as (select record_id, i, lower(trim(unnest(list_concat(r.responsibilities, r.achievements)))) as b from roles), "
    "rd as (select record_id, 'experience[' || i || '].duration' as path, r.duration as v from roles), td as (select record_id, 'experience[' || i || '].titles[' || j || '].duration' as path, tt.duration as v from titles), "
    "ed as (select record_id, 'earlyCareer[0].duration' as path, earlyCareer[1].duration as v from records_v), cx as (select record_id, 'experience[' || i || '].context' as path, r.context as v from roles) "
)
_AT = "'experience[' || i || ']'"
_ONE = [
    ("'redact.candidateName'", "hidden in direct mode", "error", f"{_D} and redact.candidateName"), ("'meta.targetRole'", "required", "error", "meta.targetRole = ''"),
    ("'meta.targetRole'", "capitals", "warning", "meta.targetRole <> '' and meta.targetRole = upper(meta.targetRole)"), ("'meta.fileName'", "missing", "warning", "meta.fileName = ''"),
    ("'personal.fullName'", "required", "error", "personal.fullName = ''"), ("'personal.email'", "contact needed", "error", f"{_D} and personal.email = '' and personal.phone = ''"),
    ("'personal.email'", "not an address", "error", f"{_D} and personal.email = 'not an address'"), ("'personal.phone'", "not a phone", "warning", f"{_D} and personal.phone = '12'"),
    ("'personal.email'", "must be empty", "error", f"not {_D} and personal.email <> ''"), ("'personal.phone'", "must be empty", "error", f"not {_D} and personal.phone <> ''"),
    ("'personal.areaOfResidence'", "street address", "error", "personal.areaOfResidence like '12 Long%'"), ("'personal.languages'", "empty", "warning", "personal.languages = ''"),
    ("'personal.availability'", "empty", "warning", "personal.availability = ''"), ("'consultant.contactPerson'", "required", "error", f"not {_D} and consultant.contactPerson = ''"),
    ("'professionalSummary'", "under four bullets", "error", "len(professionalSummary) < 4"),
    ("'qualifications'", "order", "warning", "try_cast(qualifications[2].year as int) > try_cast(qualifications[1].year as int)"),
    ("'experience'", "order", "error", f"{_IX.format('experience[2].duration')} > {_IX.format('experience[1].duration')}"),
]
_RECORD_SQL = _RECORD + union(
    *[("record_id", f, r, lv, "records_v", c) for f, r, lv, c in _ONE], *bullets_sql("ps", "path", True), *bullets_sql("rb", "path", False), *bullets_sql("ab", "path", False),
    ("record_id", "'qualifications[' || i || ']'", "name missing", "error", "qs", "s.name = ''"), ("record_id", "'qualifications[' || i || ']'", "year missing", "warning", "qs", "s.year = ''"),
    ("record_id", "'qualifications[' || i || ']'", "four digits", "error", "qs", "s.year = '09'"),
    *[("record_id", "'technicalSkills[' || g || '].items[' || j || ']'", r, "warning", "cd", c) for r, c in [("duplicate", "n > 1"), ("too long", "length(v) > 38"), ("full stop", "v like '%.'")]],
    ("record_id", _AT, "employer missing", "error", "roles", "r.employer = ''"),
    ("record_id", f"{_AT} || '.titles'", "order", "error", "roles", f"{_IX.format('r.titles[2].duration')} > {_IX.format('r.titles[1].duration')}"),
    ("record_id", f"{_AT} || '.titles[0]'", "no current title", "error", "roles", "r.duration like '%Present' and r.titles[1].duration not like '%Present' and r.titles[2].duration not like '%Present'"),
    ("record_id", f"{_AT} || '.context'", "full stop missing", "warning", "roles", "r.context not like '%.'"),
    ("record_id", f"{_AT} || '.titles[' || j || ']'", "capitals", "warning", "titles", "tt.title = upper(tt.title)"),
    *range_sql("rd", "path", "false"), *range_sql("td", "path", "false"), *range_sql("ed", "path", "false"), *[("record_id", "path", r, lv, "cx", c.replace("{}", "v")) for r, lv, c in _LEAKS],
) + f" union all select record_id, {_AT}, 'duplicated bullet', 'warning' from (select record_id, i, b, count(*) - 1 as n from (select record_id, i, regexp_replace(b, '^\\s+|\\s+$', '', 'g') as b from bl) y group by 1, 2, 3) x, range(n)"


@query("check_record", _RECORD_SQL)
def _(t):
    return K.check_record(t.records_v)


@query("check_alias_present", "with r as (select *, generate_subscripts(experience, 1) - 1 as i, unnest(experience) as e from records_v) " + union(
    ("record_id", "'experience[' || i || '].alias'", "descriptor missing", "error", "r", "redact.employerNames and e.alias = ''"),
    ("record_id", "'earlyCareer[0].alias'", "descriptor missing", "warning", "records_v", "redact.employerNames"),
    ("record_id", "'qualifications[0].institutionAlias'", "descriptor missing", "warning", "records_v", "redact.institutions"),
    ("record_id", "'meta.reference'", "reference missing", "warning", "records_v", "redact.candidateName and meta.reference = ''"),
    ("record_id", "'personal.areaAlias'", "area missing", "warning", "records_v", "redact.areaOfResidence and personal.areaAlias = ''"),
))
def _(t):
    return K.check_alias_present(t.records_v)


@query("findings_summary", f"""with f as ({_RECORD_SQL}), c as (select entity_id, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings from f group by 1)
    select record_id, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, coalesce(errors, 0) = 0 as ok from records_v left join c on entity_id = record_id""")
def _(t):
    return K.findings_summary(K.check_record(t.records_v), t.records_v, "record_id")
