"""CV reading, candidate records and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.predicates import PAIRS, turn_pairs
from vetloom.catalog.registry import SQL_VIEWS, query
from vetloom.catalog.review import bare, q, sql_list
from vetloom.catalog.sqltext import tenure_case
from vetloom.functions import patterns as R
from vetloom.functions import text as X
from vetloom.operators import records as C
from vetloom.operators import suggestions as G
from vetloom.sources import records as spec

SQL_VIEWS["records_v"] = spec.duckdb_sql()
TODAY = "1998-07-01"


@query("split_lines", r"""select doc_id, generate_subscripts(ls, 1) - 1 as line_no, regexp_replace(unnest(ls), '\s+$', '') as line
    from (select doc_id, string_split(text, chr(10)) as ls from documents) x""")
def _(t):
    return C.split_lines(t.documents, "doc_id", "text")


_LABEL = r"""lower(regexp_replace(regexp_replace(regexp_replace(trim(line), '^[•●*\-–—▪▫➢✓+>#|~]+\s*', ''), '^(?:\d{1,2}\.?|[A-Za-z]\.|\([A-Za-z0-9]+\))\s+', ''), '[:\s|~]+$', ''))"""
_FIELD = sql_list([f for labels in R.CV_FIELDS.values() for f in labels])
_SECTION = "case " + " ".join(f"when list_contains({sql_list(h)}, {bare('label')}) then '{n}'" for n, h in R.CV_SECTIONS.items()) + " end"
_CV_LINES = rf"""l as (select doc_id, generate_subscripts(ls, 1) as n, regexp_replace(unnest(ls), '\s+$', '') as line from (select doc_id, string_split(text, chr(10)) as ls from cvs_v) x),
    b as (select *, {_LABEL} as label from l),
    h as (select *, case when trim(line) <> '' and length(trim(line)) <= 75 and not regexp_matches(trim(line), '[.!?]$') and len(regexp_split_to_array(label, '\s+')) <= 6
      and not list_contains({_FIELD}, {bare('label')}) then {_SECTION} end as opens from b)"""


@query("is_heading_line", f"with {_CV_LINES} select doc_id, n - 1 as line_no, opens from h")
def _(t):
    return C.split_lines(t.cvs_v, "doc_id", "text").select("doc_id", "line_no", C.heading_name(F.col("line")).alias("opens"))


@query(
    "segment_sections",
    f"""with {_CV_LINES}, s as (select *, coalesce(last_value(opens ignore nulls) over w, 'head') as section, sum(cast(opens is not null as int)) over w as part_no from h
      window w as (partition by doc_id order by n))
    select doc_id, cast(part_no as bigint) as part_no, any_value(section) as section, coalesce(string_agg(line, '|' order by n) filter (opens is null), '') as body from s group by 1, 2""",
)
def _(t):
    parts = C.segment_sections(t.cvs_v, "doc_id", "text")
    return parts.select("doc_id", "part_no", "section", F.array_join("lines", "|").alias("body"))


@query(
    "labelled_fields",
    """select c_custkey as doc_id, unnest(['fullName', 'citizenship', 'email', 'phone', 'ownTransport', 'dateOfBirth']) as field, unnest(['Candidate ' || c_custkey, n_name, 'c' || c_custkey || '@mail.org',
      '082 555 ' || lpad(cast(c_custkey % 10000 as varchar), 4, '0'), ['Yes', 'No', 'Yes', 'sometimes'][c_custkey % 4 + 1], '7 March 1985']) as value from customer join nation on c_nationkey = n_nationkey""",
)
def _(t):
    return C.labelled_fields(C.segment_sections(t.cvs_v, "doc_id", "text"), "doc_id")


@query(
    "first_contact",
    rf"""with x as (select doc_id, text from documents union all select doc_id + 1000000000, text from cvs_v), p as (select doc_id, text, coalesce(trim(list_filter(list_transform(string_split(text, chr(10)),
      lambda l: regexp_extract(l, '{R.CV_PHONE}')), lambda m: m <> '')[1]), '') as phone from x)
    select doc_id, regexp_extract(text, '{R.RECORD_EMAIL}') as email, case when length(regexp_replace(phone, '\D', '', 'g')) = 13 then '' else phone end as phone from p""",
)
def _(t):
    both = t.documents.select("doc_id", "text").unionByName(t.cvs_v.select((F.col("doc_id") + 1000000000).alias("doc_id"), "text"))
    return C.first_contact(both, "doc_id", "text")


@query(
    "drop_contact_by_mode",
    """select record_id, case when meta.mode = 'direct' then personal.email else '' end as email, case when meta.mode = 'direct' then personal.phone else '' end as phone,
      meta.mode <> 'direct' and (personal.email <> '' or personal.phone <> '') as contact_gap from records_v""",
)
def _(t):
    return C.drop_contact_by_mode(t.records_v).select("record_id", "personal.email", "personal.phone", "contact_gap")


@query("skill_items", """select c_custkey as doc_id, unnest(['Tools', 'Tools', 'Tools', 'Tools', '']) as "group", unnest(['SQL', 'Excel', 'sql', 'ledger work', 'Typing']) as item from customer""")
def _(t):
    return C.skill_items(C.segment_sections(t.cvs_v, "doc_id", "text"), "doc_id").drop("line_no")


@query(
    "study_year",
    rf"""with l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from
      (select doc_id, text from documents union all select doc_id + 1000000000, text from cvs_v) u) x)
    select doc_id, line_no, regexp_extract_all(line, '{R.CV_YEAR}')[-1] as year from l where regexp_matches(line, '{R.CV_YEAR}')""",
)
def _(t):
    both = t.documents.select("doc_id", "text").unionByName(t.cvs_v.select((F.col("doc_id") + 1000000000).alias("doc_id"), "text"))
    return C.study_year(both, "doc_id", "text")


_FIRST_DATES = "['January 2015 – March 2018', 'January 2015 – March 2018', 'January 2015 – Present', '2015 – 2018', 'September 2015 – December 2017'][c_custkey % 5 + 1]"


@query(
    "role_anchors",
    f"""select c_custkey as doc_id, unnest([0, 1]) as role_no, unnest(['North Bank Ltd|Senior Clerk', 'South Shop']) as heading, unnest([{_FIRST_DATES}, 'May 2012 – November 2014']) as dates,
      unnest([case when c_custkey % 5 = 3 then 'year' else 'month' end, 'month']) as precision,
      unnest(['- kept the books|- checked invoices|Key Achievements:|- saved money|Reason for leaving: growth', 'Responsibilities|- filed papers']) as body from customer""",
)
def _(t):
    roles = C.role_anchors(C.segment_sections(t.cvs_v, "doc_id", "text"), "doc_id")
    return roles.select("doc_id", "role_no", F.array_join("heading", "|").alias("heading"), "dates", "precision", F.array_join("body", "|").alias("body"))


@query(
    "body_buckets",
    """select c_custkey as doc_id, unnest([0, 0, 0, 1]) as role_no, unnest(['responsibilities', 'responsibilities', 'achievements', 'responsibilities']) as bucket,
      unnest(['kept the books', 'checked invoices', 'saved money', 'filed papers']) as bullet from customer""",
)
def _(t):
    return C.body_buckets(C.role_anchors(C.segment_sections(t.cvs_v, "doc_id", "text"), "doc_id"), "doc_id")


# ---- nested records --------------------------------------------------------------------------------

_CALM = r"case when {0} = upper({0}) and length({0}) > 4 then array_to_string(list_transform(regexp_split_to_array(lower({0}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') else {0} end"
_FRAG = r"array_to_string(list_transform(list_filter(list_transform({0}, lambda b: trim(b)), lambda b: b <> ''), lambda b: upper(substr(b, 1, 1)) || substr(regexp_replace(b, '[.;,]+$', ''), 2)), '|')"


@query(
    "standardise_records",
    rf"""select record_id, {_CALM.format('meta.targetRole')} as role,
      array_to_string(list_transform(professionalSummary, lambda b: upper(substr(b, 1, 1)) || substr(b, 2) || case when b like '%.' then '' else '.' end), '|') as summary,
      array_to_string(list_transform(experience, lambda r: regexp_replace(r.duration, '\s+[-–—]+\s+', ' – ', 'g') || '/' || {_CALM.format('r.titles[1].title')} || '/' ||
        {_FRAG.format('r.responsibilities')} || '/' || {_FRAG.format('r.achievements')}), ';') as roles,
      array_to_string(list_transform(technicalSkills[1].items, lambda s: regexp_replace(s, '[.,;]+$', '')), '|') as chips from records_v""",
)
def _(t):
    done = C.standardise_records(t.records_v)
    role = lambda r: F.concat_ws("/", r["duration"], r["titles"][0]["title"], F.array_join(r["responsibilities"], "|"), F.array_join(r["achievements"], "|"))
    return done.select(
        "record_id", F.col("meta.targetRole").alias("role"), F.array_join("professionalSummary", "|").alias("summary"),
        F.array_join(F.transform("experience", role), ";").alias("roles"), F.array_join(F.col("technicalSkills")[0]["items"], "|").alias("chips"),
    )


_MI = "(cast(regexp_extract({0}, '([0-9]{{4}})$', 1) as int) * 12 + list_position(['January','February','March','April','May','June','July','August','September','October','November','December'], split_part({0}, ' ', 1)) - 1)"
_BAND = "case when {0} like '% – %' then " + tenure_case("greatest(0, case when {0} like '%Present' then 1998 * 12 + 6 else " + _MI.format("split_part({0}, ' – ', 2)") + " end - " + _MI.format("split_part({0}, ' – ', 1)") + ")") + " else {0} end"
_AGE = "(1998 - cast(split_part(personal.dateOfBirth, ' ', 3) as int) - case when split_part(personal.dateOfBirth, ' ', 2) in ('July', 'September', 'November') and personal.dateOfBirth not like '1 July%' then 1 else 0 end)"


@query(
    "redact_records",
    f"""select record_id, case when redact.candidateName then case when meta.reference <> '' then meta.reference when personal.fullName = '' then 'Candidate profile' else 'A.M.S.' end
        else personal.fullName end as name, case when redact.candidateName then '' else personal.email end as email,
      case when redact.dateOfBirth then '' else personal.dateOfBirth end as born,
      case when redact.dateOfBirth then case when {_AGE} < 0 then '' else cast({_AGE} // 5 * 5 as varchar) || ' – ' || cast({_AGE} // 5 * 5 + 5 as varchar) end end as age,
      case when redact.areaOfResidence then personal.areaAlias else personal.areaOfResidence end as area,
      array_to_string(list_transform(experience, lambda r: case when redact.employerNames then r.alias else r.employer end || '/' ||
        case when redact.dates then {_BAND.replace('{0}', 'r.duration')} else r.duration end), ';') as roles,
      array_to_string(list_transform(qualifications, lambda s: case when redact.institutions then s.institutionAlias else s.institution end || '/' ||
        case when redact.qualificationYears then '' else s.year end), ';') as study from records_v""",
)
def _(t):
    done = C.redact_records(t.records_v, TODAY)
    return done.select(
        "record_id", F.col("personal.fullName").alias("name"), "personal.email", F.col("personal.dateOfBirth").alias("born"), F.col("personal.ageBand").alias("age"),
        F.col("personal.areaOfResidence").alias("area"), F.array_join(F.transform("experience", lambda r: F.concat_ws("/", r["employer"], r["duration"])), ";").alias("roles"),
        F.array_join(F.transform("qualifications", lambda s: F.concat_ws("/", s["institution"], s["year"])), ";").alias("study"),
    )


def _each(base: str, items: str, names) -> str:
    return " union all ".join(
        f"select record_id, '{base}[' || (generate_subscripts({items}, 1) - 1) || '].{n}' as path, unnest(list_transform({items}, lambda s: s.{n})) as value from records_v" for n in names
    )


def _inner(base: str, items: str, part: str, names=None) -> str:
    out = []
    for i in (1, 2):
        for n in names or [None]:
            values = f"{items}[{i}].{part}" if n is None else f"list_transform({items}[{i}].{part}, lambda s: s.{n})"
            tail = "" if n is None else f" || '.{n}'"
            out.append(f"select record_id, '{base}[{i - 1}].{part}[' || (generate_subscripts({values}, 1) - 1) || ']'{tail} as path, unnest({values}) as value from records_v")
    return " union all ".join(out)


_PLAIN = ["fullName", "citizenship", "languages", "dateOfBirth", "areaOfResidence", "availability"]
SQL_VIEWS["flat_v"] = " union all ".join([
    "select record_id, 'meta.targetRole' as path, meta.targetRole as value from records_v",
    *[f"select record_id, 'personal.{n}', personal.{n} from records_v" for n in _PLAIN],
    *[f"select record_id, 'personal.{n}', personal.{n} from records_v where meta.mode = 'direct'" for n in ("email", "phone")],
    "select record_id, 'professionalSummary[' || (generate_subscripts(professionalSummary, 1) - 1) || ']', unnest(professionalSummary) from records_v",
    _each("qualifications", "qualifications", ["year", "name", "institution", "institutionAlias"]),
    _each("technicalSkills", "technicalSkills", ["group"]), _inner("technicalSkills", "technicalSkills", "items"),
    _each("experience", "experience", ["employer", "duration", "alias", "context", "reasonForLeaving"]),
    _inner("experience", "experience", "titles", ["title", "duration"]), _inner("experience", "experience", "responsibilities"), _inner("experience", "experience", "achievements"),
    _each("earlyCareer", "earlyCareer", ["title", "employer", "duration", "alias"]),
])


@query("flatten_fields", "select * from flat_v")
def _(t):
    return C.flatten_fields(t.records_v)


_NAME_TOKENS = """case {0} when 'Borealis Bank Group' then ['Borealis', 'Bank'] when 'Foschini (TFG) Ltd' then ['TFG', 'Foschini'] when 'Delta Mining' then ['Delta', 'Mining']
    when 'Anna Maria Steyn' then ['Anna', 'Maria', 'Steyn'] else cast([] as varchar[]) end"""


@query(
    "residual_identity_scan",
    rf"""with k as (select record_id, list_concat(list_concat(case when redact.employerNames then list_transform(list_concat(list_concat({_NAME_TOKENS.format('experience[1].employer')},
        {_NAME_TOKENS.format('experience[2].employer')}), ['Corner', 'Shop']), lambda x: x || '|employer name') else cast([] as varchar[]) end,
        case when redact.candidateName then list_transform({_NAME_TOKENS.format('personal.fullName')}, lambda x: x || '|candidate name') else cast([] as varchar[]) end),
        case when redact.institutions then ['Harbour|institution name'] else cast([] as varchar[]) end) as tokens from records_v),
    m as (select f.record_id, path, list_filter(tokens, lambda x: regexp_matches(value, '(?i)\b' || split_part(x, '|', 1) || '\b'))[1] as hit from flat_v f join k on k.record_id = f.record_id
      where path like 'professionalSummary%' or path = 'meta.targetRole' or regexp_matches(path, '^experience.*(context|reasonForLeaving|responsibilities\[\d\]|achievements\[\d\]|\.title)$'))
    select record_id, path, split_part(hit, '|', 1) as token, split_part(hit, '|', 2) as what from m where hit is not null""",
)
def _(t):
    return C.residual_identity_scan(t.records_v)


def incoming(t):
    """A second version of each record that agrees, adds and contradicts."""
    role = lambda employer, extra: F.struct(
        F.lit(employer).alias("employer"), F.lit("May 2000 – May 2001").alias("duration"), F.lit("").alias("alias"), F.lit("Context").alias("context"), F.lit("").alias("reasonForLeaving"),
        F.array(F.struct(F.lit("JUNIOR clerk").alias("title"), F.lit("").alias("duration")), F.struct(F.lit(extra).alias("title"), F.lit("").alias("duration"))).alias("titles"),
        F.array(F.lit("Kept books")).alias("responsibilities"), F.array(F.lit("Saved money")).alias("achievements"),
    )
    study = lambda name, year: F.struct(F.lit(year).alias("year"), F.lit(name).alias("name"), F.lit("Other").alias("institution"), F.lit("").alias("institutionAlias"))
    return t.records_v.withColumns({
        "personal": F.col("personal").withField("languages", F.lit("Zulu")).withField("fullName", F.lit("Someone Else")),
        "experience": F.array(role("delta", "Lead"), role("New Firm", "Boss")),
        "qualifications": F.array(study("DIPLOMA", "2015"), study("Masters", "2020")),
        "technicalSkills": F.array(F.struct(F.lit("").alias("group"), F.array(F.lit("SAS"), F.lit("Java"), F.lit("sql")).alias("items"))),
    })


_D1, _D2 = "experience[1].employer = 'Delta Mining'", "experience[2].employer = 'Delta Mining'"


@query(
    "merge_records",
    f"""select record_id, case when personal.fullName = '' then 'Someone Else' else personal.fullName end as name, case when personal.languages = '' then 'Zulu' else personal.languages end as languages,
      case when {_D1} or {_D2} then 3 else 4 end as roles, case when {_D1} or {_D2} then 7 else 8 end as titles,
      case when qualifications[2].year = '' and qualifications[2].name = 'Diploma' then '2015' else qualifications[2].year end as diploma_year,
      case when qualifications[2].name = 'Diploma' then 3 else 4 end as studies, concat_ws(';', case when personal.fullName = '' then 'filled fullName: Someone Else' end,
        case when personal.languages = '' then 'filled languages: Zulu' end, case when not ({_D1} or {_D2}) then 'added role: delta' end, 'added role: New Firm',
        case when qualifications[2].name <> 'Diploma' then 'added study: DIPLOMA' end, 'added study: Masters', 'added skills: ' || case when record_id % 2 = 0 then 2 else 1 end) as notes from records_v""",
)
def _(t):
    merged = C.merge_records(t.records_v, incoming(t))
    return merged.select(
        "record_id", F.col("personal.fullName").alias("name"), "personal.languages", F.size("experience").alias("roles"),
        F.aggregate("experience", F.lit(0), lambda n, r: n + F.size(r["titles"])).alias("titles"), F.col("qualifications")[1]["year"].alias("diploma_year"),
        F.size("qualifications").alias("studies"), F.array_join("notes", ";").alias("notes"),
    )


# ---- suggestions -------------------------------------------------------------------------------------

def suggestions(t):
    """Assistant turns as proposed edits of the user turn before them, in several states of repair."""
    pairs = turn_pairs(t)
    k = (F.col("conv_id") + F.col("turn")) % 6
    head = F.array_join(F.slice(F.split("source", r"\s+"), 1, 4), " ")
    proposal = F.when(k < 3, head).when(k == 3, F.concat(F.lit("Managed "), head)).otherwise(F.col("proposal"))
    return pairs.select(
        F.col("conv_id").alias("record_id"), F.col("turn").alias("position"), F.when(k == 2, "same").otherwise(F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("id"),
        F.when(k == 4, "personal.email").when(F.col("turn") % 8 == 3, "meta.targetRole").otherwise(F.concat(F.lit("careerSummary["), F.col("turn").cast("string"), F.lit("]"))).alias("field"),
        F.lit("agency").alias("mode"), F.when(F.col("turn") % 4 == 1, "formatting").otherwise("placement").alias("kind"),
        F.when(k == 5, "no such quote anywhere").otherwise(F.upper(F.split_part("source", F.lit(" "), F.lit(1)))).alias("quote"), proposal.alias("proposal"),
        F.when(k == 1, F.lit("see DOC-17")).otherwise("").alias("current"), "source",
    )


_WORDS = r"regexp_extract_all(lower(trim(regexp_replace(translate({}, '‒–—', '---'), '\s+', ' ', 'g'))), '[a-zà-ɏ][a-zà-ɏ0-9''’]*')"
_FOLD = r"lower(trim(regexp_replace(translate({}, '‒–—', '---'), '\s+', ' ', 'g')))"


@query(
    "suggestion_check",
    rf"""with {PAIRS}, s as (select conv_id as record_id, turn as position, (conv_id + turn) % 6 as k, source, array_to_string(list_slice(regexp_split_to_array(source, '\s+'), 1, 4), ' ') as head, proposal from pairs),
    p as (select *, case when k < 3 then head when k = 3 then 'Managed ' || head else proposal end as text, case when k = 2 then 'same' else 's' || position end as id,
      case when k = 4 then 'personal.email' when position % 8 = 3 then 'meta.targetRole' else 'careerSummary[' || position || ']' end as field, case when k = 1 then 'see DOC-17' else '' end as current,
      case when k = 5 then 'no such quote anywhere' else upper(split_part(source, ' ', 1)) end as quote from s),
    w as (select *, list_filter({_WORDS.format('text')}, lambda x: length(x) > 2 and not list_contains({_WORDS.format('source || chr(10) || current')}, x) and x not in ('and','for','from','into','the','with')
      and not (position % 4 = 1 and x = 'managed')) as added from p),
    v as (select *, case when trim(text) = '' or trim(quote) = '' then 'fields missing' when length(trim(text)) > 500 or contains(trim(text), chr(10)) then 'too long or multiline' when k = 4 then 'field not allowed'
      when not contains({_FOLD.format('source')}, {_FOLD.format('quote')}) then 'quote not found' when k = 1 and not (contains(lower(text), 'doc') and contains(lower(text), '17')) then 'protected token changed'
      when len(added) > 0 then 'new wording' else 'ok' end as verdict from w),
    e as (select *, coalesce(sum(cast(verdict = 'ok' as int)) over (partition by record_id, id order by position rows between unbounded preceding and 1 preceding), 0) as i,
      coalesce(sum(cast(verdict = 'ok' as int)) over (partition by record_id, field order by position rows between unbounded preceding and 1 preceding), 0) as f from v)
    select record_id, position, case when verdict <> 'fields missing' and i > 0 then 'repeated id' when verdict <> 'fields missing' and f > 0 then 'repeated field' else verdict end as verdict from e""",
)
def _(t):
    return G.suggestion_check(suggestions(t)).select("record_id", "position", "verdict")
