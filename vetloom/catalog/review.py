"""Repair of extraction damage, and line structure of briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.registry import SQL_VIEWS, query
from vetloom.functions import patterns as R
from vetloom.operators import review as V
from vetloom.plans.spread import spread

SQL_VIEWS["reviewed_v"] = "select doc_id, text from damaged_v union all select doc_id + 1000000000, text from documents"
LEGACY = ("desk@old.example.com", "desk@new.example.com")


def q(pattern: str) -> str:
    return pattern.replace("'", "''")


def reviewed(t):
    return t.damaged_v.unionByName(spread(t.documents).select((F.col("doc_id") + 1000000000).alias("doc_id"), "text"))


def sql_cut(text: str, pattern: str) -> str:
    return rf"string_split(regexp_replace(replace({text}, chr(1), ''), '{q(pattern)}', chr(1) || '\0' || chr(1), 'g'), chr(1))"


def sql_each(text: str, pattern: str, change: str) -> str:
    """``change`` is an expression over the match ``p``."""
    return f"array_to_string(list_transform({sql_cut(text, pattern)}, lambda p, i: case when i % 2 = 0 then {change} else p end), '')"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_PAIRS = r"(?i)\b(?:" + "|".join(r"[ \t]*-[ \t]*".join(p.split("-")) for p in R.HYPHEN_PAIRS) + r")\b"
_LAST = "list_last(string_split(acc, chr(10)))"


def bare(line: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(trim({line}, ' ' || chr(9)), '\s*[:-]?\s*$', ''), '\s+', ' ', 'g'))"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_OPEN = rf"{_LAST} <> '' and not regexp_matches({_LAST}, '[.!?;:]$') and not regexp_matches({_LAST}, '{q(R.NUMBERED_ITEM)}') and not list_contains({sql_list(R.BRIEF_HEADINGS)}, {bare(_LAST)})"
_STATE = "{'keep': cast([] as varchar[]), 'last': '', 'apply': false}"
_IS_APPLY = f"regexp_matches(l, '{q(R.APPLY_LINE)}')"
_DROP = f"(l <> '' and (lower(l) = s.last or ({_IS_APPLY} and s.apply and length(l) < 200)))"

STEPS = {
    "clean_characters": r"regexp_replace(translate(regexp_replace({0}, chr(13) || chr(10) || '?', chr(10), 'g'), chr(160), ' '), '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g')",
    "join_hyphen_compounds": sql_each("{0}", _PAIRS.replace("{", "{{").replace("}", "}}"), r"regexp_replace(p, '[ \t]*-[ \t]*', '-')"),
    "collapse_spaces": "regexp_replace({0}, ' {{2,}}', ' ', 'g')",
    "fix_punctuation_space": r"regexp_replace({0}, '(\S)[ \t]{{1,3}}([,.!?;:])', '\1\2', 'g')",
    "normalise_bullets": rf"""array_to_string(list_transform(list_transform(string_split({{0}}, chr(10)), lambda r: {_TRIM.format('r')}), lambda l: case when not
        regexp_matches(l, '{R.BULLET_RUN}') then l when regexp_replace(regexp_replace(l, '{R.BULLET_RUN}', ''), '^[-–—][ \t]+', '') = '' then ''
        else '• ' || regexp_replace(regexp_replace(l, '{R.BULLET_RUN}', ''), '^[-–—][ \t]+', '') end), chr(10))""",
    "reflow_lines": rf"""array_to_string(list_transform(string_split(regexp_replace(replace({{0}}, chr(2), ''), '\n([a-z])', chr(2) || '\1', 'g'), chr(10)),
        lambda piece: list_reduce(string_split(piece, chr(2)), lambda acc, l: acc || case when {_OPEN.replace('{', '{{').replace('}', '}}')} then case when acc like '%-' then '' else ' ' end else chr(10) end || l)), chr(10))""",
    "limit_blank_lines": r"regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g')",
    "drop_repeated_lines": rf"""regexp_replace(array_to_string((list_reduce(list_transform(string_split({{0}}, chr(10)), lambda r: {_TRIM.format('r')}), lambda s, l: {{{{
        'keep': case when {_DROP} then s.keep else list_append(s.keep, l) end, 'last': case when l = '' or {_DROP} then s.last else lower(l) end,
        'apply': case when l = '' then false when {_DROP} then s.apply else {_IS_APPLY} end}}}}, {_STATE.replace('{', '{{').replace('}', '}}')})).keep, chr(10)), '\n{{{{3,}}}}', chr(10) || chr(10), 'g')""",
    "replace_legacy_address": r"regexp_replace({0}, '(?i)desk@old\.example\.com', 'desk@new.example.com', 'g')",
}

_SPARK = {
    "clean_characters": V.clean_characters, "join_hyphen_compounds": V.join_hyphen_compounds, "collapse_spaces": V.collapse_spaces,
    "fix_punctuation_space": V.fix_punctuation_space, "normalise_bullets": V.normalise_bullets, "reflow_lines": V.reflow_lines,
    "limit_blank_lines": V.limit_blank_lines, "drop_repeated_lines": V.drop_repeated_lines,
    "replace_legacy_address": lambda c: V.replace_legacy_address(c, *LEGACY),
}


def _register(name: str) -> None:
    @query(name, f"select doc_id, {STEPS[name].format('text')} as text from reviewed_v")
    def _(t):
        return reviewed(t).select("doc_id", _SPARK[name](F.col("text")).alias("text"))


for _name in STEPS:
    _register(_name)


def review_ctes(source: str, passes: int = 3) -> tuple[str, str]:
    """CTE chain of the review over ``source`` (other columns kept) and the name of its last CTE."""
    ctes, last, n = [], source, 0
    for _ in range(passes):
        for step in STEPS.values():
            n += 1
            ctes.append(f"rv{n} as materialized (select * replace ({step.format('text')} as text) from {last})")
            last = f"rv{n}"
    ctes.append(f"rv as (select * replace ({_TRIM.format('text')} as text) from {last})")
    return ",\n".join(ctes), "rv"


@query("review_text", f"with {review_ctes('reviewed_v')[0]} select doc_id, text from rv")
def _(t):
    return V.review_text(reviewed(t), "text", legacy=LEGACY).select("doc_id", "text")


_LINES = r"""lines as (select doc_id, generate_subscripts(ls, 1) as n, unnest(ls) as line from (select doc_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda r: regexp_replace(r, '^\s+|\s+$', '', 'g')), lambda l: l <> '') as ls from {}) x)"""
_TITLE = "case " + " ".join(f"when list_contains({sql_list(h)}, {bare('line')}) then '{n}'" for n, h in R.BRIEF_SECTIONS.items()) + " end"


@query(
    "structure_brief",
    f"""with {_LINES.format('damaged_v')}, h as (select *, {_TITLE} as title from lines),
    s as (select *, sum(cast(title is not null as int)) over w as part, last_value(title ignore nulls) over w as section from h window w as (partition by doc_id order by n)),
    g as (select doc_id, part, coalesce(any_value(section), 'Overview') as title, string_agg(line, chr(10) order by n) as body from s where title is null group by 1, 2)
    select doc_id, row_number() over (partition by doc_id order by part) - 1 as section_no, title, body from g""",
)
def _(t):
    return V.structure_brief(t.damaged_v, "doc_id", "text").select("doc_id", "section_no", "title", F.array_join("lines", "\n").alias("body"))


_DUTY = "|".join(R.DUTY_WORDS)
_REQ = "|".join(R.REQUIREMENT_WORDS)


@query(
    "bucket_lines",
    f"""with plain as (select doc_id, 'Vacancy' || chr(10) || replace(replace(text, chr(10) || 'Requirements', chr(10) || 'Requirements are:'), chr(10), chr(10) || ' ') || chr(10) || 'Your duties' || chr(10) || 'One more line' as text from briefs_v),
    {_LINES.format('plain')}, ok as (select doc_id from lines group by 1 having count(*) > 10 and not bool_or(({_TITLE}) is not null)),
    k as (select *, case when length(line) < 80 and regexp_matches(lower(line), '{_DUTY}') then 'responsibilities' when length(line) < 80 and regexp_matches(lower(line), '{_REQ}') then 'requirements' end as sw
      from lines where n > 1 and doc_id in (select doc_id from ok))
    select doc_id, coalesce(last_value(sw ignore nulls) over (partition by doc_id order by n), 'responsibilities') as bucket, line from k qualify sw is null""",
)
def _(t):
    text = F.regexp_replace(F.regexp_replace("text", "\nRequirements", "\nRequirements are:"), "\n", "\n ")
    plain = t.briefs_v.withColumn("text", F.concat(F.lit("Vacancy\n"), text, F.lit("\nYour duties\nOne more line")))
    return V.bucket_lines(plain, "doc_id", "text")
