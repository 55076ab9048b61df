"""Check-SQL fragments used by several queries. Written for the checker, apart from the Spark code."""

from __future__ import annotations

WORDS = (
    "['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen',"
    "'fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty']"
)


def amount_ctes(source: str, column: str, prefix: str = "am") -> str:
    """CTEs ending in ``{prefix}``: every column of ``source`` plus ``amount``."""
    return rf"""
    {prefix}0 as (select *, lower(regexp_replace({column}, '^\s+|\s+$', '', 'g')) as t0 from {source}),
    {prefix}1 as (select *, regexp_matches(t0, '^\(.*\)$') as br,
        case when regexp_matches(t0, '^\(.*\)$') then trim(substr(t0, 2, length(t0) - 2)) else t0 end as t1 from {prefix}0),
    {prefix}2 as (select *, regexp_extract(t1, '^((?:(?:-\s*)?(?:(?:zar|rands?|r)\s*)?){{0,3}})', 1) as head from {prefix}1),
    {prefix}3 as (select *, regexp_replace(trim(regexp_replace(substr(t1, length(head) + 1),
        '(?:\s*(?:zar|rands?|r)){{0,3}}$', '')), '[.,]-$', '') as t2 from {prefix}2),
    {prefix}4 as (select *, cast(br as int) + length(regexp_replace(head, '[^-]', '', 'g')) + cast(t2 like '%-' as int) as minus,
        regexp_replace(regexp_replace(regexp_replace(t2, '-$', ''), '[\s'']', '', 'g'), '[.,]$', '') as s from {prefix}3),
    {prefix}5 as (select *, try_cast(case when regexp_matches(s, '^\d+$') then s
        when regexp_matches(s, '^\d{{1,3}}(,\d{{3}})+\.\d+$') then replace(s, ',', '')
        when regexp_matches(s, '^\d{{1,3}}(\.\d{{3}})+,\d+$') then replace(replace(s, '.', ''), ',', '.')
        when regexp_matches(s, '^\d{{1,3}}((\.\d{{3}})+|(,\d{{3}})+)$') then regexp_replace(s, '[.,]', '', 'g')
        when regexp_matches(s, '^(\d+[.,]\d*|[.,]\d+)$') then '0' || replace(s, ',', '.') || '0' end as double) as v
        from {prefix}4),
    {prefix} as (select * exclude (t0, br, t1, head, t2, s, minus, v), case
        when list_contains({WORDS}, regexp_replace(t0, '[.!]$', '')) then list_position({WORDS}, regexp_replace(t0, '[.!]$', '')) - 1.0
        when minus = 0 then v when minus = 1 then -v end as amount from {prefix}5)"""


def number_text(expr: str) -> str:
    return f"case when {expr} = floor({expr}) and abs({expr}) < 1e15 then cast(cast({expr} as bigint) as varchar) else cast({expr} as varchar) end"


def cell_ctes(source: str, column: str, name: str, tag: str) -> str:
    """CTE ``name``: source columns plus ``{tag}kind``, ``{tag}num``, ``{tag}txt`` of the cell text."""
    cleaned = f"trim(replace(coalesce({column}, ''), ',', ''))"
    numeric = rf"regexp_matches({cleaned}, '^-?\d+(\.\d+)?$')"
    return f"""
    {name}_0 as (select *, case when coalesce({column}, '') = '' then 'blank' when {column} like '#%' then 'error'
        when {numeric} then 'number' when upper({column}) in ('TRUE', 'FALSE') then 'boolean' else 'text' end as {tag}kind
      from {source}),
    {name} as (select *, case {tag}kind when 'number' then cast({cleaned} as double)
        when 'boolean' then case when upper({column}) = 'TRUE' then 1.0 else 0.0 end end as {tag}num,
        case {tag}kind when 'blank' then '' when 'boolean' then upper({column}) when 'number' then
          {number_text(f"try_cast({cleaned} as double)")} else {column} end as {tag}txt from {name}_0)"""


MONTH_LIST = (
    "['January','February','March','April','May','June','July','August','September','October','November','December']"
)
SHORT_MONTHS = "['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']"


def tenure_case(months: str) -> str:
    return (
        f"case when {months} is null then null when {months} < 12 then 'Under 1 year' when {months} < 24 then '1 – 2 years' "
        f"when {months} < 48 then '2 – 4 years' when {months} < 84 then '4 – 7 years' when {months} < 120 then '7 – 10 years' "
        "else '10+ years' end"
    )
