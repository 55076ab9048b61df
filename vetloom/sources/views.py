"""Input views derived from the star-schema tables.

``SHARED_SQL`` holds the projections both engines read the same way; table names stand in
braces. ``BUILDERS`` holds views that need a Spark plan of their own. Fixed clocks:
1998-07-01 for orders, 2024-01-15 for events.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.plans import scans
from vetloom.plans.spread import spread

NOW_ORDERS = "1998-07-01 00:00:00"
NOW_EVENTS = "2024-01-15 00:00:00"

SHARED_SQL: dict[str, str] = {
    "attempts_v": """
        select o_orderkey as attempt_id, o_custkey as candidate_id,
          cast(substr(o_orderpriority, 1, 1) as int) as definition_id, o_orderdate as started_at,
          o_orderdate + interval '1' day * cast(o_orderkey % 60 + 1 as int) as expires_at,
          case o_orderstatus when 'F' then 'completed' when 'P' then 'timed_out' else 'active' end as status,
          case when o_orderstatus <> 'O' then o_orderdate + interval '1' day * cast(o_orderkey % 90 as int) end as closed_at
        from {orders}""",
    "line_v": """
        select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey,
          l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as int) as row_no
        from {lineitem}""",
    "answers_v": """
        select l_orderkey as attempt_id, l_linenumber as item_id, l_returnflag as single,
          l_returnflag as multi_1, l_linestatus as multi_2,
          case l_partkey % 4 when 0 then cast(cast(l_quantity as int) as string)
            when 1 then 'R ' || cast(cast(l_quantity as int) as string)
            when 2 then cast(cast(l_quantity as int) as string) || ',00'
            else '(' || cast(cast(l_quantity as int) as string) || ')' end as cell,
          lower(l_returnflag) || case when l_partkey % 2 = 0 then '' else ' ' end || l_linestatus as typed,
          'grn' || case l_partkey % 3 when 0 then '-' when 1 then ' ' else '' end
            || cast(l_partkey % 20 as string) as code,
          l_returnflag as line_1, l_linestatus as line_2
        from {saved_v}""",
    "statement_v": """
        select o_orderkey as ref, o_totalprice as amount from {orders} where o_orderpriority <> '5-LOW'""",
    "ledger_v": """
        select o_orderkey as ref, o_totalprice + case when o_orderpriority = '1-URGENT' then 10 else 0 end as amount
        from {orders} where o_orderstatus <> 'P'
        union all
        select o_orderkey as ref, o_totalprice as amount from {orders}
        where o_orderstatus = 'F' and o_orderpriority = '3-MEDIUM'""",
    "amounts_v": """
        select l_orderkey, l_linenumber, l_extendedprice as truth,
          case (l_orderkey + l_linenumber) % 10
            when 0 then plain when 1 then 'R ' || plain when 2 then plain || ' rand'
            when 3 then replace(grouped, ',', ' ') when 4 then grouped
            when 5 then replace(replace(replace(grouped, ',', '~'), '.', ','), '~', '.')
            when 6 then '(' || plain || ')' when 7 then '-' || plain
            when 8 then substr(plain, 1, length(plain) - 3) || ',-' else 'about ' || plain end as amount_text
        from (select *, {MONEY} as grouped, replace({MONEY}, ',', '') as plain from {lineitem}) x""",
    "notes_v": """
        select o_orderkey as note_id, case o_orderkey % 8
            when 0 then 'We will hold the refund' when 1 then 'Do not hold the refund'
            when 2 then 'Not only hold the refund, also tell finance' when 3 then 'The household account is fine'
            when 4 then 'Hold it and release the refund today' when 5 then 'Hold it; never release the refund'
            when 6 then 'Nothing is missing, hold the refund' else '  ' end
          || case when o_orderkey % 8 < 7 and o_orderstatus = 'F' then ' DOC-' || cast(o_orderkey % 50 as string)
             else '' end as note
        from {orders}""",
    "customer_v": """
        select c_custkey as candidate_id, '  ' || split_part(c_name, '#', 1) || ' ' as first_name,
          case when c_custkey % 10 = 3 then 'X' else 'No.' || split_part(c_name, '#', 2) end as surname,
          case c_custkey % 9 when 0 then 'no-at-sign' when 1 then 'a b@x.com'
            else ' User' || cast(c_custkey as string) || '@Mail.com ' end as email,
          case c_custkey % 5 when 0 then '082 ' || lpad(cast(c_custkey % 1000 as string), 3, '0') || ' 4567'
            when 1 then '+27 82 ' || lpad(cast(c_custkey % 1000 as string), 3, '0') || ' 4567'
            when 2 then '(083) ' || lpad(cast(c_custkey % 1000 as string), 3, '0') || '-1234'
            when 3 then '12345' else 'call me' end as phone,
          lpad(cast(c_custkey % 100 as string), 2, '0') || lpad(cast(c_custkey % 13 as string), 2, '0')
            || lpad(cast(c_custkey % 31 as string), 2, '0') || lpad(cast(c_custkey % 10000 as string), 4, '0')
            || cast(c_custkey % 3 as string) || '8' || cast(cast(floor(c_acctbal) as bigint) % 5 + 4 as string) as id_number,
          date '1998-07-01' + interval '1' day * cast(c_custkey % 120 as int) as start_at,
          c_custkey % 4 <> 0 as consent, c_custkey % 6 <> 0 as day_confirmed,
          case c_custkey % 5 when 0 then 'own_vehicle' when 1 then 'lift' when 2 then 'public_transport'
            when 3 then 'other' else 'teleport' end as travel_mode,
          case when c_custkey % 2 = 0 then 'Bus 12' else ' ' end as travel_note,
          case when c_custkey % 7 = 0 then 'maybe' else 'yes' end as own_transport,
          case c_custkey % 3 when 0 then 'no' else 'yes' end as available
        from {customer}""",
    "names_v": """
        select initcap_name as name, min(descriptor) as descriptor from (
          select upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
            || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as initcap_name,
            'Leading ' || lower(p_type) || ' manufacturer' as descriptor from {part}) x
        group by initcap_name""",
    "briefs_v": """
        select c_custkey as doc_id, concat_ws(chr(10),
          'Role: ' || lower(c_mktsegment) || ' clerk ' || n_name,
          case when c_custkey % 3 = 0 then 'Client: Borealis ' || p_name2 || ' Works' end,
          case when c_custkey % 2 = 0 then 'Join ' || p_name2 || ' Holdings Ltd as part of a growing team' end,
          case when c_custkey % 4 = 1 then 'Zorvex Foods (Pty) Ltd is hiring in the retail store network' end,
          case when c_custkey % 5 = 1 then 'Mail: jobs@agency.example.com'
               when c_custkey % 5 <> 0 then 'Mail: Hr' || cast(c_custkey as string) || '@corp.co.za or hr'
                 || cast(c_custkey as string) || '@CORP.co.za' end,
          case when c_custkey % 3 <> 1 then 'Call 082 123 ' || lpad(cast(c_custkey % 10000 as string), 4, '0')
                 || ' or +44 20 7946 0958 soon' end,
          case when c_custkey % 4 = 0 then 'Apply here: https://jobs.corp.com/apply/' || cast(c_custkey as string) end,
          case when c_custkey % 4 = 2 then 'Apply online today please' end,
          case when c_custkey % 2 = 1 then 'Visit https://www.site' || cast(c_custkey as string) || '.com/about us' end,
          case when c_custkey % 6 = 0 then 'See the website widgetco.co.za for details' end,
          case when c_custkey % 3 = 2 then 'Hiring Manager: John Smith, head office' end,
          case when c_custkey % 10 = 3 then 'Contact Person: Mary Jones' end,
          case when c_custkey % 5 = 2 then 'Ref: ABC-' || cast(c_custkey + 1000 as string) || ' and reference only' end,
          case when c_custkey % 7 = 0 then '12 Long Street, Harbour City 8001' end,
          case when c_custkey % 6 = 3 then 'VAT No: 4123456789 and 2010/123456/07' end,
          case when c_custkey % 8 = 0 then 'ID No: 8001015009087' when c_custkey % 8 = 1 then 'Number 8001015009087' end,
          case when c_custkey % 9 = 4 then 'Working with Acme Union Corp and Delta River Group' end,
          case when c_custkey % 4 = 3 then chr(10) || 'Internal notes:' || chr(10) || 'Budget is 500k, do not mention it'
                 || chr(10) || chr(10) || 'Requirements' || chr(10) || 'Two years of ledger work' end,
          case when c_custkey % 11 = 5 then 'Placed by North  Star staffing' end) as text
        from {customer} join {nation} on c_nationkey = n_nationkey
        join (select p_partkey, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
            || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) as p_name2
          from {part}) p on p_partkey = c_custkey""",
    "damaged_v": """
        select c_custkey as doc_id, concat_ws(chr(10),
          'About the role' || chr(13),
          'Full -  time post with good ben efits , and long - term growth !',
          'The m anager  leads a' || chr(10) || 'small team in ' || n_name || chr(10) || 'and re ports to the board',
          case when c_custkey % 2 = 0 then '\u2022' || '   plan the work' || chr(10) || '\u2022' || ' - check the work' end,
          case when c_custkey % 3 = 0 then 'Apply now' || chr(10) || 'Send your CV to us' || chr(10) || '' || chr(10) || 'Apply now' end,
          case when c_custkey % 4 = 0 then 'Same line' || chr(10) || '' || chr(10) || 'same LINE' end,
          'Requirements' || chr(10) || 'two years of ' || lower(c_mktsegment) || '\u200b' || ' work with e-' || chr(10) || 'commerce',
          '', '', '',
          case when c_custkey % 5 = 0 then '1. numbered' || chr(10) || 'stays apart' end,
          'Questions: Desk@Old.Example.com' || '\u00a0' || 'please', '\u2022',
          case when c_custkey % 3 = 1 then 'Duties' || chr(10) || 'You will keep the books' || chr(10) || 'Skills and experience'
            || chr(10) || 'Ledger' || chr(10) || 'What we offer:' || chr(10) || 'Tea' end) as text
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "cvs_v": """
        select c_custkey as doc_id, concat_ws(chr(10),
          upper(c_name), 'Full name: Candidate ' || cast(c_custkey as string),
          case when c_custkey % 2 = 0 then 'Nationality' || chr(9) || n_name else 'Nationality' || chr(10) || n_name end,
          'E-mail address: c' || cast(c_custkey as string) || '@mail.org',
          'Cell number: 082 555 ' || lpad(cast(c_custkey % 10000 as string), 4, '0'),
          'Own transport: ' || case c_custkey % 4 when 0 then 'y' when 1 then 'No' when 2 then 'TRUE' else 'sometimes' end,
          'Date of birth: ' || case when c_custkey % 2 = 0 then '7/03/85' else '1985-03-07' end,
          '', case c_custkey % 3 when 0 then 'PROFESSIONAL SUMMARY' when 1 then '1. Profile:' else '# About me' end,
          'Careful ' || lower(c_mktsegment) || ' person', '',
          case c_custkey % 3 when 0 then 'Work Experience' when 1 then '2. Employment History:' else '# experience and history' end,
          'North Bank Ltd', 'Senior Clerk',
          case c_custkey % 5 when 0 then 'Jan 2015 - Mar 2018' when 1 then '01/2015 to 03/2018'
            when 2 then 'January 2015 ' || '\u2013' || ' present' when 3 then '2015 - 2018'
            else 'Sept 2015 until Dec 2017 (2 yrs 3 mos)' end,
          '- kept the books', '- checked invoices', 'Key Achievements:', '- saved money',
          'Reason for leaving: growth', 'South Shop', 'Clerk 2012-05 - 2014-11', 'Responsibilities', '- filed papers', '',
          'Education', 'Certificate in accounts, 2009', 'School leaving 2005 to 2006',
          'Technical Skills', 'Tools: SQL, Excel; sql|ledger work', 'Typing, typing, R', 'References', 'On request') as text
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "saves_v": """
        select user_id as attempt_id, event_id as save_id, ts as arrival, event_type,
          (rn - 1) - cast(floor(rn / 5.0) as bigint) + case when user_id % 10 = 0 and rn >= 25 then 1 else 0 end
            as expected_revision,
          timestamp '2024-01-25 00:00:00' as expires_at
        from {numbered_events}""",
    "spans_v": """
        select o_custkey as person_id, o_orderkey as span_id,
          cast(extract(year from o_orderdate) as int) * 12 + cast(extract(month from o_orderdate) as int) - 1 as from_month,
          case when o_orderstatus = 'O' then null else cast(extract(year from o_orderdate) as int) * 12
            + cast(extract(month from o_orderdate) as int) - 1 + cast(o_orderkey % 30 as int) end as to_month
        from {orders}""",
}

# The five cells of a line; a line's number within its order is its row.
_CELLS = {
    "A": "'P' || cast(l_partkey % 50 as string)",
    "B": "cast(cast(l_quantity as int) as string)",
    "C": "l_returnflag",
    "D": """case when l_partkey % 97 = 0 then '#N/A' when l_partkey % 4 = 0 then '' when l_partkey % 4 = 1 then 'note'
        when l_partkey % 4 = 2 then 'TRUE' else cast(cast(l_tax * 100 as int) as string) end""",
    "E": """'=$E$' || cast(case when l_orderkey % 20 = 0 then greatest(1, 8 - row_no) else row_no + 1 end as string)
        || '+SUM(B1:B3)*Data!a' || cast(row_no as string) || '+A41+RATE1*LOG10(C2)+"D4"'""",
}
# The write that counts, of several for one item: the last one, by all columns.
_WRITE = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
# The table that carries the rows of views on whose rows long expressions run.
HEAVY = {"amounts_v": ("lineitem",), "briefs_v": ("customer",), "cvs_v": ("customer",), "damaged_v": ("customer",), "notes_v": ("orders",)}
_MONEY = {"spark": "format_number(l_extendedprice, 2)", "duckdb": "format('{{:,.2f}}', l_extendedprice)"}
_NAME = re.compile(r"\{(\w+)\}")


def from_sql(tables, text: str, heavy: tuple[str, ...] = ()) -> DataFrame:
    """Run a shared projection with DataFrames bound to the bracketed names; ``heavy`` ones are spread over all cores."""
    text = text.replace("{MONEY}", _MONEY["spark"])
    frames = {name: spread(getattr(tables, name)) if name in heavy else getattr(tables, name) for name in set(_NAME.findall(text))}
    return tables.spark.sql(text, **frames)


def duckdb_text(text: str) -> str:
    """The same projection for the oracle, reading names directly."""
    return _NAME.sub(r"\1", text.replace("{MONEY}", _MONEY["duckdb"].replace("{{", "<").replace("}}", ">"))).replace(
        "<:,.2f>", "{:,.2f}"
    )


def numbered_events(t) -> DataFrame:
    return scans.number_rows(t.events, ["user_id"], ["ts", "event_id"], scans.day_chunk("ts"))


def items_v(t) -> DataFrame:
    """Authored items of every definition: seven item types, two sections, two categories."""
    rows = t.spark.sql("""
        select * from values
          (1, 'single', 'a', 'knowledge', 'foundation', 2), (2, 'single', 'a', 'knowledge', 'core', 2),
          (3, 'multi', 'a', 'knowledge', 'stretch', 3), (4, 'cell', 'b', 'reconciliation', 'foundation', 3),
          (5, 'text', 'b', 'reconciliation', 'core', 2), (6, 'ref', 'b', 'reconciliation', 'stretch', 2),
          (7, 'match', 'b', 'reconciliation', 'core', 2)
          as item(item_id, type, section, category, level, points)""")
    return rows.select(
        F.explode(F.sequence(F.lit(1), F.lit(5))).alias("definition_id"),
        "*",
    ).withColumn("prompt", F.concat(F.lit("Question "), F.col("item_id")))


def key_v(t) -> DataFrame:
    """Answer keys, one row per item; columns unused by a type stay null."""
    return t.spark.sql("""
        select item_id, answer, answer_set, answer_number, tolerance, unsafe,
          from_json(lines, 'map<string,string>') as answer_lines,
          from_json(alternatives, 'array<map<string,string>>') as alternatives
        from values
          (1, 'N', null, null, null, array('R'), null, null),
          (2, 'A', null, null, null, null, null, null),
          (3, null, array('N', 'O'), null, null, array('R'), null, null),
          (4, null, null, 25D, 1D, null, null, null),
          (5, 'no', null, null, null, null, null, null),
          (6, 'GRN-7', null, null, null, null, null, null),
          (7, null, null, null, null, null, '{"l1":"N","l2":"O"}', '[{"l1":"A"}]')
          as k(item_id, answer, answer_set, answer_number, tolerance, unsafe, lines, alternatives)""")


def responses_v(t) -> DataFrame:
    """One saved response per (attempt, item) in typed columns."""
    return t.answers_v.select(
        "attempt_id",
        "item_id",
        "single",
        F.array("multi_1", "multi_2").alias("multi"),
        "cell",
        "typed",
        "code",
        F.create_map(F.lit("l1"), F.col("line_1"), F.lit("l2"), F.col("line_2")).alias("lines"),
    )


def saved_v(t) -> DataFrame:
    """The last write of every item of an attempt."""
    last = spread(t.lineitem).groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(*_WRITE)).alias("w"))
    return last.select("l_orderkey", "l_linenumber", "w.l_returnflag", "w.l_linestatus", "w.l_partkey", "w.l_quantity")


def wide_v(t) -> DataFrame:
    """Every line as one row of five cells ``a`` to ``e``."""
    cells = ", ".join(f"{text} as {col.lower()}" for col, text in _CELLS.items())
    return t.spark.sql(f"select l_orderkey as workbook_id, row_no, {cells} from {{line_v}}", line_v=t.line_v)


def cells_v(t) -> DataFrame:
    """The cells of every line as rows, from one scan."""
    cells = F.array(*[F.struct(F.lit(col).alias("col"), F.col(col.lower()).alias("text")) for col in _CELLS])
    return t.wide_v.select("workbook_id", F.lit("Data").alias("sheet"), "row_no", F.inline(cells))


BUILDERS = {
    "saved_v": saved_v,
    "wide_v": wide_v,
    "cells_v": cells_v,
    "numbered_events": numbered_events,
    "items_v": items_v,
    "key_v": key_v,
    "responses_v": responses_v,
}

# The same builder views as the oracle reads them.
DUCKDB_ONLY: dict[str, str] = {
    "saved_v": "select l_orderkey, l_linenumber, "
    + ", ".join(f"max_by({c}, ({', '.join(_WRITE)})) as {c}" for c in ("l_returnflag", "l_linestatus", "l_partkey", "l_quantity"))
    + " from lineitem group by l_orderkey, l_linenumber",
    "wide_v": "select l_orderkey as workbook_id, row_no, " + ", ".join(f"{text} as {col.lower()}" for col, text in _CELLS.items()) + " from line_v",
    "cells_v": """
        select workbook_id, 'Data' as sheet, row_no, unnest(['A', 'B', 'C', 'D', 'E']) as col, unnest([a, b, c, d, e]) as text from wide_v""",
    "numbered_events": "select *, row_number() over (partition by user_id order by ts, event_id) as rn from events",
    "items_v": """
        select d as definition_id, i.*, 'Question ' || item_id as prompt from (values
          (1, 'single', 'a', 'knowledge', 'foundation', 2), (2, 'single', 'a', 'knowledge', 'core', 2),
          (3, 'multi', 'a', 'knowledge', 'stretch', 3), (4, 'cell', 'b', 'reconciliation', 'foundation', 3),
          (5, 'text', 'b', 'reconciliation', 'core', 2), (6, 'ref', 'b', 'reconciliation', 'stretch', 2),
          (7, 'match', 'b', 'reconciliation', 'core', 2)) i(item_id, type, section, category, level, points),
          range(1, 6) r(d)""",
}


def records_v(t) -> DataFrame:
    from vetloom.sources import records

    return t.spark.sql(records.spark_sql(), customer=spread(t.customer), nation=t.nation)


BUILDERS["records_v"] = records_v
