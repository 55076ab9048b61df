"""Sources, projections and the workbook operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from vetloom.catalog.registry import query
from vetloom.catalog.sqltext import cell_ctes
from vetloom.operators import projections as P
from vetloom.operators import workbook as W
from vetloom.plans import scans
from vetloom.sources.tables import SCHEMAS, read_tables


@query("read_tables", " union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in SCHEMAS))
def _(t):
    frames = read_tables(t.spark, t.directory)
    return reduce(
        lambda a, b: a.unionByName(b), [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in frames.items()]
    )


@query(
    "readable_text",
    r"""select doc_id from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 20
    and length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) > 0.35""",
)
def _(t):
    return P.readable_text(t.documents, "text").select("doc_id")


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({}, chr(160), ' '),
    chr(13) || chr(10) || '?', chr(10), 'g'), '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '[ \t]+\n', chr(10), 'g'),
    '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query("normalise_text", f"select doc_id, {_CLEAN.format('text')} as text from (select * from damaged_v union all select doc_id + 1000000000, text from documents) x")
def _(t):
    both = t.damaged_v.unionByName(t.documents.select((F.col("doc_id") + 1000000000).alias("doc_id"), "text"))
    return P.normalise_text(both, "text").select("doc_id", "text")


_STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)<(?:li)(?:\s[^>]*)?>', chr(10) || '• ', 'g'),
    '(?i)</?(?:p|div|h1|h2|h3|h4|tr|ul|ol|title|br)(?:\s[^>]*)?/?>', chr(10), 'g'), '(?i)</(?:td|th)>', chr(9), 'g'), '<[^>]*>', '', 'g')"""
_DECODED = f"""replace(replace(replace(replace(replace({_STRIPPED}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')"""


@query("markup_to_text", f"select page_id, {_CLEAN.format(_DECODED)} as text from pages")
def _(t):
    return P.markup_to_text(t.pages, "html").select("page_id", F.col("html").alias("text"))


@query(
    "cells_to_lines",
    """select workbook_id, 0 as row_no, '--- Sheet: Data ---' as line from cells_v where trim(text) <> '' group by 1
    union all select workbook_id, row_no, string_agg(text, chr(9) order by col) from cells_v where trim(text) <> '' group by 1, 2""",
)
def _(t):
    return W.cells_to_lines(t.cells_v).drop("sheet")


@query(
    "block_to_cells",
    """with c as (select p_partkey, unnest([
      {'r': 0, 'c': 0, 'text': p_name}, {'r': 0, 'c': 1, 'text': p_brand}, {'r': 1, 'c': 0, 'text': ''},
      {'r': 1, 'c': 1, 'text': p_type}, {'r': 2, 'c': 0, 'text': cast(p_size as varchar)}]) as x from part),
    g as (select p_partkey, p_partkey % 40 + 1 + x.r as row_no, p_partkey % 10 + 1 + x.c as col_no, x.text as text from c)
    select p_partkey, row_no, chr(cast(64 + col_no as int)) as col, text, row_no <= 40 and col_no <= 10 and length(text) <= 200 as fits from g""",
)
def _(t):
    anchor = F.concat(F.char((F.col("p_partkey") % 10 + 65)), (F.col("p_partkey") % 40 + 1).cast("string"))
    block = F.concat(
        F.col("p_name"), F.lit("\t"), F.col("p_brand"), F.lit("\r\n\t"), F.col("p_type"), F.lit("\n"), F.col("p_size").cast("string"), F.lit("\n")
    )
    return W.block_to_cells(t.part, "p_partkey", anchor, block)


@query(
    "layout_two_sided",
    """with l as (select o_custkey as scenario, o_orderkey as ref, o_totalprice as amount, row_number() over (partition by o_custkey
        order by o_orderkey, o_totalprice) as rn from orders where o_orderpriority <> '5-LOW'),
    r as (select o_custkey as scenario, o_orderkey as ref, o_totalprice as amount, row_number() over (partition by o_custkey
        order by o_orderkey, o_totalprice) as rn from orders where o_orderstatus <> 'P')
    select distinct scenario, 1 as row_no, unnest(['A', 'B']) as col, unnest(['Statement reference', 'Statement amount']) as text from l
    union all select distinct scenario, 1, unnest(['D', 'E']), unnest(['Ledger reference', 'Ledger amount']) from r
    union all select scenario, rn + 1, unnest(['A', 'B']), unnest([cast(ref as varchar), cast(cast(amount as decimal(18,2)) as varchar)]) from l
    union all select scenario, rn + 1, unnest(['D', 'E']), unnest([cast(ref as varchar), cast(cast(amount as decimal(18,2)) as varchar)]) from r""",
)
def _(t):
    base = t.orders.select(
        F.col("o_custkey").alias("scenario"), F.col("o_orderkey").alias("ref"), F.col("o_totalprice").alias("amount"),
        "o_orderpriority", "o_orderstatus",
    )
    left = base.filter("o_orderpriority <> '5-LOW'").select("scenario", "ref", "amount")
    right = base.filter("o_orderstatus <> 'P'").select("scenario", "ref", "amount")
    return W.layout_two_sided(left, right, "scenario", "ref", "amount")


@query(
    "range_to_table",
    """select workbook_id, row_no, row_no = 1 as is_header, coalesce(max(case when col = 'B' then text end), '') as "B",
      coalesce(max(case when col = 'C' then text end), '') as "C", coalesce(max(case when col = 'D' then text end), '') as "D"
    from cells_v where row_no between 1 and 5 and col between 'B' and 'D' group by 1, 2""",
)
def _(t):
    return W.range_to_table(t.cells_v, "Data", "B1", "D5")


_USER = """select workbook_id, sheet, row_no, col, case when col = 'B' then '' else text || '!' end as text from cells_v where col in ('B', 'D')
    union all select workbook_id, sheet, row_no, 'J', 'new' from cells_v where col = 'A'"""


@query(
    "overlay_cells",
    f"""with u as ({_USER}) select coalesce(s.workbook_id, u.workbook_id) as workbook_id, coalesce(s.row_no, u.row_no) as row_no,
      coalesce(s.col, u.col) as col, case when u.col is not null then u.text else s.text end as text, u.col is not null as touched
    from cells_v s full join u on s.workbook_id = u.workbook_id and s.row_no = u.row_no and s.col = u.col""",
)
def _(t):
    changed = F.when(F.col("col") == "B", "").otherwise(F.concat("text", F.lit("!")))
    edited = t.cells_v.filter("col in ('B', 'D')").withColumn("text", changed)
    added = t.cells_v.filter("col = 'A'").withColumn("col", F.lit("J")).withColumn("text", F.lit("new"))
    return P.overlay_cells(t.cells_v, edited.unionByName(added)).drop("sheet")


@query(
    "explode_answers",
    """select event_id, 'k' as item_id, props->>'$.k' as value from events where event_type <> 'error' and props->>'$.k' is not null""",
)
def _(t):
    damaged = t.events.withColumn("props", F.when(F.col("event_type") == "error", F.concat(F.lit("{oops"), "props")).otherwise(F.col("props")))
    return P.explode_answers(damaged, "event_id", "props")


def packages(t):
    """One assessment package per part: two sections of two items, with keys beside the public fields."""
    options = F.array(*[F.struct(F.lit(f"o{i}").alias("id"), F.element_at(F.split("p_name", " "), 1 + i % 2).alias("text")) for i in range(1, 5)])

    def item(number: int, kind: str, category: str, points):
        return F.struct(
            F.concat(F.lit("q"), (F.lit(number) if number != 2 else F.when(F.col("p_partkey") % 9 == 0, 1).otherwise(2)).cast("string")).alias("id"),
            F.lit(kind).alias("type"),
            F.concat(F.lit("Describe "), F.col("p_name")).alias("prompt"),
            F.lit(category).alias("category"),
            points.cast("int").alias("points"),
            options.alias("options"),
            F.concat(F.lit("o"), (F.col("p_partkey") % 5 + 1).cast("string")).alias("answer"),
            (F.col("p_size") / 40).alias("tolerance"),
            (F.col("p_size") % 4).cast("int").alias("criteria"),
        )

    one = F.struct(
        F.lit("s1").alias("id"), F.col("p_brand").alias("title"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 12 + 3).alias("cap"),
        F.array(item(1, "single", "knowledge", F.col("p_size") % 12), item(2, "multi", "knowledge", F.lit(3))).alias("items"),
    )
    two = F.struct(
        F.lit("s2").alias("id"), F.substring("p_type", 1, 5).alias("title"), F.lit(None).cast("int").alias("cap"),
        F.array(
            item(3, "cell", "reconciliation", F.lit(4)), item(4, "note", "reconciliation", F.col("p_size") % 4 * 2 + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0))
        ).alias("items"),
    )
    return t.part.select("p_partkey", F.col("p_name").alias("title"), (F.col("p_size") * 61).alias("seconds"), F.array(one, two).alias("sections"))


_FIRST, _SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"


@query(
    "public_projection",
    f"""select p_partkey, s.sid as section_id, s.title as title, s.qid as item_id, s.kind as type, 'Describe ' || p_name as prompt,
      'o1=' || {_SECOND} || ';o2=' || {_FIRST} || ';o3=' || {_SECOND} || ';o4=' || {_FIRST} as options, 'id,title,items|id,type,prompt,options' as fields
    from (select p_partkey, p_name, unnest([
      {{'sid': 's1', 'title': p_brand, 'qid': 'q1', 'kind': 'single'}},
      {{'sid': 's1', 'title': p_brand, 'qid': case when p_partkey % 9 = 0 then 'q1' else 'q2' end, 'kind': 'multi'}},
      {{'sid': 's2', 'title': substr(p_type, 1, 5), 'qid': 'q3', 'kind': 'cell'}},
      {{'sid': 's2', 'title': substr(p_type, 1, 5), 'qid': 'q4', 'kind': 'note'}}]) as s from part) x""",
)
def _(t):
    shown = P.public_projection(packages(t), "p_partkey", "sections")
    inner = shown.schema["sections"].dataType.elementType
    fields = ",".join(inner.names) + "|" + ",".join(inner["items"].dataType.elementType.names)
    items = shown.select("p_partkey", F.inline("sections")).select("p_partkey", F.col("id").alias("section_id"), "title", F.explode("items").alias("i"))
    options = F.array_join(F.transform("i.options", lambda o: F.concat_ws("=", o["id"], o["text"])), ";")
    return items.select(
        "p_partkey", "section_id", "title", F.col("i.id").alias("item_id"), F.col("i.type").alias("type"), F.col("i.prompt").alias("prompt"),
        options.alias("options"), F.lit(fields).alias("fields"),
    )


@query(
    "catalogue_summary",
    """select p_partkey, p_brand || '|' || substr(p_type, 1, 5) as titles, 4 as items, cast(ceil(p_size * 61 / 60.0) as bigint) as minutes from part""",
)
def _(t):
    from vetloom.operators.scoring import catalogue_summary

    return catalogue_summary(packages(t), "p_partkey").select(
        "p_partkey", F.array_join("section_titles", "|").alias("titles"), F.col("item_count").alias("items"), "minutes"
    )


@query("rewrite_display_text", "select conv_id, turn, role, regexp_replace(text, '(?i)the', 'ZZ', 'g') as text from conversations")
def _(t):
    return P.rewrite_display_text(t.conversations, "the", "ZZ", ["text"])


@query("needs_term_review", "select p_partkey from part where lower(p_type) like '%econ%'")
def _(t):
    return P.needs_term_review(t.part, "econ", "-", ["p_name"]).select("p_partkey")


_DAYKEY = "user_id * 100 + day(ts)"


@query(
    "append_first_wins",
    f"""with e as (select {_DAYKEY} as k, event_id, ts, event_type from events),
    old as (select k, event_id from e where event_type = 'signup' qualify row_number() over (partition by k order by ts, event_id) = 1),
    new as (select k, event_id from e where event_type <> 'signup' qualify row_number() over (partition by k order by ts, event_id) = 1)
    select * from old union all select * from new where k not in (select k from old)""",
)
def _(t):
    from vetloom.plans.scans import latest_row

    keyed = t.events.select((F.col("user_id") * 100 + F.day("ts")).alias("k"), "event_id", "ts", "event_type")
    old = latest_row(keyed.filter("event_type = 'signup'"), ["k"], [F.col("ts"), F.col("event_id")])
    return P.append_first_wins(old, keyed.filter("event_type <> 'signup'"), ["k"], ["ts", "event_id"]).select("k", "event_id")


@query(
    "upsert_latest",
    f"""select {_DAYKEY} as k, event_id from events qualify row_number() over (partition by {_DAYKEY} order by ts desc, event_id desc) = 1""",
)
def _(t):
    keyed = t.events.select((F.col("user_id") * 100 + F.day("ts")).alias("k"), "event_id", "ts", "event_type")
    old, new = keyed.filter("event_type = 'signup'"), keyed.filter("event_type <> 'signup'")
    return P.upsert_latest(old, new, ["k"], ["ts", "event_id"]).select("k", "event_id")


@query(
    "masked_screening",
    r"""select candidate_id, case when length(regexp_replace(phone, '\D', '', 'g')) >= 4 then '+27•••••' || right(regexp_replace(phone, '\D', '', 'g'), 4)
      else 'Not recorded' end as contact_masked, case when candidate_id % 3 > 0 then substr(id_number, 1, 6) || '***' || right(id_number, 4)
      else 'Not recorded' end as id_masked, cast(cast(start_at as date) as varchar) as start_date, day_confirmed, travel_mode, travel_note,
      own_transport, available as assignment_available from customer_v""",
)
def _(t):
    from vetloom.functions.text import mask_id

    stored = F.when(F.col("candidate_id") % 3 > 0, mask_id(F.col("id_number"))).otherwise(F.col("id_number"))
    return P.masked_screening(t.customer_v.withColumn("id_masked", stored))


# ---- workbook lookups and cell aggregates ------------------------------------------------

@query(
    "range_stats",
    f"""with {cell_ctes("(select * from cells_v where row_no between 1 and 6 and col between 'B' and 'D')", 'text', 'c', 'c_')},
    g as (select workbook_id, coalesce(sum(case when c_kind = 'number' then c_num end), 0) as total, coalesce(min(case when c_kind = 'number' then c_num end), 0) as low,
      coalesce(max(case when c_kind = 'number' then c_num end), 0) as high, max(case when c_kind = 'error' then text end) as err from c group by 1)
    select workbook_id, case when err is null then total end as total, case when err is null then low end as low,
      case when err is null then high end as high, err from g""",
)
def _(t):
    return W.range_stats(t.cells_v, "data", "B1", "D6")


_DB = """p as (select workbook_id, row_no, max(case when col = 'D' then text end) as d, max(case when col = 'B' then text end) as b from cells_v group by 1, 2)"""


@query(
    "sum_if",
    f"""with {_DB} select workbook_id, case when max(case when d like '#%' then 1 else 0 end) = 0 then coalesce(sum(case when upper(d) = 'NOTE'
      then cast(b as double) end), 0) end as total, max(case when d like '#%' then d end) as err from p group by 1""",
)
def _(t):
    return W.sum_if(t.cells_v, "Data", "D", "B", (1, 40), "Note")


@query(
    "count_if_criteria",
    r"""select workbook_id, cast(count(*) filter (cast(text as double) >= 10) as bigint) as n, cast(null as varchar) as err from cells_v where col = 'B' group by 1""",
)
def _(t):
    return W.count_if_criteria(t.cells_v, "Data", "B", (1, 40), " >= 10")


@query(
    "count_if_not",
    r"""select workbook_id, case when max(case when text like '#%' then 1 else 0 end) = 0 then count(*) filter (coalesce(try_cast(text as double) <> 3, true)) end as n,
      max(case when text like '#%' then text end) as err from cells_v where col = 'D' group by 1""",
)
def _(t):
    return W.count_if_criteria(t.cells_v, "Data", "D", (1, 40), "<>3")


@query(
    "lookup_exact",
    """with k as (select o_orderkey as workbook_id, 'p' || cast(o_custkey % 50 as varchar) as wanted from orders),
    hit as (select k.workbook_id, min(a.row_no) as r from k join cells_v a on a.workbook_id = k.workbook_id and a.col = 'A'
      and upper(a.text) = upper(wanted) group by 1)
    select k.workbook_id, wanted, coalesce(b.text, '#N/A') as found from k left join hit on hit.workbook_id = k.workbook_id
      left join cells_v b on b.workbook_id = k.workbook_id and b.row_no = hit.r and b.col = 'B'""",
)
def _(t):
    keys = t.orders.select(F.col("o_orderkey").alias("workbook_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("wanted"))
    return W.lookup_exact(keys, W.range_rows(t.cells_v, "Data", "A", "B"), "wanted")


_KEYS = "k as (select o_orderkey as workbook_id, cast(o_custkey % 50 as varchar) as wanted from orders)"


@query(
    "lookup_approx",
    f"""with {_KEYS}, hit as (select k.workbook_id, max(a.row_no) as r from k join cells_v a on a.workbook_id = k.workbook_id and a.col = 'B'
      and cast(a.text as double) <= cast(wanted as double) group by 1)
    select k.workbook_id, wanted, coalesce(b.text, '#N/A') as found from k left join hit on hit.workbook_id = k.workbook_id
      left join cells_v b on b.workbook_id = k.workbook_id and b.row_no = hit.r and b.col = 'C'""",
)
def _(t):
    keys = t.orders.select(F.col("o_orderkey").alias("workbook_id"), (F.col("o_custkey") % 50).cast("string").alias("wanted"))
    return W.lookup_approx(keys, W.range_rows(t.cells_v, "Data", "B", "C"), "wanted")


@query(
    "match_position",
    f"""with {_KEYS}, m as (select k.workbook_id, min(case when cast(a.text as double) = cast(wanted as double) then a.row_no end) as first_equal,
      max(case when cast(a.text as double) <= cast(wanted as double) then a.row_no end) as last_low from k left join cells_v a
      on a.workbook_id = k.workbook_id and a.col = 'B' group by 1)
    select workbook_id, coalesce(cast(first_equal as varchar), '#N/A') as exact, coalesce(cast(last_low as varchar), '#N/A') as approx from m""",
)
def _(t):
    keys = t.orders.select(F.col("o_orderkey").alias("workbook_id"), (F.col("o_custkey") % 50).cast("string").alias("wanted"))
    rows = scans.stored(W.range_rows(t.cells_v, "Data", "B", "C"))  # two searches read it
    exact = W.match_position(keys, rows, "wanted", 0).withColumnRenamed("found", "exact")
    return W.match_position(exact, rows, "wanted", 1).select("workbook_id", "exact", F.col("found").alias("approx"))


@query(
    "index_cell",
    """with w as (select o_orderkey as workbook_id, o_custkey % 5 as r, o_custkey % 4 as c from orders)
    select w.workbook_id, r, c, case when r < 1 or c < 1 or r > 4 or c > 2 then '#REF!' else coalesce(text, '') end as found
    from w left join cells_v v on v.workbook_id = w.workbook_id and v.row_no = r + 1 and v.col = chr(cast(65 + c as int)) and r between 1 and 4 and c between 1 and 2""",
)
def _(t):
    wanted = t.orders.select(F.col("o_orderkey").alias("workbook_id"), (F.col("o_custkey") % 5).alias("r"), (F.col("o_custkey") % 4).alias("c"))
    return W.index_cell(t.cells_v, wanted, "Data", "B2", "C5")


_EDGES = r"""select distinct workbook_id, 'data!E' || cast(row_no as varchar) as from_ref, 'data!' || unnest(list_concat(
      [upper(replace(regexp_extract(text, '^=(\$?[A-J]\$?[0-9]+)', 1), '$', ''))], ['B1', 'B2', 'B3', 'C2'],
      [upper(regexp_extract(text, 'Data!([a-j][0-9]+)', 1))])) as to_ref from cells_v where text like '=%'"""


@query("cell_reference_edges", f"select * from ({_EDGES}) x")
def _(t):
    return W.cell_reference_edges(t.cells_v)


@query(
    "cell_cycles",
    f"""with recursive e as ({_EDGES}), s as (select distinct workbook_id, from_ref from e),
    f as (select e.* from e join s on e.workbook_id = s.workbook_id and e.to_ref = s.from_ref),
    reach as (select * from f union select r.workbook_id, r.from_ref, f.to_ref from reach r join f on f.workbook_id = r.workbook_id and f.from_ref = r.to_ref)
    select workbook_id, from_ref as cell from reach where from_ref = to_ref""",
)
def _(t):
    return W.cell_cycles(W.cell_reference_edges(t.cells_v))
