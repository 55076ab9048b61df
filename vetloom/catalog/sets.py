"""Set comparisons, fingerprints and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.registry import query
from vetloom.operators import sets as S


def chosen_sets(t):
    """Flags chosen per line beside the wanted set."""
    return t.line_v.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_partkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array("l_linestatus", "l_returnflag", "l_linestatus")).alias("chosen"),
        F.array(F.lit("N"), F.lit("O")).alias("wanted"),
    )


@query("exact_set_match", "select l_orderkey, l_linenumber, l_partkey % 10 <> 0 and l_returnflag = 'N' and l_linestatus = 'O' as same_set from line_v")
def _(t):
    return S.exact_set_match(chosen_sets(t), "chosen", "wanted").select("l_orderkey", "l_linenumber", "same_set")


@query(
    "hits_and_false_positives",
    """select l_orderkey, l_linenumber, case when l_partkey % 10 = 0 then 0 else cast(l_returnflag = 'N' as int) + cast(l_linestatus = 'O' as int) end as hits,
    case when l_partkey % 10 = 0 then 0 else cast(l_returnflag <> 'N' as int) + cast(l_linestatus <> 'O' as int) end as false_positives from line_v""",
)
def _(t):
    return S.hits_and_false_positives(chosen_sets(t), "chosen", "wanted").select("l_orderkey", "l_linenumber", "hits", "false_positives")


@query(
    "union_new_items",
    """select p_brand, p_partkey, false as added from part where p_size <= 5 union all
    select p_brand, min(p_partkey), true from part a where p_size > 5 and not exists (select 1 from part b where b.p_size <= 5 and b.p_brand = a.p_brand and lower(b.p_name) = lower(a.p_name))
    group by p_brand, lower(p_name)""",
)
def _(t):
    base = t.part.filter("p_size <= 5").select("p_brand", "p_partkey", "p_name")
    incoming = t.part.filter("p_size > 5").select("p_brand", "p_partkey", F.upper("p_name").alias("p_name"))
    return S.union_new_items(base, incoming, "p_brand", "p_name", ["p_partkey"]).select("p_brand", "p_partkey", "added")


@query(
    "content_fingerprint",
    r"""with f as (select workbook_id, sha256(string_agg('data!' || lower(col) || row_no || '=' || lower(trim(coalesce(text, ''))), chr(10)
      order by 'data!' || lower(col) || row_no || '=' || lower(trim(coalesce(text, ''))))) as fingerprint from cells_v group by 1)
    select workbook_id, fingerprint, count(*) over (partition by fingerprint) as copies, min(workbook_id) over (partition by fingerprint) as first_workbook from f""",
)
def _(t):
    return S.content_fingerprint(t.cells_v).select("workbook_id", "fingerprint", "copies", "first_workbook")


@query(
    "duplicate_items",
    r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, lower(regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g')) as k from documents)
    select * from (select doc_id, line_no, min(line_no) over (partition by doc_id, k) as first_at from l where k <> '') x where line_no > first_at""",
)
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return S.duplicate_items(lines, "doc_id", "line_no", "line").select("doc_id", "line_no", "first_at")


@query(
    "distinct_matches",
    r"select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+[0-9]+'))) as match, count(*) as n from briefs_v group by 1, 2",
)
def _(t):
    return S.distinct_matches(t.briefs_v, "doc_id", "text", "[A-Za-z]+[0-9]+")


@query(
    "unlisted_refs",
    "select attempt_id, item_id, code, regexp_replace(upper(code), '[^A-Z0-9]', '', 'g') in ('GRN1', 'GRN7', 'GRN12') as listed from answers_v",
)
def _(t):
    from vetloom.functions.text import reference_key

    answers = t.answers_v.select("attempt_id", "item_id", "code", reference_key(F.col("code")).alias("ref"))
    allowed = t.spark.createDataFrame([("GRN1",), ("GRN7",), ("GRN12",), ("GRN7",)], "ref string")
    return S.unlisted_refs(answers, allowed, ["ref"]).drop("ref")
