"""Joins over attempts, results, ledgers and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.predicates import NOW  # noqa: F401  (same clock)
from vetloom.catalog.registry import query
from vetloom.functions.phrases import literal
from vetloom.operators import joins as J
from vetloom.operators import mentions as M


def roster_inputs(t):
    candidates = t.customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("candidate"), F.when(F.col("c_nationkey") > 12, F.col("c_nationkey")).alias("attempt_number"))
    definitions = t.region.select((F.col("r_regionkey") + 1).alias("definition_id"), F.col("r_name").alias("definition"))
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.count("*").alias("score"))
    return t.attempts_v, candidates, definitions, results


_ROSTER = """select attempt_id, c_name as candidate, r_name as definition, score, coalesce(case when c_nationkey > 12 then c_nationkey end, 1) as attempt_number
    from attempts_v join customer on c_custkey = candidate_id join region on r_regionkey + 1 = definition_id
    left join (select l_orderkey, count(*) as score from lineitem group by 1) r on l_orderkey = attempt_id"""


@query("attempt_roster", f"{_ROSTER} order by started_at desc, attempt_id limit 100")
def _(t):
    return J.attempt_roster(*roster_inputs(t)).select("attempt_id", "candidate", "definition", "score", "attempt_number")


@query(
    "attempt_report",
    f"""with base as ({_ROSTER}), s as (select l_orderkey, string_agg(cast(rev as varchar), ',' order by rev, d) as saves from
      (select l_orderkey, l_linenumber as rev, l_shipdate as d, row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate) as rn from lineitem) x where rn <= 200 group by 1),
    a as (select user_id, string_agg(event_type, ',' order by ts, event_id) as audit from
      (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events) x where rn <= 300 group by 1)
    select attempt_id, candidate, definition, score, saves, audit from base left join s on s.l_orderkey = attempt_id left join a on user_id = attempt_id""",
)
def _(t):
    saves = t.lineitem.select(F.col("l_orderkey").alias("attempt_id"), F.col("l_linenumber").alias("revision"), F.col("l_shipdate").alias("saved_at"))
    audits = t.events.select(F.col("user_id").alias("attempt_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("audit_id"), "event_type")
    report = J.attempt_report(*roster_inputs(t), saves, audits)
    return report.select(
        "attempt_id", "candidate", "definition", "score",
        F.array_join(F.transform("saves", lambda s: s["revision"].cast("string")), ",").alias("saves"),
        F.array_join(F.transform("audit", lambda a: a["event_type"]), ",").alias("audit"),
    )


@query(
    "missing_results",
    "select attempt_id from attempts_v where status in ('completed', 'timed_out') and attempt_id not in (select l_orderkey from lineitem)",
)
def _(t):
    return J.missing_results(t.attempts_v, t.lineitem.select(F.col("l_orderkey").alias("attempt_id"))).select("attempt_id")


@query(
    "guarded_insert",
    "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0 and c_mktsegment = 'BUILDING')",
)
def _(t):
    guard = t.customer.filter("c_acctbal > 0 and c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.guarded_insert(t.orders, guard, ["o_custkey"]).select("o_orderkey")


@query(
    "reconcile",
    """with l as (select ref, count(*) as n, min(amount) as a, sum(cast(amount as decimal(18,2))) as s from statement_v group by 1),
    r as (select ref, count(*) as n, min(amount) as a, sum(cast(amount as decimal(18,2))) as s from ledger_v group by 1)
    select coalesce(l.ref, r.ref) as ref, l.a as left_amount, r.a as right_amount, case when r.n is null then 'left only' when l.n is null then 'right only'
      when l.n > 1 or r.n > 1 then 'duplicate' when abs(l.a - r.a) < 0.005 then 'matched' else 'amount differs' end as state,
      round(cast(coalesce(l.s, 0) - coalesce(r.s, 0) as double), 2) as net from l full join r on l.ref = r.ref""",
)
def _(t):
    return J.reconcile(t.statement_v, t.ledger_v, "ref", "amount")


_SENT = r"""select {keys}, lower(trim(regexp_replace(part, '\s+', ' ', 'g'))) as canonical from
    (select {keys}, unnest(regexp_split_to_array(text, '[.\n]+')) as part from {table}) x where trim(regexp_replace(part, '\s+', ' ', 'g')) <> ''"""


@query(
    "content_overlap",
    f"""with p as ({_SENT.format(keys='item_id', table='benchmark')}), d as ({_SENT.format(keys='doc_id', table='documents')})
    select item_id, canonical from p where canonical in (select canonical from d)""",
)
def _(t):
    published = J.sentences(t.benchmark, ["item_id"], "text", "sentence")
    practice = J.sentences(t.documents, ["doc_id"], "text", "sentence")
    return J.content_overlap(published, practice).select("item_id", "canonical")


@query(
    "overlap_any",
    f"""with p as ({_SENT.format(keys='item_id', table='benchmark')}), d as ({_SENT.format(keys='source', table='documents')})
    select source, count(distinct canonical) as overlaps from d where canonical in (select canonical from p) group by 1""",
)
def _(t):
    published = J.sentences(t.benchmark, ["item_id"], "text", "sentence")
    return J.overlap_any(published, J.sentences(t.documents, ["source"], "text", "sentence"), "source")


_ENDINGS = "|".join(literal(e) for e in M.CORPORATE_ENDINGS)


@query(
    "dictionary_mentions",
    rf"""with pat as (select '(?i)\b(' || string_agg(name, '|' order by length(name) desc, name) || ')({_ENDINGS})?\b' as p from names_v),
    m as (select doc_id, lower(unnest(regexp_extract_all(text, p, 0))) as mention, lower(unnest(regexp_extract_all(text, p, 1))) as key from briefs_v, pat)
    select doc_id, name, mention, count(*) as n, descriptor from m join names_v on lower(name) = key group by all""",
)
def _(t):
    return M.dictionary_mentions(t.briefs_v, t.names_v, "doc_id", "text")
