"""Filters, states, top-n lists and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetloom.catalog.registry import query
from vetloom.functions import identity as I
from vetloom.operators import predicates as P
from vetloom.sources.views import NOW_EVENTS, NOW_ORDERS

NOW = f"timestamp '{NOW_ORDERS}'"


@query("open_attempts", f"select attempt_id from attempts_v where status = 'active' and expires_at > {NOW}")
def _(t):
    return P.open_attempts(t.attempts_v, NOW_ORDERS).select("attempt_id")


@query(
    "attempt_status_at",
    f"""select l_orderkey + 3 as attempt_id, case when status is null then 'not_found' when status = 'active' and expires_at <= {NOW} then 'timed_out'
    else status end as status_at from (select distinct l_orderkey from lineitem) l left join attempts_v a on a.attempt_id = l_orderkey + 3""",
)
def _(t):
    ids = t.lineitem.select((F.col("l_orderkey") + 3).alias("attempt_id")).distinct()
    return P.attempt_status_at(ids, t.attempts_v, NOW_ORDERS)


@query(
    "close_overdue",
    f"""select attempt_id, case when status = 'active' and expires_at <= {NOW} then 'timed_out' else status end as status,
    cast(case when status = 'active' and expires_at <= {NOW} then {NOW} else closed_at end as varchar) as closed_at from attempts_v""",
)
def _(t):
    return P.close_overdue(t.attempts_v, NOW_ORDERS).select("attempt_id", "status", F.col("closed_at").cast("string").alias("closed_at"))


@query(
    "close_overdue_batch",
    f"""select attempt_id, status, attempt_id in (select attempt_id from attempts_v where status = 'active' and expires_at <= {NOW}
      order by expires_at, attempt_id limit 50) as closed_now from attempts_v""",
)
def _(t):
    before = t.attempts_v.select("attempt_id", F.col("status").alias("was"))
    after = P.close_overdue(t.attempts_v, NOW_ORDERS, batch=50).join(before, "attempt_id")
    return after.select("attempt_id", F.col("was").alias("status"), (F.col("status") != F.col("was")).alias("closed_now"))


def offers(t):
    return t.orders.select(
        F.col("o_orderkey").alias("offer_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderstatus") == "P", "withdrawn").otherwise("active").alias("status"),
        F.expr("case when o_orderpriority = '4-NOT SPECIFIED' then null else o_orderdate + interval '90' day end").alias("expires_at"),
        F.col("o_orderdate").alias("created_at"),
    )


_OFFERS = """offers as (select o_orderkey as offer_id, o_custkey as user_id, case when o_orderstatus = 'P' then 'withdrawn' else 'active' end as status,
    case when o_orderpriority = '4-NOT SPECIFIED' then null else o_orderdate + interval '90' day end as expires_at, o_orderdate as created_at from orders),
    states as (select *, case when status <> 'active' then 'unavailable' when expires_at <= %s then 'expired' else 'ok' end as state from offers)""" % NOW


@query("offer_state", f"with {_OFFERS} select offer_id, state from states")
def _(t):
    return P.offer_state(offers(t), NOW_ORDERS).select("offer_id", "state")


def acceptances(t):
    return t.events.filter("event_type in ('signup', 'click')").select(
        F.col("user_id").alias("offer_id"), (F.col("event_type") == "signup").alias("accepted"), F.col("ts").alias("accepted_at"), "event_id"
    )


_ACC = "acc as (select user_id as offer_id, max(ts) as accepted_at from events where event_type = 'signup' group by 1)"


@query(
    "offer_access",
    f"""with {_OFFERS}, {_ACC} select offer_id, case when state <> 'ok' then state when accepted_at is null then 'undertaking missing' else 'open' end as access
    from states left join acc using (offer_id)""",
)
def _(t):
    return P.offer_access(offers(t), acceptances(t), NOW_ORDERS).select("offer_id", "access")


@query(
    "valid_invitation",
    f"""select attempt_id, case when status <> 'active' then 'not issued' when expires_at <= {NOW} then 'expired'
      when n_regionkey = 0 or n_regionkey is null then 'not published' when attempt_id % 3 = 1 then 'other email' else 'ok' end as verdict
    from attempts_v left join nation on n_nationkey = candidate_id % 30""",
)
def _(t):
    invitations = t.attempts_v.select(
        "attempt_id", "expires_at", (F.col("candidate_id") % 30).alias("definition_id"),
        F.when(F.col("status") == "active", "issued").otherwise("redeemed").alias("status"),
        F.when(F.col("attempt_id") % 3 > 0, F.concat(F.lit("User"), (F.col("attempt_id") % 3).cast("string"), F.lit("@mail.com"))).alias("intended_email"),
        F.lit("user2@mail.com").alias("email"),
    )
    definitions = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("definition_id"), (F.col("n_regionkey") > 0).alias("published"), F.col("n_name").alias("version_id")
    )
    return P.valid_invitation(invitations, definitions, NOW_ORDERS).select("attempt_id", "verdict")


@query(
    "search_rows",
    """select c_custkey from customer join nation on c_nationkey = n_nationkey where contains(lower(c_name || ' ' || n_name || ' ' || c_mktsegment), 'nation_1')""",
)
def _(t):
    wide = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return P.search_rows(wide, ["c_name", "n_name", "c_mktsegment"], " Nation_1 ").select("c_custkey")


@query("facet_filter", "select p_type, count(*) as n from part group by 1 union all select 'all ' || p_type, count(*) from part where p_type = 'ECONOMY' group by 1")
def _(t):
    every = P.facet_filter(t.part, "p_type", "all").groupBy("p_type").agg(F.count("*").alias("n"))
    one = P.facet_filter(t.part, "p_type", "ECONOMY").groupBy("p_type").agg(F.count("*").alias("n"))
    return every.unionByName(one.withColumn("p_type", F.concat(F.lit("all "), "p_type")))


def catalogue_tables(t):
    definitions = t.part.select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("slug"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") > 10, "published").otherwise("draft").alias("status"), F.col("p_partkey").alias("version_id"),
    )
    versions = t.part.select(F.col("p_partkey").alias("version_id"), F.when(F.col("p_type") != "ECONOMY", F.lit("1998-01-01")).alias("published_at"))
    return definitions, versions


@query(
    "published_catalogue",
    """select 'part-' || cast(p_partkey as varchar) as slug, p_name as title from part where p_size > 10 and p_type <> 'ECONOMY' order by title, slug limit 100""",
)
def _(t):
    return P.published_catalogue(*catalogue_tables(t)).select("slug", "title")


@query("published_by_slug", "select 'part-1' as slug, count(*) as n from part where p_partkey = 1 and p_size > 10 and p_type <> 'ECONOMY'")
def _(t):
    return P.published_catalogue(*catalogue_tables(t), slug="part-1").agg(F.lit("part-1").alias("slug"), F.count("*").alias("n"))


@query(
    "valid_token",
    r"""select c_custkey, regexp_matches(tok, '^[a-f0-9]{64}$') as token_ok, regexp_matches(slug, '^[a-z0-9-]{3,60}$') as slug_ok
    from (select c_custkey, case when c_nationkey % 2 = 0 then sha256(c_name) else upper(sha256(c_name)) end as tok,
      case when c_nationkey % 3 = 0 then c_mktsegment else lower(c_mktsegment) || '-x' end as slug from customer) x""",
)
def _(t):
    digest = F.sha2("c_name", 256)
    token = F.when(F.col("c_nationkey") % 2 == 0, digest).otherwise(F.upper(digest))
    slug = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lower("c_mktsegment"), F.lit("-x")))
    return t.customer.select("c_custkey", I.valid_token(token).alias("token_ok"), I.valid_slug(slug).alias("slug_ok"))


@query("known_events", "select event_id from events where event_type in ('signup', 'view', 'click') and user_id is not null")
def _(t):
    return P.known_events(t.events, ["signup", "view", "click"], "user_id").select("event_id")


_FOLD = r"lower(trim(regexp_replace(translate({}, '‒–—', '---'), '\s+', ' ', 'g')))"


def turn_pairs(t):
    """Each assistant turn beside the user turn before it in the same conversation."""
    asked = t.conversations.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    answered = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("proposal"))
    return answered.join(asked, ["conv_id", "turn"])


PAIRS = """pairs as (select a.conv_id, a.turn, a.text as proposal, u.text as source from conversations a join conversations u
    on u.conv_id = a.conv_id and u.turn + 1 = a.turn where a.role = 'assistant' and u.role = 'user')"""


@query(
    "evidence_quote_found",
    f"""with {PAIRS}, q as (select *, case when turn % 4 = 1 then ' ' || upper(split_part(source, ' ', 2)) || '  ' else split_part(proposal, ' ', 2) end as quote from pairs)
    select conv_id, turn, {_FOLD.format('quote')} <> '' and contains({_FOLD.format('source')}, {_FOLD.format('quote')}) as found from q""",
)
def _(t):
    quote = F.when(
        F.col("turn") % 4 == 1, F.concat(F.lit(" "), F.upper(F.split_part("source", F.lit(" "), F.lit(2))), F.lit("  "))
    ).otherwise(F.split_part("proposal", F.lit(" "), F.lit(2)))
    pairs = turn_pairs(t).withColumn("quote", quote)
    return P.evidence_quote_found(pairs, "source", "quote").select("conv_id", "turn", "found")


@query("recent_n", "select event_id, user_id from events order by ts desc, event_id desc limit 200")
def _(t):
    return P.recent_n(t.events, 200, [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id")


@query(
    "audit_trail",
    "select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as position from events qualify position <= 300",
)
def _(t):
    return P.audit_trail(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "position")


@query(
    "notify_queue",
    """with r as (select user_id as attempt_id, max(ts) as graded_at, count(*) filter (event_type = 'error') as tries,
      max(case when event_type = 'purchase' and value > 190 then ts end) as notified_at from events group by 1)
    select attempt_id, cast(tries as bigint) as tries from r join attempts_v a using (attempt_id) where notified_at is null and tries < 14 and status in ('completed', 'timed_out')
    order by graded_at, attempt_id limit 5""",
)
def _(t):
    results = t.events.groupBy(F.col("user_id").alias("attempt_id")).agg(
        F.max("ts").alias("graded_at"),
        F.count_if(F.col("event_type") == "error").alias("notify_attempts"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 190), F.col("ts"))).alias("notified_at"),
    )
    return P.notify_queue(results, t.attempts_v, retries=14).select("attempt_id", F.col("notify_attempts").alias("tries"))


@query("longest_first", "select name, row_number() over (order by length(name) desc, name) as position from names_v")
def _(t):
    return P.longest_first(t.names_v).select("name", "position")


@query(
    "sort_study",
    """select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by case when o_orderstatus = 'P' then 0
      else year(o_orderdate) end desc, o_orderkey) as place from orders""",
)
def _(t):
    rows = t.orders.withColumn("year", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")))
    return P.sort_study(rows, "o_custkey", "year", "o_orderkey").select("o_custkey", "o_orderkey", "place")
