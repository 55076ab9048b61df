"""Streaming rules; every query drains a stream over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vetloom.catalog.redaction import _PATTERN, HOUSE, SQL_STEPS, _collapsed, all_names
from vetloom.catalog.registry import QUERIES, query
from vetloom.session import checkpoint_dir
from vetloom.sources.tables import SCHEMAS
from vetloom.streaming import jobs as Z


def live(t, name: str):
    """A stream over one input table, which is a file or a folder of part files.

    A file can't be the root of a stream: its folder is, and a filter on names picks the file.
    """
    reader = t.spark.readStream.schema(SCHEMAS[name])
    path = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.directory}/{name}.parquet")
    if path.getFileSystem(t.spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory():
        return reader.parquet(path.toString())
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.directory)


END = -1


def live_events(t):
    """The events as a stream, with a row far in the future that tells the stream that its input has ended.

    Its user is ``END``; results leave it out.
    """
    folder = f"{checkpoint_dir(t.spark)}/end-{uuid.uuid4().hex}"
    t.spark.sql(
        f"select cast({END} as bigint) as event_id, timestamp '2200-01-01 00:00:00' as ts, cast({END} as bigint) as user_id, 'end' as event_type, 0D as value, '{{}}' as props"
    ).write.parquet(folder)
    end = t.spark.readStream.schema(SCHEMAS["events"]).parquet(folder)
    return live(t, "events").unionByName(end)


def drained(t, stream):
    return Z.run_to_table(stream, f"{checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}")


def saves(events):
    """Saves with the revision the client expects in the payload, bounded so that chains form."""
    return events.select(
        F.col("user_id").alias("attempt_id"), F.col("event_id").alias("save_id"), F.col("ts").alias("arrival"),
        (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("expected_revision"), F.lit("2024-01-25 00:00:00").cast("timestamp").alias("expires_at"),
    )


_CHAIN = """with recursive s as (select user_id as attempt_id, event_id as save_id, cast(props->>'$.k' as bigint) % 4 as e, row_number() over (partition by user_id order by ts, event_id) as k
      from events where ts < timestamp '2024-01-25 00:00:00'),
    f as (select attempt_id, save_id, k, case when e = 0 then 1 else 0 end as current, e = 0 as accepted from s where k = 1
      union all select s.attempt_id, s.save_id, s.k, f.current + case when s.e = f.current then 1 else 0 end, s.e = f.current from f join s on s.attempt_id = f.attempt_id and s.k = f.k + 1)"""


@query("stream_accepted_saves", f"{_CHAIN} select attempt_id, save_id, current as revision from f where accepted")
def _(t):
    return drained(t, Z.stream_accepted_saves(saves(live_events(t))))


@query("stream_attempt_deadlines", f"{_CHAIN} select attempt_id, 'timed_out' as status, max(current) as revision from f group by 1")
def _(t):
    return drained(t, Z.stream_attempt_deadlines(saves(live_events(t))))


@query("stream_first_result", "select user_id as attempt_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts, event_id) = 1")
def _(t):
    results = live_events(t).withColumnRenamed("user_id", "attempt_id")
    fields = "attempt_id long, event_id long, event_type string, value double"
    return drained(t, Z.stream_first_result(results, "attempt_id", "ts", ["event_id", "event_type", "value"], fields)).filter(F.col("attempt_id") != END)


@query("stream_rate_limit", QUERIES["rate_limit_sliding"].sql)
def _(t):
    limited = drained(t, Z.stream_rate_limit(live_events(t), "user_id", "ts", "event_id", n=3, seconds=86400))
    return limited.filter(F.col("event_id") != END)


@query("stream_event_counts", """select cast(time_bucket(interval '1 minute', ts) as varchar) as start, event_type, count(*) as n from events group by 1, 2""")
def _(t):
    counts = drained(t, Z.stream_event_counts(live_events(t), "ts", "event_type")).filter("event_type <> 'end'")
    return counts.select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query(
    "stream_event_counts_sliding",
    """select cast(time_bucket(interval '30 minutes', ts) - interval '30 minutes' * k as varchar) as start, event_type, count(*) as n from events, range(2) r(k) group by 1, 2""",
)
def _(t):
    counts = drained(t, Z.stream_event_counts(live_events(t), "ts", "event_type", "1 hour", "30 minutes")).filter("event_type <> 'end'")
    return counts.select(F.col("start").cast("string").alias("start"), "event_type", "n")


@query(
    "stream_sessions",
    """with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '12' hour, true) as fresh from events),
    s as (select *, sum(cast(fresh as int)) over (partition by user_id order by ts, event_id) as n_s from g)
    select user_id, epoch_us(min(ts)) as start, epoch_us(max(ts) + interval '12' hour) as end_us, count(*) as n from s group by user_id, n_s""",
)
def _(t):
    sessions = drained(t, Z.stream_sessions(live_events(t), "user_id", "ts", "12 hours")).filter(F.col("user_id") != END)
    return sessions.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_latest_state", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def _(t):
    folder = f"{checkpoint_dir(t.spark)}/latest-{uuid.uuid4().hex}"
    Z.stream_latest_state(live(t, "events"), f"{folder}/table", ["user_id"], ["ts", "event_id"], f"{folder}/state").awaitTermination()
    return Z.read_latest_state(t.spark, f"{folder}/table").select("user_id", "event_id")


def outcomes(events):
    kind = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "view", "not_configured").otherwise("failed")
    return events.select(F.col("user_id").alias("result"), "ts", "event_id", kind.alias("outcome"))


@query(
    "stream_notify_retry",
    """with recursive o as (select user_id, case event_type when 'purchase' then 'sent' when 'view' then 'not_configured' else 'failed' end as x, row_number() over (partition by user_id order by ts, event_id) as k from events),
    f as (select user_id, k, x as status, case when x = 'failed' then 1 else 0 end as tries from o where k = 1
      union all select o.user_id, o.k, case when f.status = 'sent' or f.tries >= 5 then f.status else o.x end, case when f.status = 'sent' or f.tries >= 5 then f.tries else f.tries + cast(o.x = 'failed' as int) end
      from f join o on o.user_id = f.user_id and o.k = f.k + 1)
    select user_id as result_id, arg_max(status, k) as status, arg_max(tries, k) as tries from f group by 1""",
)
def _(t):
    steps = drained(t, Z.stream_notify_retry(outcomes(live_events(t)), "result", "ts", "event_id", "outcome")).filter(F.col("result_id") != END)
    newest = steps.groupBy("result_id").agg(F.max_by(F.struct("status", "tries"), "step").alias("s"))
    return newest.select("result_id", "s.status", "s.tries")


def _sanitise_sql() -> str:
    ctes, last = [_PATTERN, "p0 as (select doc_id, text, cast([] as varchar[]) as log from documents)"], "p0"
    for n, name in enumerate(list(SQL_STEPS)[:12], 1):
        if n == 6:
            ctes += all_names(last)
            last = "nm"
        entries, changed = SQL_STEPS[name][1]("text")
        ctes.append(f"p{n} as materialized (select doc_id, {changed} as text, list_concat(log, {entries}) as log from {last})")
        last = f"p{n}"
    return "with " + ",\n".join(ctes) + f" select doc_id, {_collapsed('text')} as text, array_to_string(list_sort(log), ';') as log from {last}"


@query("stream_sanitise", _sanitise_sql())
def _(t):
    from vetloom.catalog.redaction import shown

    return shown(drained(t, Z.stream_sanitise(live(t, "documents").select("doc_id", "text"), "doc_id", "text", t.names_v, HOUSE)))
