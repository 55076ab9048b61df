"""Event-time rules as Structured Streaming jobs.

The rule clock is the event's own time, so the allowed lateness is a parameter with default zero. Ordered rules hold rows
until the watermark has passed them, so results depend neither on the order of arrival nor on triggers. Their states are
a few values per key (a revision, at most ``n`` accepted times, a retry count) and end at an event time.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vetloom.operators import mentions, projections, redaction

MICRO = 1_000_000


def _columns(out: list[tuple], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=list(names))


#: Event time of a slice; a step holds the rows that a key has in one.
SLICE_SECONDS = 86_400
#: Waiting rows in one state value.
VALUE_ROWS = 1_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Rows of a key wait in slices of event time until the watermark has passed them; then they are folded in order.

    State per key: ``folded`` holds the state of the rule and the waiting rows while they are at most ``VALUE_ROWS``, so that
    a key of few rows is read and written in one go. Beyond that, ``rows`` maps (slice, part) to at most ``VALUE_ROWS``
    waiting rows, ``slices`` the slices that have rows to their number of parts. A step reads the slices that are due, one
    at a time, and drops them; a timer wakes the key for its next slice or for the end of its state.
    """

    def __init__(self, key: str, fields: Sequence[str], names: Sequence[str], start, fold, until, close):
        self.key, self.fields, self.names = key, list(fields), list(names)
        self.start, self.fold, self.until, self.close_key = start, fold, until, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slice long, part long", "data binary")
        self.slices = handle.getMapState("slices", "slice long", "parts long")
        self.folded = handle.getValueState("folded", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, last, few, spilled = self._held()
        for frame in rows:
            if frame.empty:  # such frames have no columns
                continue
            few += zip(frame["event_micros"].tolist(), *(frame[f].tolist() for f in self.fields))
        if len(few) > VALUE_ROWS:
            for number, new in self._by_slice(few).items():
                self._wait(number, new)
            few, spilled = [], True
        yield from self._release(key, timerValues.getCurrentWatermarkInMs(), now, last, few, spilled)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs(), *self._held())

    def _held(self) -> tuple:
        """State of the rule, time of its last row, the few waiting rows, and whether others wait in slices."""
        held = self.folded.get()
        return (self.start(), 0, [], False) if held is None else pickle.loads(held[0])

    def _by_slice(self, rows: list[tuple]) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for row in rows:
            out.setdefault(row[0] // (SLICE_SECONDS * MICRO), []).append(row)
        return out

    def close(self) -> None:
        pass

    def _wait(self, number: int, rows: list[tuple]) -> None:
        held = self.slices.getValue((number,))
        parts = held[0] if held else 0
        for at in range(0, len(rows), VALUE_ROWS):
            self.rows.updateValue((number, parts), (pickle.dumps(rows[at : at + VALUE_ROWS]),))
            parts += 1
        self.slices.updateValue((number,), (parts,))

    def _taken(self, number: int, parts: int) -> list[tuple]:
        """The waiting rows of a slice, which leave the state."""
        rows: list[tuple] = []
        for part in range(parts):
            rows += pickle.loads(self.rows.getValue((number, part))[0])
            self.rows.removeKey((number, part))
        self.slices.removeKey((number,))
        return rows

    def _release(self, key, mark: int, now, last: int, few: list[tuple], spilled: bool) -> Iterator[pd.DataFrame]:
        parts = {k[0]: v[0] for k, v in self.slices.iterator()} if spilled else {}
        near = self._by_slice(few)
        waiting: int | None = None
        out: list[tuple] = []
        for number in sorted({*parts, *near}):
            if number * SLICE_SECONDS * 1000 > mark:
                waiting = number * SLICE_SECONDS * MICRO
                break
            rows = near.pop(number, [])
            if number in parts:
                rows = rows + self._taken(number, parts.pop(number))
            rows.sort()
            ready = bisect.bisect_right([row[0] for row in rows], mark * 1000)
            for row in rows[:ready]:
                if now is not None:
                    now, more = self.fold(key, now, row[0], row[1:])
                    out += more
                    last = row[0]
            if len(out) >= VALUE_ROWS:
                yield _columns(out, self.names)
                out = []
            if ready < len(rows):
                near[number] = rows[ready:]
                waiting = rows[ready][0]
                break
        if out:
            yield _columns(out, self.names)
        if sum(map(len, near.values())) > VALUE_ROWS:
            for number, rows in near.items():
                self._wait(number, rows)
                parts[number] = 1
            near = {}
        end = None if now is None else self.until(now, last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting is None and (now is None or (end is not None and end <= mark * 1000)):
            if self.close_key is not None and now is not None:
                yield _columns(self.close_key(key, now), self.names)
            self.folded.clear()
            return
        self.folded.update((pickle.dumps((now, last, [row for rows in near.values() for row in rows], bool(parts))),))
        due = waiting if waiting is not None else end
        if due is not None:
            self.handle.registerTimer(max(mark + 1, -(-due // 1000)))


def in_order(
    df: DataFrame, key: str, ts: str, fields: Sequence[str], output: str, start: Callable[[], object],
    fold: Callable[[tuple, object, int, tuple], tuple[object, list[tuple]]], until: Callable[[object, int], int | None],
    lateness: str = "0 seconds", close: Callable[[tuple, object], list[tuple]] | None = None,
    only: Column | None = None,
) -> DataFrame:
    """A fold over the rows of each key in the order ``(ts, *fields)``, whatever the order and the triggers of arrival.

    Rows wait in the state until the watermark has passed their time: nothing earlier can come then, because rows behind
    the watermark are refused. ``fold(key, state, micros, row)`` gives the next state and the rows to emit; a state of
    None ends the key. ``until(state, micros of the last row)`` says from when on the state no longer matters; at that
    event time it is dropped, after ``close(key, state)`` has given the last rows. None keeps it.
    Rows that ``only`` refuses move the clock and nothing else. The state is of many small values, kept by RocksDB, which
    the session is set to; a step holds one slice of a key.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [part.split()[0] for part in output.split(",")]
    timed = df.withWatermark(ts, lateness).filter(F.lit(True) if only is None else only).select(key, ts, F.unix_micros(ts).alias("event_micros"), *fields)  # no leading underscore: workers rename such fields
    processor = InOrder(key, fields, names, start, fold, until, close)
    return timed.groupBy(key).transformWithStateInPandas(processor, output, "Append", "EventTime")


def _take_save(revision: int, us: int, save: tuple) -> bool:
    _, expected, expires = save
    return us < expires and expected == revision


def _saves(saves: DataFrame) -> DataFrame:
    return saves.withColumn("expires", F.unix_micros("expires_at"))


#: Later saves are refused before they reach a state.
IN_TIME = "arrival < expires_at"


def stream_accepted_saves(saves: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Saves in time that expect the revision current at their arrival; the state ends with the attempt's deadline."""

    def fold(k: tuple, now: tuple, us: int, save: tuple) -> tuple[tuple, list[tuple]]:
        revision, _ = now
        if _take_save(revision, us, save):
            return (revision + 1, save[2]), [(k[0], save[0], revision + 1)]
        return (revision, save[2]), []

    return in_order(
        _saves(saves), "attempt_id", "arrival", ["save_id", "expected_revision", "expires"], "attempt_id long, save_id long, revision long",
        lambda: (0, None), fold, lambda now, last: now[1], lateness, only=F.expr(IN_TIME),
    )


def stream_attempt_deadlines(saves: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """One closing row per attempt once event time has passed its deadline: the last revision saved before it.

    Saves at or after the deadline never start a state, and saves before it are behind the watermark once it has closed,
    so an attempt closes once.
    """

    def fold(k: tuple, now: tuple, us: int, save: tuple) -> tuple[tuple, list[tuple]]:
        return (now[0] + _take_save(now[0], us, save), save[2]), []

    return in_order(
        _saves(saves), "attempt_id", "arrival", ["save_id", "expected_revision", "expires"], "attempt_id long, status string, revision long",
        lambda: (0, None), fold, lambda now, last: now[1], lateness, lambda k, now: [(k[0], "timed_out", now[0])], F.expr(IN_TIME),
    )


def stream_first_result(results: DataFrame, key: str, ts: str, fields: Sequence[str], output: str, keep_days: int = 40, lateness: str = "0 seconds") -> DataFrame:
    """The first result of every key by time, with its payload ``fields``; later ones are refused for ``keep_days`` days."""

    def fold(k: tuple, now: tuple, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        return ((True,), [] if now[0] else [(k[0], *row)])

    return in_order(results, key, ts, fields, output, lambda: (False,), fold, lambda now, last: last + keep_days * 86_400 * MICRO, lateness)


def stream_rate_limit(events: DataFrame, key: str, ts: str, event_id: str, n: int = 30, seconds: int = 60, lateness: str = "0 seconds") -> DataFrame:
    """Accept while fewer than ``n`` requests were accepted in the last ``seconds``; the state ends that long after the last."""
    width = seconds * MICRO

    def fold(k: tuple, now: tuple, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        kept = tuple(t for t in now if t > us - width)
        accepted = len(kept) < n
        return (kept + (us,) if accepted else kept), [(row[0], accepted)]

    return in_order(events, key, ts, [event_id], "event_id long, accepted boolean", tuple, fold, lambda now, last: last + width, lateness)


def stream_event_counts(events: DataFrame, ts: str, kind: str, width: str = "1 minute", slide: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """Tumbling or sliding counts per event type; the same code is its batch twin."""
    timed = events.withWatermark(ts, lateness) if events.isStreaming else events
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = timed.groupBy(frame.alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def stream_sessions(events: DataFrame, actor: str, ts: str, gap: str = "60 minutes", lateness: str = "0 seconds") -> DataFrame:
    """Activity sessions per actor; the same code is its batch twin."""
    timed = events.withWatermark(ts, lateness) if events.isStreaming else events
    counted = timed.groupBy(actor, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return counted.select(actor, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def _newest_versions(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """Newest version per bucket of a state folder; at most as many entries as there are buckets."""
    try:
        kept = spark.read.parquet(folder).select("bucket", "version")
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return {}
        raise
    older = kept if below is None else kept.filter(F.col("version") < below)
    return {r["bucket"]: r["version"] for r in older.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def stream_latest_state(events: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = 64):
    """Newest event per key under ``folder``; returns the running query.

    Keys are spread over ``buckets`` by hash. A batch writes a new version of the buckets that it touches and leaves the
    others alone; a batch that runs again reads the versions it read before and overwrites its own.
    """
    schema = events.schema

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in placed.select("bucket").distinct().collect()]
        newest = _newest_versions(spark, folder, number)
        paths = [f"{folder}/bucket={b}/version={newest[b]}" for b in touched if b in newest]
        before = spark.read.schema(schema).parquet(*paths) if paths else batch.limit(0)
        before = before.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged = projections.upsert_latest(before, placed, keys, order).withColumn("version", F.lit(number))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(folder)
        placed.unpersist()

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every bucket written by ``stream_latest_state``."""
    paths = [f"{folder}/bucket={b}/version={v}" for b, v in _newest_versions(spark, folder).items()]
    return spark.read.parquet(*paths)


MAX_RETRIES = 5


def notify_step(state: tuple[str, int], outcome: str) -> tuple[str, int]:
    """Fold one delivery outcome: sent is final, a missing set-up costs no retry, a failure costs one of five."""
    status, tries = state
    if status == "sent" or tries >= MAX_RETRIES:
        return state
    if outcome == "sent":
        return "sent", tries
    if outcome == "not_configured":
        return "not_configured", tries
    return "failed", tries + 1


def stream_notify_retry(outcomes: DataFrame, key: str, ts: str, event_id: str, outcome: str, keep_days: int = 40, lateness: str = "0 seconds") -> DataFrame:
    """Status and retries of a result after each of its outcomes, numbered; the state ends ``keep_days`` after the last one."""

    def fold(k: tuple, now: tuple, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        status, tries = notify_step(now[:2], row[1])
        return (status, tries, now[2] + 1), [(k[0], now[2] + 1, status, tries)]

    return in_order(
        outcomes, key, ts, [event_id, outcome], "result_id long, step long, status string, tries long", lambda: ("pending", 0, 0), fold,
        lambda now, last: last + keep_days * 86_400 * MICRO, lateness,
    )


def notify_retry_batch(outcomes: DataFrame, key: str, ts: str, event_id: str, outcome: str) -> DataFrame:
    """The same fold over a finite table, without a sequential pass.

    What counts is the first "sent" and the fifth failure: everything before the earlier of the two applies.
    """
    from vetloom.plans import scans

    failed = (F.col(outcome) == "failed").cast("bigint")
    run = scans.running_sum(outcomes.withColumn("__f", failed), [key], [ts, event_id], scans.day_chunk(ts), "__f", "__failures")
    place = F.struct(ts, event_id)
    sent = F.min(F.when(F.col(outcome) == "sent", place))
    spent = F.min(F.when(F.col("__failures") >= MAX_RETRIES, place))
    stops = run.groupBy(key).agg(sent.alias("sent"), spent.alias("spent"))
    stop = F.when(F.col("spent").isNull() | (F.col("sent") < F.col("spent")), F.coalesce("sent", "spent")).otherwise(F.col("spent"))
    live = run.join(stops.select(key, stop.alias("stop")), key).filter(F.col("stop").isNull() | (place <= F.col("stop")))
    status = F.max_by(outcome, place)
    return live.groupBy(F.col(key).alias("result_id")).agg(status.alias("status"), F.max("__failures").alias("tries"))


def stream_sanitise(docs: DataFrame, key: str, column: str, names: DataFrame, house: redaction.House, known_roots: Sequence[str] = ()) -> DataFrame:
    """The redaction steps on arriving documents, names included: text and log, no state.

    ``names`` is a static table of a size that travels to the documents (``mentions.DICTIONARY_BYTES``); a larger one is an error.
    """
    if not mentions.is_bounded(names):
        raise ValueError("the dictionary is too large for a stream; redact its documents in batches")
    before, after = redaction.standard_steps(house, known_roots)
    out = docs.withColumn("log", F.array().cast(redaction.LOG_TYPE))
    for step in before:
        out = redaction.run_step(out, column, step)
    out = redaction.redact_names(out, key, column, names, house)
    for step in after:
        out = redaction.run_step(out, column, step)
    return out.withColumn(column, redaction.collapse_tokens(F.col(column), house))


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Drain an append stream into parquet under ``folder`` and read it back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
