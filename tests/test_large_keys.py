"""Folds and chains of keys that are larger than a task against the row by row rule; long texts in linear time."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from vetloom.operators import review as V
from vetloom.operators import windows as W
from vetloom.plans import folds


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(folds, "TASK_ROWS", 64)


def hits(rng, users):
    rows, key = [], 0
    for user in users:
        at = 1_700_000_000_000_000
        for _ in range(rng.choice((20, 400, 900))):
            key += 1
            at += rng.choice((0, 1, 1_000, 900_000, 3_000_000, 20_000_000 if user == 2 else 2_000_000))
            rows.append((user, key, at))
    rng.shuffle(rows)
    return rows


def sliding(rows, n, width):
    out, kept = {}, {}
    for user, key, at in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        window = kept.setdefault(user, deque())
        while window and window[0] <= at - width:
            window.popleft()
        out[key] = len(window) < n
        if out[key]:
            window.append(at)
    return out


def fixed(rows, n, width):
    out, state = {}, {}
    for user, key, at in sorted(rows, key=lambda r: (str(r[0]), r[2], r[1])):
        opened, seen = state.get(user, (None, 0))
        opened, seen = (at, 1) if opened is None or at - opened > width else (opened, seen + 1)
        state[user], out[key] = (opened, seen), seen <= n
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_rate_limits_of_keys_without_a_pause(spark, small_tasks, seed):
    rng = random.Random(seed)
    rows = hits(rng, [1, 2, 3, None])
    events = spark.createDataFrame(rows, "user_id int, event_id long, us long").withColumn("ts", F.timestamp_micros("us")).drop("us")
    got = {r.event_id: r.accepted for r in W.rate_limit_sliding(events, ["user_id"], "ts", "event_id", n=5, seconds=10).collect()}
    assert got == sliding(rows, 5, 10_000_000)
    got = {r.event_id: r.accepted for r in W.rate_limit_fixed(events, ["user_id"], "ts", "event_id", n=4, seconds=10).collect()}
    assert got == fixed(rows, 4, 10_000_000)


def test_saves_of_a_large_tangled_attempt(spark, small_tasks):
    rng = random.Random(2)
    rows, key = [], 0
    for attempt in (1, 2, 3):
        for _ in range((300, 500, 30)[attempt - 1]):
            key += 1
            rows.append((attempt, key, 1_700_000_000 + rng.randrange(2_000), rng.randrange(0, 12), 1_700_001_900))
    saves = spark.createDataFrame(rows, "attempt_id int, save_id int, a long, expected_revision long, e long")
    saves = saves.select("attempt_id", "save_id", F.timestamp_seconds("a").alias("arrival"), "expected_revision", F.timestamp_seconds("e").alias("expires_at"))
    want = set()
    for attempt in (1, 2, 3):
        revision = 0
        for _, save, arrival, expected, end in sorted((r for r in rows if r[0] == attempt), key=lambda r: (r[2], r[1])):
            if arrival < end and expected == revision:
                revision += 1
                want.add((attempt, save, revision))
    assert {tuple(r) for r in W.accepted_saves(saves).collect()} == want and len(want) > 10


def plain_reflow(text):
    from vetloom.functions import patterns as R

    done = ""
    for i, line in enumerate(text.split("\n")):
        last = done.split("\n")[-1]
        numbered = last[:1].isdigit() and (last.split(" ")[0].rstrip(".)") != last.split(" ")[0]) and last.split(" ")[0][:-1].isdigit()
        joins = i and line[:1].islower() and line[:1].isascii() and last and last[-1] not in ".!?;:" and not numbered
        joins = joins and " ".join(last.lower().split()) not in R.BRIEF_HEADINGS
        done = line if not i else done + (("" if last.endswith("-") else " ") if joins else "\n") + line
    return done


def test_reflow_equals_line_by_line_joining(spark):
    rng = random.Random(9)
    pool = ["How", "how to", "apply", "to apply", "requirements", "1. item", "2) thing", "goes on", "ends.", "hyphen-", "", "Upper", "what", "we offer", "é start"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.choice((1, 3, 12)))) for _ in range(300)] + ["", "how to\napply\nnow"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.o for r in docs.select("i", V.reflow_lines(F.col("t")).alias("o")).collect()}
    assert got == {i: plain_reflow(t) for i, t in enumerate(texts)}
    long = spark.createDataFrame([("\n".join(["this line goes on"] * 50_000),)], "t string")
    start = time.time()
    assert long.select(F.length(V.reflow_lines(F.col("t"))).alias("n")).first().n == 50_000 * 18 - 1
    assert time.time() - start < 60
