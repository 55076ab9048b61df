"""Rules checked on small rows with known answers, and equalities between two ways of computing one thing."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.catalog import load_all
from vetloom.functions import amounts as A
from vetloom.functions import dates as D
from vetloom.functions.text import fold_text
from vetloom.operators import joins as J
from vetloom.operators import notes as N
from vetloom.operators import predicates as P
from vetloom.operators import redaction as R
from vetloom.operators import review as V
from vetloom.operators import scoring as S
from vetloom.operators import windows as W
from vetloom.operators import workbook as B
from vetloom.plans import scans
from vetloom.streaming import jobs as Z

load_all()


def values(df, column):
    return [r[column] for r in df.collect()]


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first()["o"]


def test_amount_spellings(spark):
    cases = {
        "26050": 26050, "R26 050,-": 26050, "R 26,050.00": 26050, "26.050,00": 26050, "(1 200)": -1200, "-R50": -50, "R-50": -50, "twelve": 12,
        "1,5": 1.5, "1.234": 1234, "1,234,567": 1234567, "12'500": 12500, "--5": None, "about 5": None, "1,23,4": None, "": None, "zero.": 0, "50 rand": 50,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", A.parse_amount(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in got.collect()} == cases


def test_half_rounds_up(spark):
    assert [one(spark, lambda c: A.half_up(c), v, "double") for v in (-2.5, 2.5, -0.5)] == [-2, 3, 0]


def test_note_negation(spark):
    said = {
        "We hold it": True, "do not hold it": False, "not only hold it": True, "the household": False, "no refund, hold it": True,
        "never release but hold": True, "without a hold": False,
    }
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", N.has_unnegated(N.normalise_note(F.col("t")), F.lit("hold")).alias("x"))
    assert {r["t"]: r["x"] for r in got.collect()} == said


def test_criterion_without_positive_marker_earns_nothing(spark):
    notes = spark.createDataFrame([(1, 1, "anything"), (2, 1, "hold the refund"), (3, 1, "")], "note_id int, item_id int, note string")
    criteria = spark.createDataFrame(
        [(1, "a", [], [], ["bad"]), (1, "b", ["refund"], ["hold"], [])],
        "item_id int, criterion_id string, all_of array<string>, any_of array<string>, none_of array<string>",
    )
    got = {r["note_id"]: (r["earned"], r["max"], r["blank"]) for r in N.score_note(notes, criteria).collect()}
    assert got == {1: (0, 4, False), 2: (2, 4, False), 3: (0, 4, True)}


def test_best_key_prefers_first_on_ties(spark):
    row = spark.sql("select map('l1','A','l2','O') as c, map('l1','N','l2','O') as k, array(map('l1','A'), map('l1','A')) as alt")
    best = row.select(S.best_key(F.col("c"), F.col("k"), F.col("alt")).alias("b")).first()["b"]
    assert (best["points"], best["variant"]) == (2, 1)


def test_deadline_is_strict(spark):
    rows = spark.sql("""select 1 as attempt_id, 'active' as status, timestamp '2024-01-01 00:20:00' as expires_at, cast(null as timestamp) as closed_at""")
    assert P.open_attempts(rows, "2024-01-01 00:19:59.999").count() == 1
    assert P.open_attempts(rows, "2024-01-01 00:20:00").count() == 0


def test_fourth_start_is_refused(spark):
    rows = spark.range(4).select(F.lit(1).alias("d"), F.lit("x").alias("i"), F.timestamp_seconds("id").alias("ts"), "id")
    assert sorted(values(W.cap_per_identity(rows, ["d", "i"], "ts", "id"), "accepted")) == [False, True, True, True]


def test_spreadsheet_errors_and_criteria(spark):
    cells = spark.createDataFrame(
        [(1, "Data", 1, "A", "x"), (1, "Data", 1, "B", "5"), (1, "Data", 2, "A", "#N/A"), (1, "Data", 2, "B", "7"), (2, "Data", 1, "A", "X"), (2, "Data", 1, "B", "1,000")],
        "workbook_id int, sheet string, row_no int, col string, text string",
    )
    sums = {r["workbook_id"]: (r["total"], r["err"]) for r in B.sum_if(cells, "data", "A", "B", (1, 40), "x").collect()}
    assert sums == {1: (None, "#N/A"), 2: (1000.0, None)}
    keys = spark.createDataFrame([(1, "zzz"), (2, "x")], "workbook_id int, k string")
    found = {r["workbook_id"]: r["found"] for r in B.lookup_exact(keys, B.range_rows(cells, "Data", "A", "B"), "k").collect()}
    assert found == {1: "#N/A", 2: "1,000"}


def test_scans_equal_plain_windows(tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = tables.events.withColumn("user_id", F.when(F.col("user_id") > 5, 1).otherwise(F.col("user_id")))
    plain = events.select("event_id", F.row_number().over(w).alias("rn"), F.lag("value").over(w).alias("p"))
    day = scans.day_chunk("ts")
    ours = scans.lag_columns(scans.number_rows(events, ["user_id"], ["ts", "event_id"], day), ["user_id"], ["ts", "event_id"], day, {"value": "p"})
    assert ours.select("event_id", "rn", "p").exceptAll(plain.withColumn("rn", F.col("rn").cast("bigint"))).count() == 0


def test_confidential_blocks_of_any_length_go_whole(spark):
    block = "Internal notes:\n" + "\n".join(f"line {i} keep this to yourself" for i in range(80))
    docs = spark.createDataFrame([(1, f"Start\n{block}\n\nRequirements\nTwo years"), (2, f"Start\n{block}")], "doc_id int, text string")
    got = {r["doc_id"]: r for r in R.redact(docs, "text", R.confidential_blocks(R.House())).collect()}
    assert got[1]["text"] == "Start\n\nRequirements\nTwo years" and got[2]["text"] == "Start\n"
    assert len(block) > 2_000 and [e["match"] for e in got[1]["log"]] == [block] == [e["match"] for e in got[2]["log"]]


def test_log_keeps_whole_matches_and_counts_them(spark):
    link = "https://jobs.corp.com/" + "a" * 100
    docs = spark.createDataFrame([(1, f"Apply here: {link}x or Apply here: {link}y or Apply here: {link}x")], "doc_id int, text string")
    log = R.redact(docs, "text", R.apply_links(R.House())).first()["log"]
    assert [(e["match"][-1], e["n"]) for e in log] == [("x", 2), ("y", 1)]


def test_null_keys_are_a_group_in_scans(spark):
    rows = spark.createDataFrame([(None, i, 1.0) for i in range(5)] + [(1, i, 2.0) for i in range(3)], "k int, at int, v double")
    block = scans.block_chunk("at", 2)
    done = scans.running_sum(scans.lag_columns(scans.number_rows(rows, ["k"], ["at"], block), ["k"], ["at"], block, {"at": "before"}), ["k"], ["at"], block, "v", "total")
    got = sorted((r["k"] or 0, r["rn"], r["before"], r["total"]) for r in done.collect())
    assert got == [(0, i + 1, i - 1 if i else None, i + 1.0) for i in range(5)] + [(1, i + 1, i - 1 if i else None, 2.0 * i + 2) for i in range(3)]


def test_review_is_idempotent(tables):
    once = V.review_text(tables.damaged_v.unionByName(tables.documents.select("doc_id", "text")), "text")
    twice = V.review_text(once.withColumnRenamed("text", "first").withColumn("text", F.col("first")), "text")
    assert twice.filter("first <> text").count() == 0


def test_wrapped_lines(spark):
    cases = {"e-\ncommerce": "e-commerce", "a line\nand more": "a line and more", "Done.\nnext": "Done.\nnext", "Requirements\ntwo": "Requirements\ntwo", "1. item\nmore": "1. item\nmore", "how to\napply\nnow": "how to apply\nnow"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", V.reflow_lines(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in got.collect()} == cases


def test_redaction_leaves_no_address_or_phone(spark, tables):
    done = R.sanitise_documents(tables.briefs_v, "doc_id", "text", tables.names_v, R.House())
    leaks = done.filter(F.regexp_like("text", F.lit(r"(?i)hr\d+@corp|082 123 \d{4}|John Smith|8001015009087|Budget is 500k")))
    assert leaks.count() == 0


def test_date_ranges(spark):
    cases = {"Jan 2015 - Mar 2018": "January 2015 – March 2018", "01/2015 to 2018-03": "January 2015 – March 2018", "2015 – present": "2015 – present", "none": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", D.parse_date_range(F.col("t"))["text"].alias("o"))
    assert {r["t"]: r["o"] for r in got.collect()} == cases


def test_compatibility_characters_fold_to_plain_ones(spark):
    cases = {"Ｆｕｌｌ　Ｗｉｄｔｈ １２": "full width 12", "ﬁne ﬂow…": "fine flow...", "a\u00a0b – c": "a b - c", "②µ": "2μ"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fold_text(F.col("t")).alias("o"))
    assert {r["t"]: r["o"] for r in got.collect()} == cases
    assert one(spark, N.normalise_note, "Ｈｏｌｄ  it") == "hold it"


def folder_stream(spark, folder, rows, schema):
    """A stream that reads one row per trigger, in the given order; the last row tells the end of the input."""
    folder.mkdir()
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(folder / f"part{i:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))


SAVE = "attempt_id long, save_id long, arrival timestamp, expected_revision long, expires_at timestamp"
at = lambda s: pd.Timestamp(f"2024-01-01 {s}").to_pydatetime()


def test_deadline_stream_closes_an_attempt_once(spark, tmp_path):
    due, later = at("00:20:00"), at("23:00:00")
    rows = [(1, 1, at("00:00:01"), 0, due), (1, 2, at("00:00:02"), 1, due), (2, 3, at("01:00:00"), 0, later), (3, 4, at("01:10:00"), 0, later),
            (1, 5, at("01:30:00"), 2, due), (1, 6, at("02:30:00"), 0, due), (9, 9, at("03:00:00"), 0, later), (9, 10, at("03:10:00"), 0, later)]
    stream = folder_stream(spark, tmp_path / "in", rows, SAVE)
    got = Z.run_to_table(Z.stream_attempt_deadlines(stream), str(tmp_path / "out"))
    assert [(r["attempt_id"], r["status"], r["revision"]) for r in got.collect()] == [(1, "timed_out", 2)]


def test_streams_do_not_depend_on_arrival_order_or_triggers(spark, tmp_path):
    times = [at(f"00:{m:02d}:00") for m in (5, 1, 3, 2, 4, 8, 6, 7, 10, 9)]
    order = sorted(times)
    saves = [(1, order.index(t), t, order.index(t), at("20:00:00")) for t in times] + [(9, 99, at("21:00:00"), 0, at("20:00:00"))]
    late = "30 minutes"
    one = Z.run_to_table(Z.stream_accepted_saves(folder_stream(spark, tmp_path / "a", saves, SAVE), late), str(tmp_path / "a_out"))
    assert sorted((r["save_id"], r["revision"]) for r in one.collect()) == [(i, i + 1) for i in range(10)]
    limit = Z.stream_rate_limit(folder_stream(spark, tmp_path / "b", saves, SAVE), "attempt_id", "arrival", "save_id", 2, 180, late)
    got = {r["event_id"]: r["accepted"] for r in Z.run_to_table(limit, str(tmp_path / "b_out")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True}
    first = Z.stream_first_result(folder_stream(spark, tmp_path / "c", saves, SAVE), "attempt_id", "arrival", ["save_id"], "attempt_id long, save_id long", 40, late)
    assert [(r["attempt_id"], r["save_id"]) for r in Z.run_to_table(first, str(tmp_path / "c_out")).collect()] == [(1, 0)]


def test_latest_state_writes_touched_buckets_only(spark, tmp_path):
    rows = [(1, 10, at("00:01:00")), (2, 11, at("00:02:00")), (1, 12, at("00:00:30")), (1, 13, at("00:03:00"))]
    stream = folder_stream(spark, tmp_path / "in", rows, "user_id long, event_id long, ts timestamp")
    Z.stream_latest_state(stream, str(tmp_path / "state"), ["user_id"], ["ts", "event_id"], str(tmp_path / "check")).awaitTermination()
    got = Z.read_latest_state(spark, str(tmp_path / "state")).collect()
    assert {(r["user_id"], r["event_id"]) for r in got} == {(1, 13), (2, 11)}
    assert len(list((tmp_path / "state").glob("bucket=*/version=*"))) == 4
