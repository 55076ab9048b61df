"""Lookups over tables of any size against a plain search, and scans over range partitions."""

import random

import pytest
from pyspark.sql import functions as F

from vetloom.operators import sets as S
from vetloom.operators import workbook as B
from vetloom.plans import scans
from vetloom.plans.spread import looked_up


def typed(text):
    text = text or ""
    plain = text.replace(",", "").strip()
    try:
        number = float(plain) if plain.lstrip("-").replace(".", "", 1).isdigit() and not plain.startswith(".") and not plain.endswith(".") else None
    except ValueError:
        number = None
    if text == "":
        return ("blank", None)
    if text.startswith("#"):
        return ("error", text)
    if number is not None:
        return ("number", number)
    return ("boolean", text.upper()) if text.upper() in ("TRUE", "FALSE") else ("text", text.upper())


def plain_search(rows, key, kind):
    """Row number, key and value that a spreadsheet finds; None for none."""
    wanted, rows = typed(key), sorted(rows)
    errors = [r for r in rows if typed(r[1])[0] == "error"]
    if kind:
        hits = [r for r in rows if typed(r[1])[0] == wanted[0] not in ("blank", "error") and typed(r[1])[1] <= wanted[1]]
        return errors[0] if errors else hits[-1] if hits else None
    same = ("number", 0.0) if wanted[0] == "blank" else wanted
    return next((r for r in rows if typed(r[1])[0] == "error" or (wanted[0] != "error" and typed(r[1]) == same)), None)


@pytest.mark.parametrize("kind", [0, 1])
def test_lookups_equal_a_plain_search(spark, kind):
    rng = random.Random(kind)
    pool = ["1", "2", "2.5", "1,000", "-3", "0", "", None, "a", "B", "b", "true", "FALSE", "zz", "10", " 7"]
    books = {w: [(r, rng.choice(pool + ["#N/A"] * (w % 7 == 3)), f"v{r}") for r in range(1, rng.choice((2, 6, 30)))] for w in range(40)}
    books[999] = [(r, str(rng.randrange(200)), f"v{r}") for r in range(1, 3000)]  # most of all rows
    cells = [(w, "Data", r, c, t) for w, rows in books.items() for r, k, v in rows for c, t in (("A", k), ("B", v))] + [(None, "Data", 1, "A", "1"), (1, "Other", 1, "A", "x")]
    asked = [(w, rng.choice(pool + ["#REF!", "150", "no"])) for w in list(books) * 4 + [12345]] + [(999, str(i % 250)) for i in range(2000)] + [(None, "1"), (999, "5"), (999, "5")]
    keys = spark.createDataFrame(asked, "workbook_id int, wanted string").repartition(5)
    table = B.range_rows(spark.createDataFrame(cells, "workbook_id int, sheet string, row_no int, col string, text string"), "data", "A", "B")

    def shown(hit, value):
        return "#N/A" if hit is None else hit[1] if typed(hit[1])[0] == "error" else value(hit)

    hits = [(w, k, plain_search(books.get(w, []), k, kind)) for w, k in asked]
    got = (B.lookup_approx if kind else B.lookup_exact)(keys, table, "wanted")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((w, k, shown(h, lambda h: h[2])) for w, k, h in hits), key=str)
    got = B.match_position(keys, table, "wanted", kind)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((w, k, shown(h, lambda h: str(h[0]))) for w, k, h in hits), key=str)
    assert B.lookup_exact(keys.limit(0), table, "wanted").count() == 0
    assert {r.found for r in B.lookup_approx(keys, table.limit(0), "wanted").collect()} == {"#N/A"}


def test_prefix_max_carries_over_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice((None, 1, 1, 1, 2)), rng.randrange(300), i, rng.choice((None, rng.randrange(1000)))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, at int, tie int, v int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    try:
        scanned = scans.prefix_max(frame, ["k"], ["at", "tie"], "v", "top").cache()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, top = {}, {}
    for k, at, tie, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        top[k] = max((x for x in (top.get(k), v) if x is not None), default=None)
        want[tie] = top[k]
    assert {r.tie: r.top for r in scanned.collect()} == want
    assert scanned.where("k = 1").select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_looked_up_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "a")] * 500 + [(None, "b"), (2, None), (3, "c")], "k int, t string")
    unique = spark.createDataFrame([(1, "one"), (None, "none"), (3, "three")], "k int, name string")
    got = looked_up(rows, unique, ["k"], share=10).groupBy("k", "t", "name").count().collect()
    assert {tuple(r) for r in got} == {(1, "a", "one", 500), (None, "b", "none", 1), (2, None, None, 1), (3, "c", "three", 1)}


def test_references_are_whole_names(spark):
    formulas = {1: "=A41+LOG10(C2)", 2: "=RATE1*2", 3: '="A1"&B2&"C3"', 4: "=sum($a$1 : b2)+Data!J40", 5: "=A1:XX9", 6: "A1", 7: "=A1.5+B10+Z9", 8: "=Other_1!c4-A01"}
    cells = spark.createDataFrame([(w, "Data", 9, "E", t) for w, t in formulas.items()], "workbook_id int, sheet string, row_no int, col string, text string")
    got = {}
    for r in B.cell_reference_edges(cells).collect():
        got.setdefault(r.workbook_id, set()).add(r.to_ref.split("!")[1] if r.to_ref.startswith("data!") else r.to_ref)
    assert got == {1: {"C2"}, 3: {"B2"}, 4: {"A1", "A2", "B1", "B2", "J40"}, 5: {"A1"}, 7: {"B10"}, 8: {"other_1!C4"}}


def test_fingerprints_ignore_order_and_tell_repeats(spark):
    cells = [(1, "A", 1, "x"), (1, "B", 2, "y"), (2, "B", 2, " Y "), (2, "A", 1, "X"), (3, "A", 1, "x"), (4, "A", 1, "x"), (4, "A", 1, "x"), (4, "B", 2, "y"), (5, "A", 1, None)]
    frame = spark.createDataFrame(cells, "workbook_id int, col string, row_no int, text string").withColumn("sheet", F.lit("S"))
    prints = {r.workbook_id: (r.fingerprint, r.copies, r.first_workbook) for r in S.content_fingerprint(frame).collect()}
    assert prints[1][1:] == prints[2][1:] == (2, 1) and len({p[0] for p in prints.values()}) == 4


def test_reference_edges_meet_once_per_cell_and_sheet(spark):
    rng = random.Random(3)
    texts = ["=A1+B2:C4", "=c4:B2+Data!$a$40", "=Other!J40:A39+a1", "=B2:B2*DATA!B2", "no formula", None, "=1+2", "= A1 : X9"]
    rows = [(rng.choice((1, 2, None)), rng.choice(("Data", "data", "S", None)), rng.choice((1, 2, None)), rng.choice(("A", "b", None)), rng.choice(texts)) for _ in range(300)]
    cells = spark.createDataFrame(rows, "workbook_id int, sheet string, row_no int, col string, text string").repartition(4)
    boxes = {0: [("", 1, 1, 1, 1), ("", 2, 3, 2, 4)], 1: [("", 2, 3, 2, 4), ("data", 1, 1, 40, 40)], 2: [("other", 1, 10, 39, 40), ("", 1, 1, 1, 1)], 3: [("", 2, 2, 2, 2), ("data", 2, 2, 2, 2)], 7: [("", 1, 1, 1, 1)]}
    want = set()
    for w, sheet, r, c, t in rows:
        for to, c1, c2, r1, r2 in boxes.get(texts.index(t), []):
            own = None if sheet is None else sheet.lower()
            for x in range(c1, c2 + 1):
                for y in range(r1, r2 + 1):
                    at = to or own
                    want.add((w, None if None in (own, r, c) else f"{own}!{c.upper()}{r}", at and f"{at}!{chr(64 + x)}{y}"))
    edges = B.cell_reference_edges(cells)
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    shuffles = [x for x in edges._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in x]
    assert shuffles and all("to_ref" not in x for x in shuffles)  # references are expanded after the shuffle


def test_cycles_keep_little_of_what_lies_on_none(spark):
    import os

    from vetloom.session import checkpoint_dir

    def written():
        top = checkpoint_dir(spark).removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(top) for f in files)

    rng = random.Random(4)
    rows = [(w, f"data!E{r}", f"data!{rng.choice('ABCD')}{rng.randint(1, 40)}") for w in range(3000) for r in range(1, 21)]
    rings = [(w, f"data!E{r}", f"data!E{r % 7 + 1}") for w in range(0, 3000, 100) for r in range(1, 8)]
    odd = [(None, "data!E1", "data!E1"), (5, None, "data!E1"), (5, "data!E1", None), (6, "data!E2", "data!E2"), (6, "data!E2", "data!E2"), (7, "data!E1", "data!E2"), (8, "data!E2", "data!E1")]
    edges = spark.createDataFrame(rows + rings + odd, "workbook_id long, from_ref string, to_ref string").repartition(4)
    before = written()
    got = B.cell_cycles(edges)
    spent = written() - before
    assert sorted(map(tuple, got.collect())) == sorted([(w, f) for w, f, _ in rings] + [(6, "data!E2")])
    assert spent < 8 * len(rows)  # edges to cells without formulas end in one compressed table; it was 16 bytes a row
    many = B.BROADCAST_ROWS
    B.BROADCAST_ROWS = 0
    try:
        assert sorted(map(tuple, B.cell_cycles(edges).collect())) == sorted(map(tuple, got.collect()))
    finally:
        B.BROADCAST_ROWS = many


def test_rounds_of_cycles_are_not_broadcast(spark, monkeypatch):
    plans, stored = [], scans.stored

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(scans, "stored", seen)
    ring = [(w, f"data!E{r}", f"data!E{r % 7 + 1}") for w in range(3) for r in range(1, 8)]
    chain = [(9, f"data!E{r}", f"data!E{r + 1}") for r in range(1, 7)]
    got = B.cell_cycles(spark.createDataFrame(ring + chain, "workbook_id long, from_ref string, to_ref string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, f) for w, f, _ in ring)
    rounds = [p for p in plans if "Join" in p and "workbook_id" in p.split("Join", 1)[1].split("]", 1)[0]]
    assert len(rounds) > 3 and not [p for p in rounds if "BroadcastHashJoin [workbook_id" in p]


@pytest.mark.parametrize("kind", [0, 1])
def test_lookups_read_the_table_once(spark, kind):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(k):
        read.add(1)
        return k

    rows = [(w, r, str(r % 9) if w % 50 else "#N/A", f"v{r}") for w in range(200) for r in range(1, 11)]
    table = spark.createDataFrame(rows, "workbook_id int, row_no int, k string, v string").repartition(4).withColumn("k", seen("k"))
    keys = spark.createDataFrame([(w, "4") for w in range(210)], "workbook_id int, wanted string")
    got = {r.workbook_id: r.found for r in B.match_position(keys, table, "wanted", kind).collect()}
    last = "10" if kind else "4"
    assert got == {w: "#N/A" if w >= 200 or w % 50 == 0 else last for w in range(210)}
    assert read.value == len(rows)


def test_prefix_max_cuts_only_large_groups(spark):
    rng = random.Random(6)
    rows = [(rng.choice((None, 1, 1, 1, 2)), rng.randrange(300), i, rng.choice((None, rng.randrange(1000)))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, at int, tie int, v int").repartition(6)
    want, top = {}, {}
    for k, at, tie, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        top[k] = max((x for x in (top.get(k), v) if x is not None), default=None)
        want[tie] = top[k]
    for whole in (1, 1000, 5000):
        assert {r.tie: r.top for r in scans.prefix_max(frame, ["k"], ["at", "tie"], "v", "top", whole).collect()} == want
