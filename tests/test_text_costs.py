"""Cheap tests before patterns change no result; cells and records are read once and by all cores."""

import random
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from vetloom.catalog.scalars import cell_pairs
from vetloom.functions import amounts as A
from vetloom.functions import patterns as R
from vetloom.functions import text as X
from vetloom.operators import mentions as M
from vetloom.operators import redaction as D
from vetloom.operators import review as V
from vetloom.operators import sets as S
from vetloom.operators import windows as W

TEXTS = [
    "Mail: Jobs@corp.co.za, call 082 123 4567 or +44 20 7946 0958", "APPLY HERE: https://x.com/apply/1\napply  online today", "Visit acme.co.za, see the website widgetco.com",
    "Hiring  Manager: John Smith, head\nContact Person: Mary Jones", "REF: abc-12 and Job Code # 77aa", "12 Long Street, Harbour 8001", "VAT No: 4123456789, 2010/123456/07",
    "ID No: 8001015009087", "Internal  Notes:\nBudget 5\n\nRequirements\nx", "North  Star", "plain words only", "", None, "a\u0001b@c.de \u0001", "é-b.com _-x.com Internal Note\u0001s",
]


def test_a_boundary_before_a_word_is_one_look():
    assert X.regex(r"\bref\s*\d{2}\b") == r"(?<!\w)ref\s*\d{2}" + X.ASCII_BOUNDARY
    assert X.regex(r"\b((?:hr\s+contact|recruiter)[:-])") == r"(?<!\w)((?:hr\s+contact|recruiter)[:-])"
    for general in (r"\b(?:[a-z-]+\.)+x", r"\bx?-", r"\b(?:a|-)b", r"\b(?:ab)?-", r"a\b-", r"\b\s"):
        assert X.ASCII_BOUNDARY in X.regex(general)
    rng = random.Random(3)
    patterns = [p for v in vars(R).values() for p in (v if isinstance(v, list) else [v]) if isinstance(p, str) and r"\b" in p]
    for text in [t for t in TEXTS if t] + ["".join(rng.choice("ref: 0123-é_Vat No") for _ in range(60)) for _ in range(200)]:
        for p in patterns:
            full = re.compile(p.replace(r"\b", X.ASCII_BOUNDARY), re.ASCII)
            assert [m.span() for m in full.finditer(text)] == [m.span() for m in re.compile(X.regex(p), re.ASCII).finditer(text)], p


def test_a_step_that_is_not_due_would_change_nothing(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t) for i, t in enumerate(TEXTS)], "doc_id int, text string").withColumn("log", F.array().cast(D.LOG_TYPE))
    before, after = D.standard_steps(D.House())
    for step in before + after:
        assert step.due is not None
        always = D.Step(step.name, step.log, step.apply)
        assert sorted(D.run_step(docs, "text", step).collect()) == sorted(D.run_step(docs, "text", always).collect()), step.name


def test_patterns_run_once_for_the_log_and_the_text(spark):
    docs = spark.createDataFrame([(1, "mail a@b.de, see www.x.com\nor 082 123 4567")], "doc_id int, text string")
    for step, pattern in ((D.emails, R.EMAIL), (D.urls, R.URL), (D.bare_domains, R.BARE_DOMAIN), (D.apply_phrases, R.APPLY_PHRASE), (D.phones, R.PHONE_LOCAL)):
        plan = D.redact(docs, "text", step(D.House()))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(X.regex(pattern)) == 1, step.__name__


def test_what_is_not_due_by_the_own_contact_stays(spark):
    """Steps pass over the house's own contact and over lines without a sign of a match, and change what they changed before."""
    contact = D.House().contact
    near = ["", "x.com", "www.", "_", ".com", "-", "/b.org", "1-y.net", "\n", "é"]
    texts = [*TEXTS, *(f"{a}{c}{b}" for a in near for b in near for c in (contact.upper(), "z@own.site.com", ".")), "do not\nshare\nx", "Do  not share:\nx\n\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(2).withColumn("log", F.array().cast(D.LOG_TYPE))
    for house in (D.House(), D.House(contact="com@own.site.com", own="own.site.com")):
        for step in (D.urls(house), D.bare_domains(house)):
            always = D.Step(step.name, step.log, step.apply)
            assert sorted(D.run_step(docs, "text", step).collect()) == sorted(D.run_step(docs, "text", always).collect()), (house, step.name)


def test_a_text_that_a_pass_leaves_alone_is_done(spark):
    docs = spark.createDataFrame([(1, "a  b ,\r\nc"), (2, "done"), (3, None)], "id int, text string")
    out = V.review_text(docs, "text")
    assert out.columns == ["id", "text"] and {r.id: r.text for r in out.collect()} == {1: "a b, c", 2: "done", 3: None}
    assert "__open" in V.review_text(docs, "text")._jdf.queryExecution().analyzed().toString()


def test_a_log_that_is_read_twice_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    log = spark.createDataFrame([(i % 3, i) for i in range(30)], "category int, id int").mapInArrow(rows, "category int, id int")
    got = W.top_per_category(log, "category", ["id"], 2).collect()
    assert sorted((r.category, r.id, r.position, r.total) for r in got) == [(c, c + 3 * p, p + 1, 10) for c in range(3) for p in range(2)]
    assert made.value == 30


def test_workers_hold_few_texts_at_a_time():
    import pyarrow as pa

    batch = pa.record_batch({"t": ["x"] * (2 * M.SLICE_ROWS + 1)})
    assert [p.num_rows for p in M._small(batch)] == [M.SLICE_ROWS, M.SLICE_ROWS, 1]


def test_each_cell_is_typed_once_for_all_its_pairs(spark, tables):
    pairs = cell_pairs(tables).select("lc", "rc", A.cell_equal(F.col("a"), F.col("b")).alias("same"))
    above, below = pairs._jdf.queryExecution().optimizedPlan().toString().split("Generate", 1)
    assert r"^-?\d+" not in above and r"^-?\d+" in below
    assert pairs.groupBy("lc", "rc").count().count() == 8


def test_records_lie_on_all_cores(tables):
    assert tables.records_v.rdd.getNumPartitions() >= tables.spark.sparkContext.defaultParallelism


def test_a_fingerprint_is_the_digest_of_all_cells(spark):
    import hashlib

    cells = spark.createDataFrame([(1, "S", "B", 2, " Y "), (1, "S", "A", 1, "x")], "workbook_id int, sheet string, col string, row_no int, text string")
    assert S.content_fingerprint(cells).first().fingerprint == hashlib.sha256(b"s!a1=x\ns!b2=y").hexdigest()


def test_a_fingerprint_holds_every_cell_of_the_table(spark, tmp_path):
    """Orders that differ in column A or in a formula alone, or in cells without a text, are not the same workbook."""
    import hashlib

    import duckdb

    from vetloom.catalog import load_all
    from vetloom.catalog.registry import QUERIES, check_sql
    from vetloom.sources.tables import SCHEMAS

    load_all()
    keys = [(1, 1), (2, 1), (3, 5), (20, 1), (21, None), (None, 1)]  # part 5 changes A alone, order 20 E alone
    rows = [(order, part, 1, 1, 2.0, 1.0, 0.0, 0.0, "N", "O", None) for order, part in keys]
    spark.createDataFrame(rows, SCHEMAS["lineitem"]).write.parquet(f"{tmp_path}/lineitem.parquet")
    query = QUERIES["content_fingerprint"]
    got = {r.workbook_id: (r.fingerprint, r.copies, r.first_workbook) for r in query(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.sql(check_sql(query.sql)).fetchall()}
    assert got == want
    assert {k: v[1] for k, v in got.items()} == {1: 3, 2: 3, 3: 1, 20: 1, 21: 1, None: 3}
    formula = "=$e$2+sum(b1:b3)*data!a1+a41+rate1*log10(c2)+\"d4\""
    cells = f"data!a1=p1\ndata!b1=2\ndata!c1=n\ndata!d1=note\ndata!e1={formula}"
    assert got[1][0] == hashlib.sha256(cells.encode()).hexdigest()


def test_a_cell_without_a_place_or_a_text_counts(spark):
    schema = "workbook_id int, sheet string, col string, row_no int, text string"
    rows = [(1, "S", "A", 1, "x"), (2, "S", "A", 1, "x"), (2, None, "A", 1, "x"), (3, "S", "A", 1, "x"), (3, "S", None, None, "y"), (4, "S", "A", 1, "x"), (4, "S", "B", 1, None)]
    assert len({r.fingerprint for r in S.content_fingerprint(spark.createDataFrame(rows, schema)).collect()}) == 4
