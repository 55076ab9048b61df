"""Every query of the operators against its check SQL, where it has one."""

import duckdb
import pytest

from parity import oracle, rows_of
from vetloom.llm.queries import ORACLE_SQL, QUERIES

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DIRECTORY).toPandas()
    if name not in ("op11_bloom_search", "op13_prefix_trie"):  # one row per row of the table
        table = "pages" if name[:4] in ("op2_", "op3_") else "documents"
        assert len(got) == duckdb.execute(f"select count(*) from '{DIRECTORY}/{table}.parquet'").fetchone()[0]
    if name in ORACLE_SQL:
        want = oracle(DIRECTORY).sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
