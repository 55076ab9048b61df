"""Declared schemas and a lazy handle on the input tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table with its declared schema, so no file is opened to infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def read_tables(spark: SparkSession, directory: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Load the named tables (all of them by default)."""
    return {name: read_table(spark, directory, name) for name in (names or SCHEMAS)}


class Tables:
    """Attribute access to tables and derived views: ``t.orders``, ``t.responses_v``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        from vetloom.sources import views

        if name in SCHEMAS:
            frame = read_table(self.spark, self.directory, name)
        elif name in views.BUILDERS:
            frame = views.BUILDERS[name](self)
        elif name in views.SHARED_SQL:
            frame = views.from_sql(self, views.SHARED_SQL[name], views.HEAVY.get(name, ()))
        else:
            raise AttributeError(name)
        self.__dict__[name] = frame
        return frame
