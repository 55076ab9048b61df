"""Helpers that several operators use: text as bytes, batches bounded by bytes, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.session import checkpoint_dir

#: A-Z to a-z, every other byte as it is.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of text that one step of a Python operator works on.
STEP_BYTES = 8 << 20
#: Rows of a few numbers each that make a partition worth its files.
PART_ROWS = 50_000


def bounded_batches(spark: SparkSession, rows: int = 1_000, size: str = "16m") -> None:
    """Bound the Arrow batches that Python workers receive, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``data`` (the text's UTF-8 bytes, a null text as empty); no other column is read."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))


def steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Lists of ids and texts of about ``limit`` bytes; a longer text stands alone."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        for key, data in zip(batch.column(0), batch.column(1)):
            data = data.as_py()
            if texts and size + len(data) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(key.as_py())
            texts.append(data)
            size += len(data)
    if texts:
        yield ids, texts


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that lost executors cost no earlier work."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made of about ``rows`` narrow rows, in no more partitions than those and all cores need.

    Every task of a shuffle or checkpoint leaves files of its own, which for rounds on few rows are larger than the rows.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, rows // PART_ROWS + 1))


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a compressed table, for wide rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def met_by_size(rows: DataFrame, classes: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` joined with the one row that ``classes`` has per ``key``; ``size`` there is the number of rows of the key.

    Keys of more than ``limit`` rows, fewer than one in ``limit`` rows, meet by broadcast; the others by a join that spreads them.
    """
    common = classes.where(F.col("size") > limit)
    near = rows.join(F.broadcast(common), key)
    others = rows.join(F.broadcast(common.select(key)), key, "left_anti")
    return near.unionByName(others.join(classes.where(F.col("size") <= limit), key))
