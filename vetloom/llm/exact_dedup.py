"""Exact dedup against a persistent digest index, in DataFrame functions only.

Two texts are equal if they are identical once every run of blanks (space, tab to carriage return) is one space; a null
text counts as empty. The index holds one entry per different text: its SHA-256 digest and the row that stays. It is a
Parquet table that is bucketed and sorted by the digest, in a folder that outlives the session.

Documents come in deliveries. A delivery is reduced to one row per digest (partial aggregates first, so a text that a
third of all rows share leaves every task as one row), meets the index in a sort-merge anti-join, and what the index
doesn't hold is appended in the index's buckets. A delivery that a lost driver repeats finds its own name in the index and
appends nothing. ``compact`` writes one sorted file per bucket again after many deliveries.

Of equal texts of one delivery the row of the smallest id stays; a null id is larger than every id; rows of one id are
settled by ``uid``. An entry of an earlier delivery stays, whatever the ids of later ones. Repeated rows are copies of each
other: one stays. An empty table delivers nothing. Texts of any length are digested whole; other columns are carried
inside one struct, so their names can't clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetloom.llm.shared import stored
from vetloom.session import checkpoint_dir

#: A digest of more than one row in ``COMMON`` is joined by broadcast; there are fewer than ``COMMON`` such digests.
COMMON = 2_000
KEY = ("none", "id", "uid")


def digest(text: str | Column) -> Column:
    """SHA-256 of the text with every run of blanks as one space."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str, text_col: str, uid: Column) -> DataFrame:
    """``none, id, uid, digest`` of every row; ``uid`` tells rows of one id apart."""
    return docs.select(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), uid.alias("uid"), digest(text_col).alias("digest"))


class DigestIndex:
    """The index in ``path``; opened if the folder holds one (of as many buckets), started otherwise.

    As many buckets as shuffle partitions, the default, let a delivery meet the index without moving the index.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.path, self.id_type, self.buckets = spark, path, id_type, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"create table {self.table} (digest binary, none boolean, id {id_type}, uid bigint, delivery string) using parquet "
            f"options (compression 'zstd') clustered by (digest) sorted by (digest) into {buckets} buckets location '{path}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, rows: DataFrame, delivery: str) -> None:
        """Append the digests of ``rows`` that no delivery brought before; nothing if this delivery is in the index."""
        if not self.read().where(F.col("delivery") == delivery).isEmpty():
            return
        firsts = rows.groupBy("digest").agg(F.min(F.struct(*KEY)).alias("first"))
        fresh = firsts.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", "first.*", F.lit(delivery).alias("delivery"))
        placed = fresh.repartition(self.buckets, "digest")
        placed.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.table)

    def compact(self, path: str) -> DigestIndex:
        """The same entries in a new folder, one sorted file per bucket."""
        other = DigestIndex(self.spark, path, self.id_type, self.buckets)
        placed = self.read().repartition(self.buckets, "digest")
        placed.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(other.table)
        return other


def judge(index: DigestIndex, rows: DataFrame) -> DataFrame:
    """``rows`` with ``keep_id`` and ``keep_uid`` of the entry of their digest, and ``group_size`` among ``rows``.

    The few digests that many rows share meet them by broadcast, all others by a sort-merge join on the digest.
    """
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    entry = index.read().select("digest", F.col("id").alias("keep_id"), F.col("uid").alias("keep_uid"))
    classes = stored(sizes.join(entry.hint("merge"), "digest"))
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    common = classes.where(F.col("group_size") * COMMON > total)
    met = rows.join(F.broadcast(common), "digest")
    others = rows.join(F.broadcast(common.select("digest")), "digest", "left_anti")
    return met.unionByName(others.join(classes.where(F.col("group_size") * COMMON <= total).hint("merge"), "digest"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row, through an index of its own.

    The rows come in two deliveries, the lower half of the id range first; so the entry of a text is its smallest id.
    """
    spark = docs.sparkSession
    rows = stored(digests(docs, id_col, text_col, F.monotonically_increasing_id()))
    index = DigestIndex(spark, f"{checkpoint_dir(spark)}/digests-{uuid.uuid4().hex}", rows.schema["id"].dataType.simpleString(), buckets)
    low, high = rows.agg(F.min("id"), F.max("id")).first()
    if isinstance(rows.schema["id"].dataType, T.IntegralType) and low is not None:
        first = F.coalesce(F.col("id") <= (low + high) // 2, F.lit(False))
        index.add(rows.where(first), "lower ids")
        index.add(rows.where(~first), "upper ids")
    else:
        index.add(rows, "all")
    judged = judge(index, rows)
    kept = (F.col("uid") == F.col("keep_uid")).alias("kept")
    return judged.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def new_documents(index: DigestIndex, docs: DataFrame, delivery: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, every column as it is, that the index takes from this delivery: one per text that is new.

    Rows of one id and one text are told apart by a hash of the whole row; of wholly equal rows one stays.
    """
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    whole = F.xxhash64(*[F.col(f"row.{c}") for c in plain])
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col(f"row.{id_col}").alias("key"), F.col(f"row.{text_col}").alias("body"))
    keyed = keyed.select("row", F.col("key").isNull().alias("none"), F.col("key").alias("id"), whole.alias("uid"), digest("body").alias("digest"))
    index.add(keyed.drop("row"), delivery)
    once = F.row_number().over(Window.partitionBy("digest", *KEY).orderBy("uid"))
    single = keyed.withColumn("copy", once).where("copy = 1").drop("copy")
    taken = index.read().where(F.col("delivery") == delivery)
    on = (single["digest"] == taken["digest"]) & (single["uid"] == taken["uid"]) & single["id"].eqNullSafe(taken["id"])
    return single.join(taken, on, "left_semi").select("row.*")
