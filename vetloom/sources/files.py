"""Accept or reject uploaded files by size, extension and leading bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 10 * 1024 * 1024
ACCEPTED = ["docx", "pdf", "txt", "rtf", "doc", "xlsx", "gdoc", "csv"]
# Leading bytes in hex and the format they mean (fixed values).
LEADING_BYTES = {"504B0304": "docx", "25504446": "pdf", "D0CF11E0": "doc", "7B5C7274": "rtf"}


def triage_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, format, verdict, code`` per file.

    Files over the limit are decided from their metadata; only accepted sizes are opened.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    files = reader.load(path)
    name = F.substring_index(F.col("path"), "/", -1)
    extension = F.lower(F.substring_index(name, ".", -1))
    oversize = files.filter(F.col("length") > MAX_BYTES).select(
        name.alias("path"), F.lit("unknown").alias("format"), F.lit("FILE_TOO_LARGE").alias("code")
    )
    head = F.hex(F.substring(F.col("content"), 1, 4))
    form = F.lit("text")
    for lead, label in reversed(LEADING_BYTES.items()):
        form = F.when(head == lead, label).otherwise(form)
    opened = files.filter(F.col("length") <= MAX_BYTES).select(
        name.alias("path"),
        form.alias("format"),
        F.when(F.col("length") == 0, "EMPTY_FILE")
        .when((extension != "") & ~extension.isin(ACCEPTED), "UNSUPPORTED_FORMAT")
        .otherwise("OK")
        .alias("code"),
    )
    return opened.unionByName(oversize).withColumn("verdict", F.when(F.col("code") == "OK", "accept").otherwise("reject"))
