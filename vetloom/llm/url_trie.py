"""URL filters: a trie over reversed host labels and, below each host, over path segments.

Among the allow and block entries that fit a url (same host or a subdomain of it, and a path that starts with the entry's)
the longest wins; of two entries for one host and path, block. A url that no entry fits gets the default verdict.

The trie is broadcast while the entries are within ``most`` (their number is checked first). A longer list stays a table:
each url emits its host suffixes and path folders, which join the entries by equality; results are the same.

A null url, or one without ``://``, has an empty host and path, which no entry fits. Empty host labels are labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.llm.shared import bounded_batches

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWERED)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nested dicts: a host node has children by label and, under None, a path node; a path node has children by segment
    and, under None, its entries: the text left over behind the last slash, with host, path and verdict."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in entries:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *folders, tail = path.split("/")
            for segment in folders:
                node = node.setdefault(segment, {})
            held = node.setdefault(None, {})
            if held.get(tail, (host, path, ""))[2] != "block":
                held[tail] = (host, path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str, str] | None:
        """The longest entry that fits, by code points of host and path, then of host."""
        best, size = None, (-1, -1)
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get(None)
            for segment in segments:
                if below is None:
                    break
                for tail, entry in below.get(None, {}).items():
                    if segment.startswith(tail):
                        length = (len(entry[0]) + len(entry[1]), len(entry[0]))
                        if length > size:
                            best, size = entry, length
                below = below.get(segment)
        return best


def judge(
    pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most: int = 200_000
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; ``entries`` has ``host, path, verdict``."""
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    listed = entries.select("host", "path", "verdict").where("host is not null and path is not null and verdict in ('allow', 'block')")
    held = [tuple(r) for r in listed.limit(most + 1).collect()]
    if len(held) > most:
        return _judge_by_join(urls, listed, default)
    return _judge_by_trie(urls, Trie(held), default)


def _judge_by_trie(urls: DataFrame, trie: Trie, default: str) -> DataFrame:
    bounded_batches(urls.sparkSession, 10_000)
    share = urls.sparkSession.sparkContext.broadcast(trie)
    kind = urls.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [share.value.find(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rules = pa.array([f and f[0] + f[1] for f in found], pa.string())
            verdicts = pa.array([f[2] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rules, verdicts], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _judge_by_join(urls: DataFrame, entries: DataFrame, default: str) -> DataFrame:
    """The same by equality of host suffix and folder; each different host and path is judged once."""
    asked = urls.select("host", "path").distinct()
    labels, parts = F.split("host", r"\.", -1), F.split("path", "/", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))
    keyed = asked.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(folders))
    known = entries.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block after allow
    known = known.select(F.col("host").alias("suffix"), F.col("path").alias("entry"), "verdict", F.regexp_replace("path", "(?s)/[^/]*$|^[^/]*$", "").alias("folder"))
    fits = keyed.join(known, ["suffix", "folder"]).where(F.col("path").startswith(F.col("entry")))
    best = F.max(F.struct((F.length("suffix") + F.length("entry")).alias("size"), F.length("suffix"), F.concat("suffix", "entry").alias("rule"), "verdict"))
    ruled = fits.groupBy("host", "path").agg(best.alias("best"))
    out = urls.join(ruled, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
