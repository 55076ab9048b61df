"""WARC archives: one transaction per page written, and transactions assembled from archives.

``write_archives`` writes request, response or revisit, and metadata records, each a gzip member, into archives of bounded
size in a shared folder, and returns the list of the archives of successful tasks. Of pages with equal payloads the one
with the largest id holds the payload; the others, if the payload has ``least`` bytes or more, are revisits that refer to it.

``read_records`` reads archives record by record. ``assemble`` joins request and metadata records to their response or
revisit through WARC-Concurrent-To, whichever of the two names the other, and gives one nested row per capture; of several
requests or metadata records of a capture the one with the smallest record id is taken, and their numbers are returned.

A null payload counts as empty, a null url is left out, and a null page id is larger than none: a page without id holds a
payload only if no page with an id does. Repeated rows get records of their own, numbered apart; those of the largest id
all hold the payload. A capture without request or metadata, and a record that names a missing capture, still give a row
with null for what is missing; a request or metadata record that nothing names and that names nothing gives none.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from gzip import GzipFile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetloom.llm.shared import bounded_batches, cut, stored
from vetloom.session import checkpoint_dir

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed at this size.
ARCHIVE_BYTES = 64 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _planned(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Pages with the id of the page that holds their payload (null: themselves) and a number among equal rows."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    who = F.coalesce(F.concat(F.lit("="), F.col("page_id").cast("string")), F.lit(""))
    keyed = named.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"), who.alias("who"))
    holders = keyed.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
    light = keyed.select("page_id", "who", "digest", "size").where(F.col("size") >= least)
    revisits = light.join(holders, "digest").where("holder is not null and not (page_id <=> holder)").select("who", "digest", "holder").distinct()
    # join and window share their keys, so payloads are shuffled once
    told = keyed.join(revisits, ["who", "digest"], "left")
    return told.withColumn("copy", F.row_number().over(Window.partitionBy("who", "digest").orderBy("who", "digest")))


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), *headers, ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(b"".join((VERSION, b"\r\n", head, b"\r\n", block, b"\r\n\r\n"))) + packer.flush()


def _capture_id(page_id, digest: str, copy: int) -> str:
    return f"urn:capture:{'none' if page_id is None else page_id}:{digest[:16]}:{copy}"


def _transaction(page_id, url: str | None, payload: bytes, digest: str, holder, copy: int, when: str, level: int) -> bytes:
    """Request, response or revisit, and metadata of one page."""
    name = _capture_id(page_id, digest, copy)
    target = [("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []
    common = [*target, ("WARC-Date", when)]
    link = [("WARC-Concurrent-To", f"<{name}:response>")]
    host, _, rest = (url or "").partition("://")[2].partition("/")
    asked = f"GET /{rest.partition('#')[0]} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    answered = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    held = [*common, ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"), ("Content-Type", "application/http; msgtype=response")]
    if holder is not None:
        held += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_capture_id(holder, digest, 1)}:response>")]
    fields = "" if page_id is None else f"page-id: {page_id}\r\n"
    return b"".join(
        (
            _record("request", f"{name}:request", [*common, *link, ("Content-Type", "application/http; msgtype=request")], asked, level),
            _record("response" if holder is None else "revisit", f"{name}:response", held, answered + (payload if holder is None else b""), level),
            _record("metadata", f"{name}:metadata", [*common, *link, ("Content-Type", "application/warc-fields")], fields.encode(), level),
        )
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least: int = 0, when: str = "1970-01-01T00:00:00Z", level: int = 1,
) -> DataFrame:
    """``path`` of the archives written into ``folder``, which all executors share (the checkpoint folder by default).

    Each task names its archives anew, so a task that is run twice leaves files that nobody lists, and no double records.
    """
    spark = pages.sparkSession
    bounded_batches(spark, 200)
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    columns = _planned(pages, id_col, url_col, html_col, least).select("page_id", "url", "payload", "digest", "holder", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, paths, size = None, [], 0
        for batch in batches:
            for row in zip(*batch.columns):
                data = _transaction(*(x.as_py() for x in row), when, level)
                if out is None or size + len(data) > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    paths.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{paths[-1]}", compression=None), 0
                    out.write(_record("warcinfo", f"urn:archive:{paths[-1]}", [("WARC-Date", when), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{p}" for p in paths], pa.string())})

    return cut(columns.mapInArrow(run, "path string"))


def parse(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case, values in order) and block of each record of an archive."""
    with GzipFile(fileobj=stream) as plain:
        while line := plain.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:60]!r}")
            headers: dict[str, list[str]] = {}
            while (line := plain.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers.setdefault(name.strip().lower(), []).append(value.strip())
            yield headers, plain.read(int(headers["content-length"][0]))


RECORD = (
    "record_id string, kind string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, "
    "payload_bytes long, fields map<string,string>, payload binary"
)


def _described(headers: dict[str, list[str]], block: bytes, with_payload: bool) -> dict:
    one = lambda name: headers.get(name, [None])[0]
    bare = lambda uri: uri and uri.strip("<>")
    kind = one("warc-type")
    row = {
        "record_id": bare(one("warc-record-id")), "kind": kind, "concurrent_to": [bare(x) for x in headers.get("warc-concurrent-to", [])],
        "refers_to": bare(one("warc-refers-to")), "target_uri": one("warc-target-uri"), "payload_digest": None, "payload_bytes": None,
        "fields": None, "payload": None,
    }
    head, _, body = block.partition(b"\r\n\r\n")
    if kind == "response":
        row |= {"payload_digest": base32_sha1(body), "payload_bytes": len(body), "payload": body if with_payload else None}
    elif kind == "revisit":  # the block has the HTTP headers of the full payload only
        sizes = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        row |= {"payload_digest": (one("warc-payload-digest") or "").rpartition(":")[2] or None, "payload_bytes": int(sizes[0]) if sizes else None}
    elif kind == "metadata":
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n") if line)
        row["fields"] = [(k.strip(), v.strip()) for k, _, v in pairs]
    elif kind == "request":
        row["fields"] = [("request", head.split(b"\r\n", 1)[0].decode("utf-8", "replace"))]
    return row


def read_records(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in column ``path``; an archive is read by one task, record by record."""
    schema = pa.schema(
        [
            ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
            ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
            ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = pafs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
                    for headers, block in parse(stream):
                        rows.append(_described(headers, block, with_payload))
                        size += len(block) if with_payload else 1_000
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture`` (response or revisit), ``request``, ``metadata``, ``n_requests``, ``n_metadata``.

    Every record goes to the capture it is or names; requests and metadata that a capture names join it first. ``records``
    is read three times; store it first if it is dear. Records of one id count as one.
    """
    held = F.col("kind").isin("response", "revisit")
    named = F.array_distinct("concurrent_to")
    whole = F.struct(*[c for c in records.columns if c != "fields"])
    brief = F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields"))
    known = records.where(held | F.col("kind").isin("request", "metadata"))
    parts = known.select(
        F.explode(F.when(held, F.array("record_id")).otherwise(named)).alias("link"), "kind", F.when(held, whole).alias("capture"), F.when(~held, brief).alias("brief")
    )
    naming = records.where(held & (F.size("concurrent_to") > 0)).select(F.explode(named).alias("other_id"), F.col("record_id").alias("link"))
    others = known.where(~held).select(F.col("record_id").alias("other_id"), "kind", "concurrent_to", brief.alias("brief"))
    back = naming.join(others, "other_id").where("not array_contains(concurrent_to, link)")
    back = back.select("link", "kind", F.lit(None).cast(parts.schema["capture"].dataType).alias("capture"), "brief")
    is_request, is_metadata = F.col("kind") == "request", F.col("kind") == "metadata"
    together = parts.union(back).groupBy("link").agg(
        F.min("capture").alias("capture"), F.min(F.when(is_request, F.col("brief"))).alias("request"), F.min(F.when(is_metadata, F.col("brief"))).alias("metadata"),
        F.count_if(is_request).alias("n_requests"), F.count_if(is_metadata).alias("n_metadata"),
    )
    return together.drop("link")


def page_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages as archives, reads these back and returns one row per page."""
    id_type = pages.schema[id_col].dataType
    records = stored(read_records(write_archives(pages, None, id_col, url_col, html_col, least)).drop("payload"))
    whole = assemble(records)
    page = F.filter("metadata.fields", lambda f: f["key"] == "page-id")
    holder = F.nullif(F.regexp_extract("capture.refers_to", r"^urn:capture:(.*):[0-9a-f]{16}:[0-9]+:response$", 1), F.lit(""))
    return whole.select(
        F.get(page, F.lit(0))["value"].cast(id_type).alias("page_id"), F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"), F.col("capture.kind").alias("record_type"),
        holder.cast(id_type).alias("refers_to"), F.col("capture.target_uri").alias("target_uri"),
        F.get(F.col("request.fields"), F.lit(0))["value"].alias("request_line"),
    )
