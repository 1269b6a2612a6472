"""WARC archives: written by tasks, read back as records, and assembled into captures.

A page becomes three records: the request, the response (or, where a page of a smaller id has the same payload, a
revisit without it) and metadata.  Request and metadata name their response by WARC-Concurrent-To.  Assembly
joins records through those identifiers, whichever side names the other and also over one record between,
and emits one nested row per capture.  A revisit is resolved, as its profile says, by the payload's digest.

No join here broadcasts: both sides grow with the pages, so all are merge joins, whose hot keys adaptive execution may split.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, remove, shared_dir

DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 1 << 30
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "payload_digest string, payload_bytes long, content_type string, fields map<string,string>, payload binary"
)
_NAMES = [x.split()[0] for x in _RECORD.replace("map<string,string>", "map").split(", ")]


def digest_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode("utf-8")) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _capture(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, first_url: str | None, revisit: bool, number: str, level: int) -> Iterator[bytes]:
    """The records of a page; ``number`` tells it from all other rows, also from those that repeat it."""
    digest = base64.b32encode(sha1).decode()
    uri = None if url is None else _line(url)
    own = _urn("capture", page_id, url, digest, number)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    host = re.sub(r"^[a-z]+://([^/?#]*).*$", r"\1", uri or "", flags=re.DOTALL)
    yield _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _urn("request", own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http; msgtype=request")],
        f"GET {uri or '/'} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode(),
        level,
    )
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    same = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", None if first_url is None else _line(first_url)), ("WARC-Refers-To-Date", DATE)]
    yield _record(
        [*(same if revisit else [("WARC-Type", "response")]), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")],
        block if revisit else block + payload,
        level,
    )
    yield _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _urn("metadata", own)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")],
        "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("payload-bytes", len(payload))) if v is not None).encode(),
        level,
    )


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, level: int = 4) -> DataFrame:
    """Write ``pages`` as gzipped WARC files below ``folder``, and return the manifest ``(file, records, bytes)``.

    The manifest is committed by Spark, so it names only files of successful task attempts; what a lost executor
    left behind is never read.  Of equal payloads of ``least_bytes`` or more those of the smallest id are
    written in full, the others as revisits; a payload without any id is always written in full.  Every row is a capture of its
    own, repeated rows too: identifiers hold the writing task's number and a count of its rows.  Only hashes,
    ids and addresses are grouped; a hot payload meets in partial aggregates and in a join that may be split.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    firsts = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"))
    rows = rows.join(firsts.hint("merge"), "digest", "left").select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "digest", F.col("first.url").alias("first_url"), (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))).alias("revisit"))
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/archives", recursive=True)
        out, name, done = None, "", []
        records = size = 0
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_url", "revisit")), strict=True):
                if out is None:
                    name, records, size = f"archives/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                number += 1
                for data in _capture(*row, f"{part}.{number}", level):
                    out.write(data)
                    records, size = records + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
                    done.append((name, records, size))
        if out is not None:
            out.close()
            done.append((name, records, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "records", "bytes"])

    rows.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The uncompressed records of a gzipped WARC file, member by member."""
    left = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = left or stream.read(1 << 20)
            if not data:
                if parts:
                    raise EOFError("truncated WARC member")
                return
            left = b""
            parts.append(z.decompress(data))
        left = z.unused_data
        yield b"".join(parts)


def _headers(head: bytes) -> tuple[str, dict[str, list[str]]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    found: dict[str, list[str]] = {}
    for line in lines:
        name, _, value = line.partition(":")
        found.setdefault(name.strip().lower(), []).append(value.strip())
    return first, found


def parse_record(data: bytes, with_payload: bool = True) -> tuple:
    """One record as the values of ``_NAMES``.  A response's digest and size are taken from its payload; a revisit's
    from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    _, h = _headers(head)
    block = rest[: int(h["content-length"][0])]
    one = lambda k: h.get(k, [None])[0]
    kind, payload, digest, size, fields = one("warc-type"), None, None, None, None
    if kind in ("response", "revisit"):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "response":
            payload, digest, size = body, digest_base32(body), len(body)
            told = (one("warc-payload-digest") or "").removeprefix("sha1:")
            if told and told != digest:
                raise ValueError(f"payload of {one('warc-record-id')} does not match its digest")
        else:
            digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
            length = _headers(http)[1].get("content-length")
            size = int(length[0]) if length else None
    elif kind == "metadata":
        fields = [(k, v[0]) for k, v in _headers(b"\r\n" + block)[1].items() if k]
    return (one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), h.get("warc-concurrent-to", []), one("warc-refers-to"), digest, size, one("content-type"), fields, payload if with_payload else None)


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the manifest's files.  Files are dealt out as rows; each is read as a stream."""
    folder = folder.rstrip("/")
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        rows.append(parse_record(data, with_payload))
                        size += len(data) if with_payload else 500
                        if size >= 8_000_000:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    spark = manifest.sparkSession
    files = max(1, spark.sparkContext.defaultParallelism * 4)
    return manifest.select("file").repartition(files, "file").mapInArrow(run, _RECORD)


def _anchors(main: DataFrame, other: DataFrame) -> DataFrame:
    """``(record_id, anchor)`` of the ``other`` records: the response or revisit (``main``) that each belongs to, over one or two
    links of either direction; for those that reach none, the smallest identifier among themselves and those they are linked to."""
    named = other.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("a <> b")
    naming = main.select(F.explode("concurrent_to").alias("a"), F.col("record_id").alias("b")).where("a <> b")
    direct = named.join(main.select(F.col("record_id").alias("b")).distinct().hint("merge"), "b").select("a", "b").union(naming)
    near = direct.groupBy(F.col("a").alias("record_id")).agg(F.min("b").alias("anchor"))
    found = cut(other.select("record_id").distinct().join(near.hint("merge"), "record_id", "left"))
    lost = found.where("anchor is null").select("record_id")
    if lost.isEmpty():
        return found
    found = found.where("anchor is not null")
    both = named.union(named.select("b", "a")).union(naming).distinct()
    over = both.join(found.hint("merge"), both.b == found.record_id).select("a", F.lit(2).alias("far"), "anchor")
    alone = both.select("a", F.lit(3).alias("far"), F.least("a", "b").alias("anchor")).union(lost.select("record_id", F.lit(4), "record_id"))
    rest = over.union(alone).groupBy(F.col("a").alias("record_id")).agg(F.min(F.struct("far", "anchor"))["anchor"].alias("anchor"))
    return found.union(lost.join(rest.hint("merge"), "record_id"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, requests, metadata``.

    ``response`` is the response or revisit record (null for records that none claims), ``requests`` and
    ``metadata`` are arrays, ordered by identifier.  A record without an identifier is left out; records that
    repeat an identifier count once; an empty table gives an empty one.
    """
    records = records.where("record_id is not null")
    is_main = F.coalesce(F.col("type").isin("response", "revisit"), F.lit(False))
    main, other = records.where(is_main), records.where(~is_main)
    names = [c for c in records.columns if c not in ("concurrent_to", "fields")]
    whole: Column = F.struct(*names, F.array_join("concurrent_to", " ").alias("concurrent_to"), F.array_sort(F.map_entries("fields")).alias("fields"))
    columns = ["type", whole.alias("whole")]
    placed = main.select(F.col("record_id").alias("anchor"), *columns).union(other.join(_anchors(main, other).hint("merge"), "record_id").select("anchor", *columns))
    kind = F.col("type")
    return placed.groupBy(F.col("anchor").alias("capture_id")).agg(
        F.min(F.when(kind.isin("response", "revisit"), F.col("whole"))).alias("response"),
        F.array_sort(F.collect_set(F.when(kind == "request", F.col("whole")))).alias("requests"),
        F.array_sort(F.collect_set(F.when(kind == "metadata", F.col("whole")))).alias("metadata"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write archives, read them back, assemble captures: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.

    One row for every row of ``pages``, repeated ones included.  A null payload is empty.  A null id is kept, and never referred
    to.  Extra columns are not read; an empty table gives an empty one.  Without a ``folder`` the archives are deleted once their
    records are stored.
    """
    spark: SparkSession = pages.sparkSession
    at = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    manifest = write_archives(pages, at, id_col, url_col, html_col, least_bytes)
    records = cut(read_archives(manifest, at, with_payload=False).drop("payload"))
    if folder is None:
        remove(spark, at)
    page = F.element_at(F.map_from_entries(F.element_at("metadata", 1)["fields"]), "page-id").cast("long")
    found = cut(assemble(records).select(page.alias("page_id"), F.col("response.target_uri").alias("url"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type")))
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type"]
    first = found.where("record_type = 'response' and page_id is not null").groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    again = found.where("record_type = 'revisit'").join(first.hint("merge"), "payload_digest", "left")
    return found.where("record_type = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to")).union(again.select(*columns, "refers_to"))
