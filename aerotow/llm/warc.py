"""Operator 8, WARC: a Python data source that writes and reads web archives.

Writing: every task writes one file of gzip members, a member per record, and the commit writes a manifest of the
committed files with split points; files of failed attempts are not in it. A member's gzip header carries its own
length (extra field ``sl``), so a reader can step over it.

Reading: partitions are file ranges planned from the manifest (without one, whole files). Filters on the record type
and on header columns are pushed down; a record's headers are inflated and parsed first, and when the record is not
wanted, or the payload is not asked for (option ``payload=false``), the rest of the member is skipped undecoded.

Revisits: of records with equal payloads of ``SMALLEST`` bytes or more, the one with the smallest id is the response;
the others refer to it. Digests are pre-aggregated before the shuffle; their join is left to the skew join.

Defined cases: a null payload is empty; a null uri has no header and reads back as null; line breaks in a uri are
percent-encoded; rows of one id with equal payloads are all responses or all revisits; an empty table gives an
archive without records; further columns are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, WriterCommitMessage)

SMALLEST = 100
SPLIT_BYTES = 16 << 20
SCHEMA = ("record_id string, warc_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length bigint, payload binary")
MANIFEST = "_manifest"

# Lines of the WARC 1.1 format.
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI",
            "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "WARC-Payload-Length"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def member(record: dict, level: int = 6) -> bytes:
    """One record as a gzip member with its length in the extra field."""
    head = ["WARC/1.1", f"WARC-Type: {record['warc_type']}", f"WARC-Record-ID: <{record['record_id']}>", f"WARC-Date: {_DATE}"]
    if record["target_uri"] is not None:
        head.append("WARC-Target-URI: " + record["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha256:{record['payload_digest']}", f"WARC-Payload-Length: {record['payload_length']}"]
    if record["refers_to"] is not None:
        head += [f"WARC-Refers-To: <{record['refers_to']}>", f"WARC-Profile: {_PROFILE}"]
    body = _HTTP + (record["payload"] or b"")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    plain = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(plain) + deflate.flush()
    extra = b"sl" + struct.pack("<HQ", 8, 10 + 2 + 12 + len(packed) + 8)
    return (b"\x1f\x8b\x08\x04" + struct.pack("<I", 0) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
            + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF))


def _parsed(head: bytes) -> dict:
    # names in any case, white space around values optional
    lines = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    fields = {name.strip().lower(): value.strip() for name, _, value in lines}
    row = {c: fields.get(h.lower()) for c, h in _HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] is not None else None
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha256:") or None
    row["payload_length"] = int(row["payload_length"]) if (row["payload_length"] or "").isdigit() else None
    row["_content"] = int(fields.get("content-length") or 0)
    return row


def _uncompressed(f, at: int, wanted, payload: bool) -> tuple[dict | None, int]:
    """The record at ``at`` of a plain archive if it is wanted, and its length."""
    f.seek(at)
    plain = b""
    while b"\r\n\r\n" not in plain:
        more = f.read(8192)
        if not more:
            raise ValueError(f"record at byte {at} is cut off")
        plain += more
    head, _, _ = plain.partition(b"\r\n\r\n")
    row, begin = _parsed(head), at + len(head) + 4
    size = row.pop("_content")
    if not wanted(row):
        return None, begin + size + 4 - at
    row["payload"] = None
    if payload and row["warc_type"] != "revisit":
        f.seek(begin)
        row["payload"] = f.read(size).partition(b"\r\n\r\n")[2]
    return row, begin + size + 4 - at


def records(f, start: int, end: int, wanted, payload: bool) -> Iterator[dict]:
    """Records of the members that begin in [start, end); headers first, the rest only for wanted records."""
    at = start
    while at < end:
        f.seek(at)
        raw = f.read(8192)
        if raw[:5] == b"WARC/":
            row, length = _uncompressed(f, at, wanted, payload)
            at += length
            if row is not None:
                yield row
            continue
        if raw[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        flags, skip, length = raw[3], 10, None
        if flags & 4:
            size = struct.unpack_from("<H", raw, 10)[0]
            extra, skip = raw[12:12 + size], 12 + size
            while len(extra) >= 4:
                n = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and n == 8:
                    length = struct.unpack_from("<Q", extra, 4)[0]
                extra = extra[4 + n:]
        for flag in (8, 16):  # file name, comment
            if flags & flag:
                skip = raw.index(b"\0", skip) + 1
        skip += 2 * bool(flags & 2)
        inflate, plain, feed, read = zlib.decompressobj(-15), b"", raw[skip:], len(raw)
        while b"\r\n\r\n" not in plain and not inflate.eof:
            if not feed:
                feed = f.read(65536)
                read += len(feed)
                if not feed:
                    raise ValueError(f"member at byte {at} is cut off")
            plain += inflate.decompress(feed, 4096)
            feed = inflate.unconsumed_tail
        head, _, rest = plain.partition(b"\r\n\r\n")
        row = _parsed(head)
        use = wanted(row)
        body = io.BytesIO()
        if use and payload and row["warc_type"] != "revisit":
            body.write(rest)
            need = max(row["_content"] - len(rest), 0)
            while need > 0 and not inflate.eof:
                if not feed:
                    feed = f.read(1 << 20)
                    read += len(feed)
                    if not feed:
                        raise ValueError(f"member at byte {at} is cut off")
                body.write(inflate.decompress(feed))
                need, feed = row["_content"] - body.tell(), inflate.unconsumed_tail
        if length is None:  # foreign archive: inflate to the member's end to find the next one
            while not inflate.eof:
                feed = feed or f.read(1 << 20)
                read = f.tell() - at
                if not feed:
                    raise ValueError(f"member at byte {at} is cut off")
                inflate.decompress(feed, 1 << 20)
                feed = inflate.unconsumed_tail
            length = f.tell() - at - len(inflate.unused_data) + 8
        at += length
        if use:
            full = body.getvalue()[:row.pop("_content")]
            row["payload"] = full.partition(b"\r\n\r\n")[2] if payload and row["warc_type"] != "revisit" else None
            yield row


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    splits: list
    records: int


class WarcSource(DataSource):
    """Format ``warc``; options: path, payload (true or false), level (of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.equal: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on header columns are taken over; the others are left to Spark."""
        def column(f: Filter) -> str | None:
            return f.attribute[0] if len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in _HEADERS else None
        rest = []
        for f in filters:
            if column(f) and isinstance(f, (EqualTo, In)):
                self.equal.append((column(f), (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                rest.append(f)
        held = {c for c, _ in self.equal}
        yield from (f for f in rest if not (isinstance(f, IsNotNull) and column(f) in held))  # equality implies it

    def partitions(self) -> list[Range]:
        files, root = _open(self.path)
        one = files.get_file_info(root)
        inside = [] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root))
        manifests = sorted(x.path for x in inside if x.base_name.startswith(MANIFEST))  # one of every write
        if manifests:
            entries = []
            for m in manifests:
                with files.open_input_stream(m) as f:
                    entries += json.loads(f.read())
            out = [Range(f"{self.path}/{e['name']}", a, b) for e in entries for a, b in zip(e["splits"], e["splits"][1:])]
        else:
            found = [one] if one.type == fs.FileType.File else [x for x in inside if x.path.endswith((".warc.gz", ".warc"))]
            out = [Range(self.path if x is one else f"{self.path}/{x.base_name}", 0, x.size) for x in found]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == part.start:
            return
        files, path = _open(part.path)

        def wanted(row):
            return all(row[c] in values for c, values in self.equal)
        kinds = pa.schema([(c, pa.int64() if c == "payload_length" else pa.binary() if c == "payload" else pa.string())
                           for c in [*_HEADERS, "payload"]])
        held, size = [], 0
        with files.open_input_file(path) as f:
            for row in records(f, part.start, part.end, wanted, self.payload):
                held.append(row)
                size += len(row["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", "6"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.path)
        name, out, at, n, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0, [0]
        try:
            for batch in iterator:
                for i in range(batch.num_rows):  # a row at a time: payloads may be large
                    if out is None:
                        files.create_dir(root, recursive=True)
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                    raw = member({c: batch.column(c)[i].as_py() for c in batch.schema.names}, self.level)
                    out.write(raw)
                    at, n = at + len(raw), n + 1
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
        finally:
            if out is not None:
                out.close()
        return Written(name, splits if splits[-1] == at and n else [*splits, at], n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        entries = [{"name": m.name, "splits": m.splits, "records": m.records} for m in messages if m is not None and m.records]
        with files.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(entries).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Uncommitted files are in no manifest; they are removed where they are known."""
        files, root = _open(self.path)
        for m in messages:
            if m is not None and m.records and files.get_file_info(f"{root}/{m.name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{m.name}")


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session; its reader takes pushed filters, which Spark has off by default."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html",
         smallest: int = SMALLEST) -> DataFrame:
    """Rows of a WARC table for ``pages``: responses with their payload, revisits without."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("target_uri"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_length"))
    keys = rows.where(F.col("payload_length") >= smallest).select("id", "payload_digest")
    firsts = keys.groupBy("payload_digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    again = (keys.join(firsts, "payload_digest").where("id > first").select(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"), "first")
             .distinct())
    rows = rows.join(again, (F.col("id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(
        F.coalesce(urn(F.col("id")), F.lit("urn:page:")).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("warc_type"),
        "target_uri", urn(F.col("first")).alias("refers_to"), "payload_digest", "payload_length",
        F.when(F.col("first").isNull(), F.col("payload")).alias("payload"))


def write(records_: DataFrame, path: str, level: int = 6) -> None:
    register(records_.sparkSession)
    records_.write.format("warc").mode("append").option("level", level).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def report(archive: DataFrame) -> DataFrame:
    """Digest columns of an archive of pages: a response's from its payload as read, a revisit's from its headers."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    own = F.col("warc_type") == "response"
    return archive.select(
        F.when(number(F.col("record_id")) != "", number(F.col("record_id")).cast("bigint")).alias("page_id"),
        F.when(own, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(F.col("refers_to").isNotNull(), number(F.col("refers_to")).cast("bigint")).alias("refers_to"))
