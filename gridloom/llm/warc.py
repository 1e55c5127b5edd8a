"""WARC archives: a writer, and a PySpark Python data source named ``warc``.

Writer: one gzip member a record, as usual for WARC. Each member's header has the ``sl`` extra field (compressed and
uncompressed length) of the WARC specification's annex on gzip, so that a reader can go on to the next record without
inflating this one.

Reader: plans partitions of whole files, small ones together, up to ``partitionBytes`` each. Comparisons of columns that
come from the record header (record_type, page_id, target_uri, digest, payload_bytes, refers_to) with constants are
pushed down. It inflates a record's header first; a record that the filters refuse, or whose payload is not in the
schema, is skipped by its ``sl`` length (inflated and thrown away where a foreign file has none), its payload neither
decoded nor copied. Session option ``spark.sql.python.filterPushdown.enabled`` must be on (``read_warc`` sees to it).

Defined cases: null html is an empty payload; null url is written as an empty target; a null page_id reads back as null;
payloads of any length; several pages with the largest page_id of equal payloads are all responses; an empty table writes
no archive and reads as an empty table; other columns of pages are ignored. Archives of other writers: plain ``.warc`` files
are read by Content-Length; ids that are not this writer's give a null page_id or refers_to; header names are matched
whatever their case and may go on over lines; a record without a type has the type ''; digests other than SHA-1 in base 32
or hex are null; payload_bytes is the payload's length where it can be told, else null; the payload of a request or
response is what follows the HTTP header, that of any other record (warcinfo, resource, metadata, ...) its whole block, that
of a revisit is empty.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
)

from gridloom.llm.common import remote, saved, table, work_dir

SCHEMA = (
    "page_id long, target_uri string, record_type string, payload_bytes long, digest string, refers_to long, payload binary"
)
HEADER_COLUMNS = ("page_id", "target_uri", "record_type", "payload_bytes", "digest", "refers_to")
#: Records with payloads below this many bytes are never revisits.
MIN_DEDUP_BYTES = 1000
#: A file is closed after so many bytes, compressed.
FILE_BYTES = 256 << 20
#: All records have this date, so that a repeated task writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def of_urn(value: str | None) -> int | None:
    """The page_id of a record id; null for other writers' ids."""
    found = re.fullmatch(r"<urn:x-page:(-?\d{1,19})>", value or "")
    return int(found[1]) if found else None


def of_digest(value: str) -> str | None:
    """Hex of a labelled SHA-1 digest, which is in base 32 as a rule; null for others."""
    kind, _, digits = value.partition(":")
    if kind.strip().lower() not in ("sha1", "sha-1"):
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", digits):
        return digits.lower()
    return base64.b32decode(digits.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", digits) else None


def member(data: bytes) -> bytes:
    """A gzip member with the sl field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size, len(data))
    head = b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record."""
    block = HTTP if revisit else HTTP + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head.append(f"WARC-Refers-To: {urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return member("\r\n".join(head).encode() + block + b"\r\n\r\n")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the largest page_id of equal payloads, null below min_bytes.

    Equal means equal SHA-1. The largest ids are pre-aggregated by digest, and digests that occur more than once are
    written, so both sides of the join back come from plain exchanges, whose hot digests adaptive execution can split.
    Pages below min_bytes take no part in that join, whatever they have in common.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= min_bytes
    firsts = (
        rows.where(big)
        .groupBy(F.col("digest").alias("same"))
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.where(big).join(saved(firsts, "warc-firsts"), F.col("digest") == F.col("same"), "left").drop("same")
    return joined.unionByName(rows.where(~big).withColumn("first", F.lit(None).cast("long")))


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, digest, first) to archives in folder; returns (path, n_records, n_bytes)."""

    def run(batches):
        from pyspark import TaskContext

        system, root = remote(folder)
        system.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        part, out, draft, count, size = 0, None, "", 0, 0

        def close():
            out.close()
            name = f"{shard:06d}-{part:04d}.warc.gz"
            system.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [count], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    draft = f"{root}/.{shard}-{part}-{uuid.uuid4().hex}"
                    out, count, size = system.open_output_stream(draft), 0, 0
                data = record(page_id, url, payload, digest, first, first is not None and first != page_id)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= FILE_BYTES:
                    yield close()
                    out, part = None, part + 1
        if out is not None:
            yield close()

    columns = records.select("page_id", "url", "payload", "digest", "first")
    return columns.mapInArrow(run, "path string, n_records long, n_bytes long")


def header_fields(head: bytes) -> dict[str, str]:
    """Fields of a record header by lower-case name; lines that start with white space go on with the field before."""
    text = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace"))
    pairs = (line.partition(":") for line in text.split("\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def cut_header(data: bytes) -> int:
    """Where the empty line after a record header ends, -1 if it is not in data."""
    found = re.search(rb"\r?\n\r?\n", data)
    return found.end() if found else -1


class Plain:
    """A record that is not compressed, at place ``at`` of f."""

    def __init__(self, f, at: int):
        self.f, self.at = f, at

    def read(self) -> bytes:
        return self.f.read(8192)

    def header(self) -> bytes:
        self.f.seek(self.at)
        data = self.read().lstrip(b"\r\n")
        while (cut := cut_header(data)) < 0:
            more = self.read()
            if not more:
                if data.strip():
                    raise ValueError("cut off in a record header")
                return b""
            data = (data + more).lstrip(b"\r\n")
        self.rest, self.start = data[cut:], self.f.tell() - (len(data) - cut)
        return data[:cut]

    def block(self, length: int) -> bytes:
        self.f.seek(self.start)
        out = self.f.read(length)
        if len(out) < length:
            raise ValueError("cut off in a record")
        return out

    def end(self, length: int, skipped: bool) -> int:
        return self.start + length


class Member(Plain):
    """A record that is a gzip member."""

    def __init__(self, f, at: int):
        super().__init__(f, at)
        self.inflate, self.packed, self.first, self.size_out = zlib.decompressobj(31), b"", b"", 0

    def read(self) -> bytes:
        """The next piece of at most 64 KB inflated; empty at the member's end."""
        while not self.inflate.eof:
            self.packed = self.packed or self.f.read(8192)
            if not self.packed:
                raise ValueError("cut off in a record")
            self.first = self.first or self.packed[:8192]
            piece = self.inflate.decompress(self.packed, 1 << 16)
            self.packed = self.inflate.unconsumed_tail
            if piece:
                self.size_out += len(piece)
                return piece
        return b""

    def block(self, length: int) -> bytes:
        out = bytearray(self.rest)
        while len(out) < length and (piece := self.read()):
            out += piece
        if len(out) < length:
            raise ValueError("cut off in a record")
        return bytes(out[:length])

    def end(self, length: int, skipped: bool) -> int:
        size = self.size() if skipped else 0
        if size:
            return self.at + size
        before = self.size_out - len(self.rest)  # header and line ends before it
        while self.read():
            pass
        if self.size_out - before > length + 4:
            raise ValueError("more than one record in a gzip member")
        return self.f.tell() - len(self.inflate.unused_data)

    def size(self) -> int:
        """Length of this gzip member by its sl field, 0 if it has none."""
        start = self.first
        if len(start) < 24 or not start[3] & 4:
            return 0
        end = 12 + struct.unpack_from("<H", start, 10)[0]
        at = 12
        while at + 4 <= end:
            name, size = struct.unpack_from("<2sH", start, at)
            if name == b"sl" and size == 8:
                return struct.unpack_from("<I", start, at + 4)[0]
            at += 4 + size
        return 0


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.schema, self.options = schema, dict(options)
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Take what the record header decides; the rest goes back to Spark."""
        kinds = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_COLUMNS and type(f) in kinds:
                self.tests.append((name, kinds[type(f)], f.value))
            elif name in HEADER_COLUMNS and isinstance(f, IsNull | IsNotNull):
                self.tests.append((name, "null" if isinstance(f, IsNull) else "there", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, root = remote(self.options["path"])
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((x.path, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz")))
        limit = int(self.options.get("partitionbytes", 32 << 20))
        groups: list[list[str]] = []
        held = limit
        for path, size in files:
            if held + size > limit:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(g) for g in groups] or [Files([])]

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if kind == "null":
                good = x is None
            elif x is None:
                good = False
            else:
                good = (
                    kind == "there"
                    or (kind == "=" and x == value)
                    or (kind == "in" and x in value)
                    or (kind == ">" and x > value)
                    or (kind == ">=" and x >= value)
                    or (kind == "<" and x < value)
                    or (kind == "<=" and x <= value)
                )
            if not good:
                return False
        return True

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        system, _ = remote(self.options["path"])
        for path in partition.paths:
            with system.open_input_file(path) as f:
                for row in self.records(f, "payload" in names):
                    yield tuple(row[n] for n in names)

    def records(self, f, payloads: bool):
        """Header fields of each wanted record, with its payload if asked for."""
        f.seek(0)
        packed = f.read(2) == b"\x1f\x8b"
        at, end = 0, f.size()
        while at < end:
            source = (Member if packed else Plain)(f, at)
            head = source.header()
            if not head.strip():  # nothing but line ends up to the end of the file
                return
            fields = header_fields(head)
            length = int(fields.get("content-length", 0))
            kind = fields.get("warc-type", "")
            row = {
                "page_id": of_urn(fields.get("warc-record-id")),
                "target_uri": fields.get("warc-target-uri", ""),
                "record_type": kind,
                "digest": of_digest(fields.get("warc-payload-digest", "")),
                "refers_to": of_urn(fields.get("warc-refers-to")),
                "payload": None,
            }
            stated = fields.get("x-payload-length", "")
            row["payload_bytes"] = int(stated) if stated.isdigit() else None
            http = "application/http" in fields.get("content-type", "").lower()
            if row["payload_bytes"] is None and kind != "revisit" and not http:
                row["payload_bytes"] = length
            # The payload's length of a foreign HTTP record is known when its block is read.
            untold = row["payload_bytes"] is None and http and kind != "revisit"
            block = None
            if untold and (payloads or "payload_bytes" in self.needed()) or payloads and self.wanted(row):
                block = source.block(length)
                content = block.partition(b"\r\n\r\n")[2] if http else block
                if untold:
                    row["payload_bytes"] = len(content)
                if payloads:
                    row["payload"] = b"" if kind == "revisit" else content
            at = source.end(length, block is None)
            if self.wanted(row):
                yield row

    def needed(self) -> set[str]:
        """Columns that are asked for or compared."""
        return {f.name for f in self.schema.fields} | {name for name, *_ in self.tests} if self.schema else set(HEADER_COLUMNS)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """The archives in folder; without ``payload`` among the columns, no payload is inflated."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc")
    if columns:
        kinds = dict(x.strip().split(" ") for x in SCHEMA.split(","))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as archives, then read them: responses with payloads (digest and length taken from these), revisits by
    their headers alone."""
    folder = work_dir(spark, "warc")
    saved(write_warc(with_revisits(table(spark, sf_dir, "pages")), folder), "warc-manifest")
    responses = read_warc(spark, folder).where("record_type = 'response'")
    revisits = read_warc(spark, folder, [c for c in HEADER_COLUMNS]).where("record_type = 'revisit'")
    return responses.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        revisits.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""
