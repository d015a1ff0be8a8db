"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Files are read as byte ranges. Within one, headers are parsed first; records that the pushed-down
predicates (record type, target URI, record id, digest) or the options rule out are skipped, by the
gzip members' own skip lengths where the writer left them, so their payloads are never decoded.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .common import new_path

#: Fields of a record that have a column of their own.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ", ".join(f"{c} string" for c in FIELDS) + ", headers map<string,string>, payload_bytes long, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_COMMITTED.json"
RANGE = 128 << 20
_BAD = re.compile(r"[\x00-\x1f\x7f]")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing


def clean(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return _BAD.sub(lambda m: f"%{ord(m.group()):02X}", value)


def record(fields: list[tuple[str, str | None]], payload: bytes | None, full_bytes: int) -> bytes:
    """A record with an HTTP response block; a null payload leaves only the HTTP header, which keeps the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """One gzip member whose extra field 'sl' gives its compressed and plain lengths."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes a file of its own; readers see only those that the commit lists, so lost or repeated attempts do no harm."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = filesystem(self.path)
        fs.create_dir(top, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    payload = row.get("payload")
                    digest = row.get("payload_digest") or base32_sha1(payload or b"")
                    fields = [(FIELDS[c], f"sha1:{digest}" if c == "payload_digest" else row.get(c)) for c in FIELDS]
                    if row.get("record_type") == "revisit":
                        fields.append(("WARC-Profile", REVISIT))
                    full = row.get("payload_bytes")
                    out.write(member(record(fields, payload, len(payload or b"") if full is None else full)))
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.path)
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps({"files": sorted(m.name for m in messages if m is not None)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{top}/{m.name}")


# ---------------------------------------------------------------- reading


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


@dataclass
class Wanted:
    """What a record's headers must satisfy, and what is done with its payload (full, check or none)."""

    equal: dict[str, frozenset] = field(default_factory=dict)
    starts: list[tuple[str, str]] = field(default_factory=list)
    payload: str = "full"

    def has(self, headers: dict[str, str]) -> bool:
        value = lambda c: column_value(c, headers)
        return all(value(c) in ok for c, ok in self.equal.items()) and all((value(c) or "").startswith(p) for c, p in self.starts)


def column_value(column: str, headers: dict[str, str]) -> str | None:
    v = headers.get(FIELDS[column].lower())
    return v.partition(":")[2] if column == "payload_digest" and v is not None else v


def parse_headers(raw: bytes) -> dict[str, str]:
    """Named fields by lower-case name; folded lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def skip_length(head: bytes) -> int:
    """The compressed length of a gzip member that starts with ``head``; 0 if it doesn't say."""
    if len(head) >= 12 and head[:3] == b"\x1f\x8b\x08" and head[3] & 4:
        at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
        while at + 4 <= min(end, len(head)):
            n = struct.unpack_from("<H", head, at + 2)[0]
            if head[at : at + 2] == b"sl" and n == 8 and at + 12 <= len(head):
                return struct.unpack_from("<I", head, at + 4)[0]
            at += 4 + n
    return 0


class Records:
    """The records of a byte range of a file: those that start in it."""

    def __init__(self, stream, size: int, part: Range, wanted: Wanted):
        self.f, self.size, self.part, self.wanted = stream, size, part, wanted

    def at(self, pos: int, n: int) -> bytes:
        self.f.seek(pos)
        return self.f.read(n)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        head = self.at(0, 64)
        return self.zipped() if head[:2] == b"\x1f\x8b" else self.plain()

    def first(self) -> int:
        """Where the first member at or after the range's start begins."""
        pos = self.part.start
        while pos and pos < self.size:
            chunk = self.at(pos, 1 << 20)
            k = chunk.find(b"\x1f\x8b\x08\x04")
            if k < 0:
                pos += max(1, len(chunk) - 3)
                continue
            head = self.at(pos + k, 64)
            n = skip_length(head)
            follows = pos + k + n
            if n and (follows == self.size or self.at(follows, 2) == b"\x1f\x8b") and self.inflated(pos + k, 5) == b"WARC/":
                return pos + k
            pos += k + 1
        return pos

    def inflated(self, pos: int, n: int) -> bytes:
        try:
            return zlib.decompressobj(31).decompress(self.at(pos, 4096), n)[:n]
        except zlib.error:
            return b""

    def zipped(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        pos = self.first()
        while pos < min(self.part.end, self.size):
            length = skip_length(self.at(pos, 64))
            unzip, raw, read = zlib.decompressobj(31), b"", pos

            def more(limit: int) -> bytes:
                nonlocal read
                data = unzip.unconsumed_tail or self.f.read(1 << 16)
                if not unzip.unconsumed_tail:
                    read += len(data)
                return unzip.decompress(data, limit) if data else b""

            self.f.seek(pos)
            while b"\r\n\r\n" not in raw and not unzip.eof:
                got = more(1 << 12)
                if not got and not unzip.unconsumed_tail and read >= self.size:
                    break
                raw += got
            head, _, rest = raw.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            keep = self.wanted.has(headers)
            if keep and self.wanted.payload != "none":
                parts = [rest]
                while not unzip.eof:
                    got = more(1 << 20)
                    if not got and not unzip.unconsumed_tail and read >= self.size:
                        raise ValueError(f"{self.part.path}: a member ends early at {pos}")
                    parts.append(got)
                rest = b"".join(parts)
                yield headers, rest[: int(headers.get("content-length", 0))]
            elif keep:
                yield headers, None
            if length:
                pos += length
                continue
            while not unzip.eof:  # no skip length: the member must be read through, unkept
                if not more(1 << 20) and not unzip.unconsumed_tail and read >= self.size:
                    return
            pos = read - len(unzip.unused_data)

    def plain(self) -> Iterator[tuple[dict[str, str], bytes | None]]:
        pos = 0
        while pos < self.size:
            raw = b""
            while b"\r\n\r\n" not in raw:
                got = self.at(pos + len(raw), 1 << 12)
                if not got:
                    return
                raw += got
            head = raw.partition(b"\r\n\r\n")[0]
            headers = parse_headers(head.lstrip(b"\r\n"))
            n, body = int(headers.get("content-length", 0)), pos + len(head) + 4
            if self.wanted.has(headers):
                yield headers, None if self.wanted.payload == "none" else self.at(body, n)
            pos = body + n + 4


def http_payload(headers: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload in a record's block, and its full length as the HTTP header states it (else as found)."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head)
    return payload, int(said[1]) if said else len(payload)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], options
        self.wanted = Wanted(payload=options.get("payload", "full"))
        if self.wanted.payload not in ("full", "check", "none"):
            raise ValueError("payload must be full, check or none")
        if "recordtype" in {k.lower() for k in options}:
            self.wanted.equal["record_type"] = frozenset(next(v for k, v in options.items() if k.lower() == "recordtype").split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, IN and prefix predicates on header columns are applied before payloads; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in FIELDS and isinstance(f, (EqualTo, EqualNullSafe, In)):
                ok = frozenset(f.value if isinstance(f, In) else [f.value])
                self.wanted.equal[column] = self.wanted.equal.get(column, ok) & ok
            elif column in FIELDS and isinstance(f, StringStartsWith):
                self.wanted.starts.append((column, f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, top = filesystem(self.path)
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.File:
            files = [info]
        elif fs.get_file_info(f"{top}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{top}/{MANIFEST}", compression=None) as f:
                names = json.loads(f.read())["files"]
            files = fs.get_file_info([f"{top}/{n}" for n in names])
        else:
            files = [x for x in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if re.search(r"\.warc(\.gz)?$", x.path)]
        step, out = int(self.options.get("rangeBytes", self.options.get("rangebytes", RANGE))), []
        for x in files:
            splits = False
            if x.size > step:
                with fs.open_input_file(x.path) as f:
                    splits = skip_length(f.read(64)) > 0
            out += [Range(x.path, a, min(a + step, x.size)) for a in range(0, x.size, step)] if splits else [Range(x.path, 0, x.size)] if x.size else []
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as f:
            rows: list[tuple] = []
            held = 0
            for headers, block in Records(f, f.size(), partition, self.wanted):
                payload, full = http_payload(headers, block) if block is not None else (None, None)
                if self.wanted.payload == "check" and column_value("record_type", headers) == "response" and base32_sha1(payload) != column_value("payload_digest", headers):
                    raise ValueError(f"{partition.path}: the payload of {column_value('record_id', headers)} differs from its digest")
                payload = payload if self.wanted.payload == "full" else None
                rows.append((*(column_value(c, headers) for c in FIELDS), list(headers.items()), full, payload))
                held += len(payload or b"") + 500
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*(pa.string() for _ in FIELDS), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*FIELDS, "headers", "payload_bytes", "payload"])


class WarcDataSource(DataSource):
    """Options: path; payload = full (default), check (decoded and held against its digest, not returned) or none; recordType; rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---------------------------------------------------------------- pages to archives and back


def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """A record per page: equal payloads of ``least`` bytes or more are kept once, with the largest page_id.

    Only digests and ids are grouped; the pages meet their group's largest id in a join on the digest,
    one row a group on the other side, so one payload with most of the rows can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    first = pages.select("page_id", F.sha1(payload).alias("g")).groupBy("g").agg(F.max("page_id").alias("first"))
    rows = rows.join(first, rows["sha"] == first["g"])
    again = (F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit(None).cast("string").alias("payload_digest"), F.when(again, name(F.col("first"))).alias("refers_to"),
        F.col("n").alias("payload_bytes"), F.col("payload"), F.col("sha"), again.alias("again"),
    )


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri) of each page, read back from archives written here.

    Null html is an empty payload; null ids come back null and are a revisit only of a non-null id;
    rows that repeat an id and its payload are records like any other (all responses if that id is the
    largest). Null urls have no target URI; control characters in urls are percent-encoded. An empty
    table writes an empty archive. Extra columns are not written.
    """
    spark = pages.sparkSession
    register(spark)
    path = new_path(spark, "warc")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    rows = page_records(pages, least)
    digest = F.when(F.col("again"), base32(F.unhex("sha")))
    rows.withColumn("payload_digest", digest).withColumn("payload", F.when(~F.col("again"), F.col("payload"))).drop("sha", "again").write.format("warc").mode("append").save(path)
    back = spark.read.format("warc").option("payload", "check").load(path)
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1)
    return back.select(
        F.when(number("record_id") != "", number("record_id").cast("long")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(number("refers_to") != "", number("refers_to").cast("long")).alias("refers_to"), "target_uri",
    )


def base32(data: Column) -> Column:
    """Base32 of 20 bytes: four groups of five bytes, eight characters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(4):
        group = F.conv(F.hex(F.substring(data, 5 * k + 1, 5)), 16, 10).cast("long")
        out += [F.substring(alphabet, (F.shiftright(group, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for j in range(8)]
    return F.concat(*out)
