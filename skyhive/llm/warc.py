"""WARC archives as a PySpark Python data source, and capture with revisit records.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(path).where("record_type = 'response'")

Each record is two gzip members: one for its headers, one for its payload. An extra field of the first
(subfield SL, as gzip allows) holds the length of the second, so a reader that does not want a payload steps
over it without inflating it; to any other reader the file is an ordinary .warc.gz. Archives of other makers
are read too, their payloads are then inflated to be passed over.

Reading: files become partitions, large ones are cut at record starts that the writer noted. Predicates on
record_type, target_uri, record_key, refers_to, payload_digest and payload_bytes are pushed down and decided
on the headers; option payload=false leaves all payloads undecoded. Writing: a task writes files of its own
under a fresh name, and only those of successful tasks enter the manifest, so a lost executor leaves nothing
that a reader sees.

Defined results: null html is an empty payload; null page_ids and urls are kept as such; an empty table
gives archives without records; rows repeated with one page_id and payload are all responses; extra columns
are not read. Two payloads are equal if SHA-1 and length are.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from skyhive.llm.common import fresh_path, prepare, table

SCHEMA = "record_type string, record_key long, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"
MANIFEST = "_manifest"
SPLIT = 32 << 20
#: Record ids are UUIDs: a fixed first half, then the key. The second prefix marks a missing key.
_SPACE, _NO_KEY = 0x6B1D5A0E77C14D2B, 0x6B1D5A0E77C14D2C
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(_NO_KEY << 64) if key is None else (_SPACE << 64) | (key & (2 ** 64 - 1)))}>"


def key_of(name: str | None) -> int | None:
    if not name:
        return None
    try:
        value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    except ValueError:
        return None
    if value >> 64 != _SPACE:
        return None
    low = value & (2 ** 64 - 1)
    return low - 2 ** 64 if low >> 63 else low


def _member(data: bytes, extra: bytes = b"", level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = b"\x1f\x8b\x08" + (b"\x04" if extra else b"\x00") + b"\x00\x00\x00\x00\x00\xff"
    return head + (struct.pack("<H", len(extra)) + extra if extra else b"") + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: list[tuple[str, str]], block_head: bytes, payload: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block_head) + len(payload)))])
    second = _member(payload + b"\r\n\r\n")
    return _member(f"WARC/1.1\r\n{lines}\r\n".encode() + block_head, b"SL" + struct.pack("<HQ", 8, len(second))) + second


def _clean(value: str) -> str:
    """A header value stays on one line: controls, blanks and '%' are percent-encoded, as URIs ask."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) <= 32 or ord(c) == 127 else c for c in value)


def _unclean(value: str | None) -> str | None:
    if value is None or "%" not in value:
        return value
    out, at = [], 0
    while at < len(value):
        code = value[at + 1:at + 3]
        if value[at] == "%" and len(code) == 2 and all(c in "0123456789ABCDEF" for c in code):
            out.append(chr(int(code, 16)))
            at += 3
        else:
            out.append(value[at])
            at += 1
    return "".join(out)


def page_record(row: dict) -> bytes:
    """One input row (the columns of SCHEMA) as bytes; a revisit carries headers only."""
    response = row["record_type"] == "response"
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", record_id(row["record_key"])), ("WARC-Date", "1970-01-01T00:00:00Z"),
               ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("X-Payload-Length", str(row["payload_bytes"])),
               ("Content-Type", "application/http; msgtype=response")]
    if row["target_uri"] is not None:
        headers.append(("WARC-Target-URI", _clean(row["target_uri"])))
    if not response:
        headers += [("WARC-Refers-To", record_id(row["refers_to"])),
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record(headers, HTTP, (row["payload"] or b"") if response else b"")


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.roll = int(options.get("roll", 256 << 20))

    def write(self, iterator):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        files, out = [], None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append({"name": f"part-{uuid.uuid4().hex}.warc.gz", "size": 0, "cuts": [0]})
                    out = store.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
                                   ("Content-Type", "application/warc-fields")], b"", b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    files[-1]["size"] = len(info)
                if files[-1]["size"] - files[-1]["cuts"][-1] >= SPLIT:
                    files[-1]["cuts"].append(files[-1]["size"])
                data = page_record(row)
                out.write(data)
                files[-1]["size"] += len(data)
                if files[-1]["size"] >= self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages):
        store, root = fs.FileSystem.from_uri(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{f['name']}")


@dataclass
class Piece(InputPartition):
    name: str
    start: int
    end: int | None


class _Stream:
    """Gzip members of a file, read in steps; a member can be stepped over if its length is known."""

    def __init__(self, file, at: int):
        self.file, self.data, self.base = file, b"", at
        file.seek(at)

    @property
    def at(self) -> int:
        return self.base

    def _need(self, n: int) -> bool:
        while len(self.data) < n:
            more = self.file.read(max(1 << 18, n - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def skip(self, n: int) -> None:
        self.base += n
        if n <= len(self.data):
            self.data = self.data[n:]
        else:
            self.data = b""
            self.file.seek(self.base)

    def header_extra(self) -> int | None:
        """Length of the member after the next one, if the next says so."""
        if not self._need(12) or not self.data[3] & 4:
            return None
        n = struct.unpack_from("<H", self.data, 10)[0]
        self._need(12 + n)
        extra, at = self.data[12:12 + n], 0
        while at + 4 <= n:
            size = struct.unpack_from("<H", extra, at + 2)[0]
            if extra[at:at + 2] == b"SL" and size == 8:
                return struct.unpack_from("<Q", extra, at + 4)[0]
            at += 4 + size
        return None

    def member(self) -> bytes | None:
        if not self._need(1):
            return None
        inflate, out, used = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            if not self.data and not self._need(1):
                raise ValueError("the archive ends inside a record")
            out.append(inflate.decompress(self.data))
            used += len(self.data) - len(inflate.unused_data)
            self.data = inflate.unused_data
        self.base += used
        return b"".join(out)


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def records(file, start: int, end: int | None, wanted, with_payload: bool):
    """(headers, payload or None) of the records that begin in [start, end); `wanted` sees the headers first."""
    stream, held = _Stream(file, start), b""
    while held or end is None or stream.at < end:
        skip = stream.header_extra() if not held else None
        if not held:
            held = stream.member() or b""
        if not held.strip():
            return
        while b"\r\n\r\n" not in held:
            held += stream.member() or b"\r\n\r\n"
        head, _, rest = held.partition(b"\r\n\r\n")
        headers = _headers(head)
        length = int(headers.get("content-length", 0))
        chosen = wanted(headers)
        http = headers.get("content-type", "").startswith("application/http")
        if skip is not None and not (chosen and with_payload and headers.get("warc-type") == "response"):
            stream.skip(skip)
            held, block = b"", None
        else:
            parts, size = [rest], len(rest)
            while size < length + 4:
                more = stream.member()
                if more is None:
                    break
                parts.append(more)
                size += len(more)
            rest = b"".join(parts)
            block, held = rest[:length], rest[length + 4:]
        if chosen:
            payload = block if with_payload and headers.get("warc-type") == "response" else None
            if payload is not None and http:
                payload = payload.partition(b"\r\n\r\n")[2]
            yield headers, payload


def _fields(h: dict) -> dict:
    digest = h.get("warc-payload-digest")
    return {"record_type": h.get("warc-type"), "record_key": key_of(h.get("warc-record-id")), "refers_to": key_of(h.get("warc-refers-to")),
            "target_uri": _unclean(h.get("warc-target-uri")), "payload_bytes": int(h["x-payload-length"]) if "x-payload-length" in h else None,
            "payload_digest": digest.removeprefix("sha1:") if digest else None}


_TESTS = {EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b,
          GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _holds(test: tuple, value) -> bool:
    kind, wanted = test
    if kind is IsNotNull:
        return value is not None
    if value is None:
        return kind is EqualNullSafe and wanted is None
    return _TESTS[kind](value, wanted)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            if (type(f) in _TESTS or type(f) is IsNotNull) and len(f.attribute) == 1 and f.attribute[0] != "payload":
                self.tests.append((f.attribute[0], (type(f), getattr(f, "value", None))))
            else:
                yield f

    def partitions(self):
        store, root = fs.FileSystem.from_uri(self.path)
        listed = store.get_file_info(fs.FileSelector(root, recursive=False))
        manifests = [x for x in listed if x.base_name.startswith(MANIFEST)]
        if not manifests:
            return [Piece(x.base_name, 0, None) for x in listed if x.base_name.endswith(".warc.gz")] or [Piece("", 0, 0)]
        pieces = []
        for m in manifests:
            with store.open_input_stream(m.path, compression=None) as f:
                for x in json.loads(f.read()):
                    pieces += [Piece(x["name"], a, b) for a, b in zip(x["cuts"], [*x["cuts"][1:], x["size"]])]
        return pieces or [Piece("", 0, 0)]

    def read(self, partition):
        if not partition.name:
            return
        store, root = fs.FileSystem.from_uri(self.path)
        names = ("record_type", "record_key", "refers_to", "target_uri", "payload_bytes", "payload_digest", "payload")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
        last: dict = {}

        def wanted(headers):
            last.clear()
            last.update(_fields(headers))
            return all(_holds(test, last[name]) for name, test in self.tests)

        rows, held = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=list(names))
        with store.open_input_file(f"{root}/{partition.name}") as file:
            for _, payload in records(file, partition.start, partition.end, wanted, self.payload):
                rows.append(last | {"payload": payload})
                held += len(payload or b"")
                if held >= 8 << 20 or len(rows) >= 5000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options), overwrite)


def captured(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Records for `pages` (page_id, url, html): of equal payloads of at least `least_bytes` the one with the
    largest page_id is a response, others revisit it.

    Copies are counted with a map-side combine; the join back keeps the many rows of one payload splittable.
    """
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("record_key"), F.col("url").cast("string").alias("target_uri"), html.alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    kept = (p.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
            .agg(F.max("record_key").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n"))
    p = p.join(kept, ["payload_digest", "payload_bytes"], "left")
    again = F.col("keeper").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("keeper"))
    return p.select(F.when(again, "revisit").otherwise("response").alias("record_type"), "record_key",
                    F.when(again, F.col("keeper")).alias("refers_to"), "target_uri", "payload_bytes", "payload_digest",
                    F.when(~again, F.col("payload")).alias("payload"))


def write_warc(records_: DataFrame, path: str) -> None:
    prepare(records_.sparkSession).dataSource.register(WarcSource)
    records_.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    prepare(spark).dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are those of the payload as read; a revisit has them in its headers.
    """
    path = fresh_path(prepare(spark), "warc")
    write_warc(captured(table(spark, sf_dir, "pages")), path)
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    return back.select(F.col("record_key").alias("page_id"), F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
                       F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"), "record_type", "refers_to")
