"""WARC archives as a PySpark Python data source, to write and to read.

Format ``warc``.  Columns: record_id, warc_type, date, target_uri, refers_to,
payload_digest, payload_length, payload.  Every record is a gzip member of its
own whose ``sl`` extra field has the member's length, so that a reader can
inflate the headers alone and step over the rest.

Writing: each task writes files of its own under the folder, which must be
shared; the commit puts their names into a manifest, so files of failed or
repeated attempts are never read.  Reading: one partition per group of files;
equality filters on the record type and headers are pushed down
(``spark.sql.python.filterPushdown.enabled``), headers are parsed first, and
payloads of records that don't match, or all with option ``payload=false``,
are not inflated.  Archives without manifest, without ``sl`` fields or
without compression are read too.

Defined results: a null payload is no payload (a response has at least an
empty one), null headers are left out and read back as null, line breaks in
headers are percent-encoded, an empty table makes an empty archive.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from riskscope.llm.common import checked_broadcast, ship

SCHEMA = "record_id string, warc_type string, date string, target_uri string, refers_to string, payload_digest string, payload_length bigint, payload binary"
#: Header of a column, and whether its value stands in angle brackets.
HEADERS = {
    "record_id": ("WARC-Record-ID", True),
    "warc_type": ("WARC-Type", False),
    "date": ("WARC-Date", False),
    "target_uri": ("WARC-Target-URI", False),
    "refers_to": ("WARC-Refers-To", True),
    "payload_digest": ("WARC-Payload-Digest", False),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
FIXED = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"  # gzip, deflate, with an extra field


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def member(data: bytes) -> bytes:
    """A gzip member with the lengths of both forms in its extra field."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(FIXED) + 2 + 12 + len(body) + 8, len(data) & 0xFFFFFFFF)
    return FIXED + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict) -> bytes:
    lines = ["WARC/1.1"]
    for column, (header, brackets) in HEADERS.items():
        if row[column] is not None:
            value = row[column].replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{header}: <{value}>" if brackets else f"{header}: {value}")
    if row["warc_type"] == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length'] or 0}\r\n\r\n".encode()
    block = http + (row["payload"] or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, out, size = [], None, 0
        store, base = _filesystem(self.path)
        store.create_dir(base, recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = store.open_output_stream(f"{base}/{files[-1][0]}", compression=None), 0
                size += out.write(member(record(row)))
                if size >= FILE_BYTES:
                    out.close()
                    files[-1][1], out = size, None
        if out is not None:
            out.close()
            files[-1][1] = size
        return Written(files)

    def commit(self, messages: list) -> None:
        store, base = _filesystem(self.path)
        store.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        store, base = _filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                store.delete_file(f"{base}/{name}")


@dataclass
class Files(InputPartition):
    names: list


class Headers:
    """Headers of a record, from as much of it as holds them."""

    def __init__(self, raw: bytes) -> None:
        lines = raw.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        self.named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}

    def get(self, column: str) -> str | None:
        header, brackets = HEADERS[column]
        value = self.named.get(header.lower())
        return value[1:-1] if value is not None and brackets else value


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split_bytes: int) -> None:
        self.path, self.payload, self.split_bytes = path, payload, split_bytes
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, base = _filesystem(self.path)
        there = {i.base_name: i.size for i in store.get_file_info(fs.FileSelector(base)) if i.is_file}
        manifests = [n for n in there if n.startswith("manifest-")]
        if manifests:
            files = [f for n in sorted(manifests) for f in json.loads(store.open_input_stream(f"{base}/{n}").read())]
        else:
            files = sorted([n, s] for n, s in there.items() if n.endswith((".warc", ".warc.gz")))
        groups, held = [], 0
        for name, size in files:
            if not groups or held + size > self.split_bytes:
                groups.append([])
                held = 0
            groups[-1].append(name)
            held += size
        return [Files(g) for g in groups] or [Files([])]

    def matches(self, headers: Headers) -> bool:
        return all((v := headers.get(c)) is not None and (wanted is None or v in wanted) for c, wanted in self.wanted)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        schema = pa.schema(list(zip(names, kinds, strict=True)))
        store, base = _filesystem(self.path)
        rows, held = [], 0
        for name in partition.names:
            with store.open_input_file(f"{base}/{name}") as f:
                for headers, block in self.records(f):
                    row = {c: headers.get(c) for c in HEADERS}
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = [x.split(b":", 1)[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    row["payload_length"] = int(said[0]) if said else None
                    row["payload"] = payload if self.payload and row["warc_type"] != "revisit" else None
                    rows.append(row)
                    held += len(block) + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, f) -> Iterator[tuple[Headers, bytes]]:
        """Headers and block of the records that match; of the block only the
        HTTP header where payloads aren't asked for."""
        at, size = 0, f.size()
        while at < size:
            f.seek(at)
            head = f.read(24)
            if head[:2] != b"\x1f\x8b":
                at = yield from self._plain(f, at)
            elif head[3] & 4 and head[12:14] == b"sl":
                length = struct.unpack("<I", head[16:20])[0]
                yield from self._member(f, at + 24, length - 24)
                at += length
            else:
                at = yield from self._foreign(f, at)

    def _member(self, f, at: int, length: int) -> Iterator[tuple[Headers, bytes]]:
        inflate = zlib.decompressobj(-15)
        raw, rest = b"", b""
        left = length
        f.seek(at)

        def more() -> None:
            nonlocal raw, rest, left
            if not rest:
                rest = f.read(min(left, 4096))
                left -= len(rest)
                if not rest:
                    raise ValueError("a record ends early")
            raw += inflate.decompress(rest, 4096)
            rest = inflate.unconsumed_tail

        while (end := raw.find(b"\r\n\r\n")) < 0:
            more()
        headers = Headers(raw[:end])
        if not self.matches(headers):
            return
        if self.payload and headers.get("warc_type") != "revisit":
            rest += f.read(left)
            raw += inflate.decompress(rest) + inflate.flush()
        else:
            while raw.find(b"\r\n\r\n", end + 4) < 0:
                more()
        yield headers, raw[end + 4 : end + 4 + int(headers.named["content-length"])]

    def _plain(self, f, at: int) -> Iterator[tuple[Headers, bytes]]:
        f.seek(at)
        raw = b""
        while (end := raw.find(b"\r\n\r\n")) < 0:
            part = f.read(4096)
            if not part:
                raise ValueError("a record ends early")
            raw += part
        headers = Headers(raw[:end])
        length = int(headers.named["content-length"])
        if self.matches(headers):
            f.seek(at + end + 4)
            yield headers, f.read(length)
        return at + end + 4 + length + 4

    def _foreign(self, f, at: int) -> Iterator[tuple[Headers, bytes]]:
        """A gzip member of unknown length and its records, one or more."""
        inflate, raw, rest, used = zlib.decompressobj(31), bytearray(), b"", at
        f.seek(at)

        def more() -> bool:
            nonlocal rest, used
            if inflate.eof:
                return False
            if not rest:
                rest = f.read(1 << 16)
                used += len(rest)
                if not rest:
                    raise ValueError("a record ends early")
            raw.extend(inflate.decompress(rest, 1 << 20))
            rest = inflate.unconsumed_tail
            return True

        while True:
            while (end := raw.find(b"\r\n\r\n")) < 0:
                if not more():
                    if raw.strip():
                        raise ValueError("a record ends early")
                    return used - len(inflate.unused_data)
            headers = Headers(bytes(raw[:end]))
            wanted, left = self.matches(headers), int(headers.named["content-length"])
            del raw[: end + 4]
            while len(raw) < left:
                if not wanted:  # not kept
                    left -= len(raw)
                    raw.clear()
                if not more():
                    raise ValueError("a record ends early")
            if wanted:
                yield headers, bytes(raw[:left])
            del raw[:left]
            while len(raw) < 4 and more():
                pass
            if raw[:4] == b"\r\n\r\n":
                del raw[:4]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false", int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Records of pages: a payload of at least ``least`` bytes that a smaller
    id has too makes a revisit, which refers to the smallest."""
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "sha": F.sha2("payload", 256)})
    # Only digests and ids are shuffled, and a digest's ids combine before that.
    first = rows.where(F.col("payload_length") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha").alias("of"), "first")
    out = rows.join(checked_broadcast(first, first.count(), 120), F.col("sha") == F.col("of"), "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    urn = lambda x: F.concat(F.lit("urn:page:"), F.coalesce(x.cast("string"), F.lit("")))
    return out.select(
        urn(F.col("page")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("warc_type"), F.lit(date).alias("date"), "target_uri",
        F.when(again, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "sha").alias("payload_digest"), "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    """Write records as archives into a new folder all executors share."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_id(urn: Column) -> Column:
    """The id in a record's name; null where the page had none."""
    return F.regexp_extract(urn, r"^urn:page:(-?\d+)$", 1).try_cast("long")
